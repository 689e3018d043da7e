"""The 24/7 schedule: moments and histogram quantiles by day type and bucket, gap filling, state at an instant."""

from __future__ import annotations

from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lanewright.functions import clean

ZONE = "America/Los_Angeles"
EVIDENCE = ("observed_historical_input", "modeled_gap_fill", "modeled_unobserved")
PER_DAY, WIDTH = 96, 15


def moments(df: DataFrame, keys: list[str], value: str, prefix: str) -> DataFrame:
    v = F.col(value)
    return df.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias(f"{prefix}_mean"), F.stddev_pop(v).alias(f"{prefix}_std"))


def histogram(df: DataFrame, keys: list[str], value: str, width: float, bins: int) -> DataFrame:
    """keys, bin, n: fixed bins from 0; what lies outside goes to the first or last bin."""
    bin_ = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(F.col(value) / width))).cast("int")
    return df.where(F.col(value).isNotNull()).groupBy(*keys, bin_.alias("bin")).agg(F.count("*").alias("n"))


def histogram_quantiles(hist: DataFrame, keys: list[str], width: float, quantiles: dict[str, float]) -> DataFrame:
    """Centre of the first bin whose running count reaches max(1, ceil(n * q)); a window over at most the bins of a key."""
    w = Window.partitionBy(*keys)
    run = hist.withColumn("_run", F.sum("n").over(w.orderBy("bin"))).withColumn("_all", F.sum("n").over(w))
    target = lambda q: F.greatest(F.lit(1), F.ceil(F.col("_all") * F.lit(q)))
    return run.groupBy(*keys).agg(*(((F.min(F.when(F.col("_run") >= target(q), F.col("bin"))) + 0.5) * width).alias(n) for n, q in quantiles.items()))


def distinct_days(df: DataFrame, keys: list[str], date: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count_distinct(date).alias("days"))


def calendar(df: DataFrame, keys: list[str], bucket: str = "bucket") -> DataFrame:
    """Every key of df with every bucket of the day."""
    return df.select(*keys).distinct().withColumn(bucket, F.explode(F.sequence(F.lit(0), F.lit((PER_DAY - 1) * WIDTH), F.lit(WIDTH))))


def cyclic_fill(df: DataFrame, keys: list[str], columns: list[str], bucket: str = "bucket") -> DataFrame:
    """Missing values between known ones by linear interpolation, the last bucket followed by the first.

    A window over the at most 96 buckets of a key; a key without any value stays null.
    """
    w = Window.partitionBy(*keys).orderBy(bucket)
    day, out = PER_DAY * WIDTH, df
    for c in columns:
        known = F.when(F.col(c).isNotNull(), F.struct(F.col(bucket).alias("b"), F.col(c).alias("v")))
        before = F.last(known, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
        after = F.first(known, True).over(w.rowsBetween(0, Window.unboundedFollowing))
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        first, last = F.first(known, True).over(whole), F.last(known, True).over(whole)
        out = out.withColumns({"_b": before, "_a": after, "_f": first, "_l": last})
        x0 = F.coalesce(F.col("_b.b"), F.col("_l.b") - day)
        x1 = F.coalesce(F.col("_a.b"), F.col("_f.b") + day)
        y0, y1 = F.coalesce(F.col("_b.v"), F.col("_l.v")), F.coalesce(F.col("_a.v"), F.col("_f.v"))
        line = y0 + (y1 - y0) * F.coalesce(F.try_divide(F.col(bucket) - x0, x1 - x0), F.lit(0.0))
        out = out.withColumn(c, F.coalesce(F.col(c), line)).drop("_a", "_b", "_f", "_l")
    return out


def day_fallback(df: DataFrame, keys: list[str], columns: list[str], day: str = "day_type", bucket: str = "bucket", days: tuple[str, str] = ("mon_thu", "friday")) -> DataFrame:
    """A day type without any observation of a key takes the other one's values, before gaps are filled."""
    seen = df.groupBy(*keys, day).agg(F.bool_or(F.greatest(*(F.col(c).isNotNull() for c in columns)) if len(columns) > 1 else F.col(columns[0]).isNotNull()).alias("_seen"))
    swap = F.when(F.col(day) == days[0], days[1]).when(F.col(day) == days[1], days[0])
    other = df.select(*keys, swap.alias(day), bucket, *(F.col(c).alias(f"_o_{c}") for c in columns))
    out = df.join(seen, [*keys, day]).join(other, [*keys, day, bucket], "left")
    return out.select(*keys, day, bucket, *(F.when(F.col("_seen"), F.col(c)).otherwise(F.col(f"_o_{c}")).alias(c) for c in columns), (~F.col("_seen")).alias("fallback"))


def compile_schedule(df: DataFrame, keys: list[str], specs: dict[str, tuple[float, int]], quantiles: dict[str, float], day: str = "day_type", bucket: str = "bucket") -> DataFrame:
    """Observations with day type and bucket to the dense schedule of four day types.

    specs gives each value column its histogram's width and bins.  Whole-day fallback comes
    first, then cyclic filling, then zero; weekends repeat mon_thu as modeled_unobserved.
    """
    grain = [*keys, day, bucket]
    spine = df.select(*keys).distinct().withColumn(day, F.explode(F.array(F.lit("mon_thu"), F.lit("friday")))).withColumn(bucket, F.explode(F.sequence(F.lit(0), F.lit((PER_DAY - 1) * WIDTH), F.lit(WIDTH))))
    out, columns = spine.join(df.groupBy(*grain).agg(F.count("*").alias("sample_count")), grain, "left"), []
    for value, (width, bins) in specs.items():
        h = histogram_quantiles(histogram(df, grain, value, width, bins), grain, width, {f"{value}_{n}": q for n, q in quantiles.items()})
        out = out.join(moments(df, grain, value, value).drop("n"), grain, "left").join(h, grain, "left")
        columns += [f"{value}_mean", f"{value}_std", *(f"{value}_{n}" for n in quantiles)]
    samples = out.select(*grain, F.coalesce("sample_count", F.lit(0)).alias("sample_count"))
    filled = cyclic_fill(day_fallback(out, keys, columns, day, bucket), [*keys, day], columns, bucket)
    filled = filled.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in columns}).join(samples, grain)
    filled = filled.withColumn("evidence_level", F.when(F.col("fallback") | (F.col("sample_count") == 0), EVIDENCE[1]).otherwise(EVIDENCE[0]))
    weekend = filled.where(F.col(day) == "mon_thu").withColumns({"sample_count": F.lit(0), "evidence_level": F.lit(EVIDENCE[2])})
    return filled.unionByName(weekend.withColumn(day, F.explode(F.array(F.lit("saturday"), F.lit("sunday"))))).drop("fallback")


def combined_evidence(a: Column, b: Column) -> Column:
    """The weaker of two levels; an unknown one is the weakest."""
    rank = lambda c: F.coalesce(*(F.when(c == e, F.lit(i)) for i, e in enumerate(EVIDENCE)), F.lit(99))
    return F.when(rank(b) > rank(a), b).otherwise(a)


def bracket(at: datetime) -> tuple[tuple[str, int], tuple[str, int], float]:
    """The buckets (day type, minute) around an instant and how far it is between them."""
    if at.tzinfo is None:
        raise ValueError("an instant needs a time zone")
    local = at.astimezone(ZoneInfo(ZONE))
    minute = (local.hour * 60 + local.minute) // WIDTH * WIDTH
    low = local.replace(hour=minute // 60, minute=minute % 60, second=0, microsecond=0)
    high = low + timedelta(minutes=WIDTH)
    names = ["mon_thu"] * 4 + ["friday", "saturday", "sunday"]
    return (names[low.weekday()], minute), (names[high.weekday()], high.hour * 60 + high.minute), (local - low).total_seconds() / (WIDTH * 60)


def state_at(schedule: DataFrame, at: datetime, keys: list[str], columns: list[str], bounds: dict[str, tuple] | None = None, day: str = "day_type", bucket: str = "bucket_start_minute") -> DataFrame:
    """Values between the two buckets around the instant, their weaker evidence, their flags united."""
    (day0, m0), (day1, m1), f = bracket(at)
    extra = [c for c in ("evidence_level", "quality_flags") if c in schedule.columns]
    part = lambda d, m, s: schedule.where((F.col(day) == d) & (F.col(bucket) == m)).select(*keys, *(F.col(c).alias(f"{c}_{s}") for c in [*columns, *extra]))
    both = part(day0, m0, "low").join(part(day1, m1, "high"), keys)
    out = [*(F.col(k) for k in keys)]
    for c in columns:
        v = F.col(f"{c}_low") + (F.col(f"{c}_high") - F.col(f"{c}_low")) * f
        out.append(clean.clip(v, *(bounds or {}).get(c, (None, None))).alias(c))
    if "evidence_level" in extra:
        out.append(combined_evidence(F.col("evidence_level_low"), F.col("evidence_level_high")).alias("evidence_level"))
    if "quality_flags" in extra:
        out.append(F.array_sort(F.array_union("quality_flags_low", "quality_flags_high")).alias("quality_flags"))
    return both.select(*out)


def states_at(schedule: DataFrame, instants: dict[str, datetime], keys: list[str], columns: list[str], bounds: dict[str, tuple] | None = None, day: str = "day_type", bucket: str = "bucket_start_minute") -> DataFrame:
    """state_at for many named instants in one pass: a column ``instant`` and the values between the buckets around it.

    Rows of the buckets that are asked for meet a table of two rows an instant; both sides of a key come together
    in one aggregate.  A key without one of the two buckets is left out.
    """
    evidence = "evidence_level" in schedule.columns
    asked = [(name, d, m, w) for name, at in instants.items() for (d, m), w in zip(bracket(at)[:2], (1 - bracket(at)[2], bracket(at)[2]), strict=True)]
    table = schedule.sparkSession.createDataFrame([(n, d, m, w, i % 2) for i, (n, d, m, w) in enumerate(asked)], "instant string, _day string, _bucket long, _w double, _side int")
    rows = schedule.select(*keys, F.col(day).alias("_day"), F.col(bucket).cast("long").alias("_bucket"), *columns, *(["evidence_level"] if evidence else [])).join(F.broadcast(table), ["_day", "_bucket"])
    side = lambda c, i: F.max(F.when(F.col("_side") == i, F.col(c)))
    both = rows.groupBy("instant", *keys).agg(F.count_distinct("_side").alias("_n"), side("_w", 1).alias("_w"), *(side(c, i).alias(f"{c}_{i}") for c in [*columns, *(["evidence_level"] if evidence else [])] for i in (0, 1))).where("_n = 2")
    out = [clean.clip(F.col(f"{c}_0") + (F.col(f"{c}_1") - F.col(f"{c}_0")) * F.col("_w"), *(bounds or {}).get(c, (None, None))).alias(c) for c in columns]
    return both.select("instant", *keys, *out, *([combined_evidence(F.col("evidence_level_0"), F.col("evidence_level_1")).alias("evidence_level")] if evidence else []))


def schedule_scaling(schedule: DataFrame, departure: datetime, keys: list[str], volume: str = "volume_mean", **columns: str) -> DataFrame:
    """requested_volume, am_anchor_volume, pm_anchor_volume: sums over all keys at the departure, at 07:30 and at 16:30 of its day; and the evidence levels at the departure."""
    local = departure.astimezone(ZoneInfo(ZONE))
    instants = {"requested": departure, "am_anchor": local.replace(hour=7, minute=30, second=0, microsecond=0), "pm_anchor": local.replace(hour=16, minute=30, second=0, microsecond=0)}
    rows = states_at(schedule, instants, keys, [volume], **columns)
    total = lambda name: F.coalesce(F.sum(F.when(F.col("instant") == name, F.col(volume))), F.lit(0.0)).alias(f"{name}_volume")
    levels = [F.array_sort(F.collect_set(F.when(F.col("instant") == "requested", F.col("evidence_level")))).alias("evidence_levels")] if "evidence_level" in schedule.columns else []
    return rows.agg(*map(total, instants), *levels)


def schedule_gate(schedule: DataFrame, metrics: list[str], quantile_groups: list[list[str]], speed: str = "speed_mean", day: str = "day_type", bucket: str = "bucket", station: str = "detector_id") -> DataFrame:
    """The checks that a schedule has to pass, one row each."""
    from .validate import gate, ordered_quantiles

    ordered = F.bool_and(F.lit(True))
    for g in quantile_groups:
        ordered = ordered & F.bool_and(ordered_quantiles(*g))
    return gate(schedule, {
        "rows_complete": F.count("*") == F.count_distinct(station) * PER_DAY * 4,
        "buckets_complete": F.count_distinct(bucket) == PER_DAY,
        "day_types_complete": F.count_distinct(day) == 4,
        "no_nulls": F.bool_and(F.least(*(F.col(m).isNotNull() for m in metrics)) if len(metrics) > 1 else F.col(metrics[0]).isNotNull()),
        "speed_in_range": F.bool_and(F.col(speed).between(0.1, 160)),
        "quantiles_ordered": ordered,
        "weekend_unobserved": F.coalesce(F.bool_and(F.when(F.col(day).isin("saturday", "sunday"), F.col("evidence_level") == EVIDENCE[2])), F.lit(False)),
    })
