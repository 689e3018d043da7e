"""Seeded sampling whose results do not depend on partitions: bootstrap, rounding, weighted choice, departures."""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType
from pyspark.sql.window import Window

from lanewright.functions import hashing


def bootstrap(spark, sample: DataFrame, value: str, n: int, seed: int) -> DataFrame:
    """n draws with replacement from at most ten thousand stored values."""
    pool = sample.agg(F.array_sort(F.collect_list(value)).alias("pool"))
    draws = spark.range(n).join(F.broadcast(pool))  # one row
    return draws.select(F.col("id").alias("draw"), F.get("pool", hashing.index(F.size("pool"), F.lit(seed), F.col("id")).cast("int")).alias("value"))


def lognormal(draw: Column, seed: int, median: float = 1.15, sigma: float = 0.18) -> Column:
    """Lognormal by Box and Muller over hashed uniforms, at least 1."""
    u1, u2 = (F.greatest(F.lit(1e-12), hashing.fraction(F.lit(seed), F.lit(k), draw)) for k in ("u", "v"))
    z = F.sqrt(-2 * F.log(u1)) * F.cos(F.lit(6.283185307179586) * u2)
    return F.greatest(F.lit(1.0), F.exp(F.lit(log(median)) + sigma * z))


def reliability(draws: DataFrame, value: str, limit_seconds: float, quantiles: dict[str, float]) -> DataFrame:
    return draws.agg(F.avg((F.col(value) <= limit_seconds).cast("double")).alias("probability"), F.avg(value).alias("mean"), *(F.percentile(value, F.lit(q)).alias(n) for n, q in quantiles.items()))


def latest_departure(arrivals: DataFrame, departure: str, arrival: str, deadline, keys: tuple[str, ...] = ()) -> DataFrame:
    """The last departure (of each key) that still arrives in time; null if none does."""
    return arrivals.groupBy(*keys).agg(F.max(F.when(F.col(arrival) <= F.lit(deadline), F.col(departure))).alias("latest"))


def balanced_rounding(df: DataFrame, key: str, demand: str, scale: float, seed: int, bins: int = 1024) -> DataFrame:
    """Whole units of demand / scale that sum to the rounded total.

    Floors first; the units left go to fractions drawn without replacement, weighted by -ln(u) / fraction.
    The order is global: ``bins`` quantiles of the draws tell in which range the last unit falls, and only
    the rows of that range are ranked.
    """
    exact = F.col(demand) / scale
    parts = df.withColumns({"units": F.floor(exact).cast("long"), "_f": exact - F.floor(exact)})
    parts = parts.withColumn("_k", F.when(F.col("_f") > 1e-12, -F.log(F.greatest(F.lit(1e-300), hashing.fraction(F.lit(seed), F.col(key)))) / F.col("_f")))
    need = parts.agg((F.bround(F.sum(exact)) - F.sum("units")).cast("long")).head()[0] or 0
    if need <= 0:
        return parts.drop("_f", "_k")
    drawn = parts.where("_k IS NOT NULL")
    bounds = sorted(set(drawn.approxQuantile("_k", [i / bins for i in range(1, bins)], 0.25 / bins)))
    drawn = drawn.withColumn("_b", F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<double>"), lambda b: b < F.col("_k"))) if bounds else F.lit(0))
    cut, left = -1, need
    for row in sorted(drawn.groupBy("_b").count().collect()):  # a row for each range
        cut = row[0]
        if row[1] >= left:
            break
        left -= row[1]
    last = drawn.where(F.col("_b") == cut).orderBy("_k", key).limit(left).select(key)
    winners = drawn.where(F.col("_b") < cut).select(key).unionByName(last).withColumn("_one", F.lit(1))
    return parts.join(winners, key, "left").withColumn("units", F.col("units") + F.coalesce("_one", F.lit(0))).drop("_f", "_k", "_one")


def cumulative_shares(choices: DataFrame, group: str, choice: str, weight: str, bins: int = 256) -> DataFrame:
    """choices with _lo and _hi: the span of each in its group's running share of weight, in the order of choice.

    Spans of a group are adjacent to the last bit and the last one has no end.  Running sums go within ``bins``
    ranges of numeric choices, on top of the sums of the ranges before, so no group is sorted in one task.
    """
    rows = choices.where(F.col(weight) > 0)
    bounds: list = []
    if isinstance(rows.schema[choice].dataType, NumericType):
        bounds = sorted(set(rows.select(F.percentile_approx(choice, [i / bins for i in range(1, bins)], 10_000)).head()[0] or []))
    at = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda x: x < F.col(choice))) if bounds else F.lit(0)
    rows = rows.withColumn("_bin", at)
    earlier = Window.partitionBy(group).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(group, "_bin").agg(F.sum(weight).alias("_s"))
    sums = sums.withColumns({"_before": F.coalesce(F.sum("_s").over(earlier), F.lit(0.0)), "_all": F.sum("_s").over(Window.partitionBy(group))}).drop("_s")
    inner = Window.partitionBy(group, "_bin").orderBy(choice)
    rows = rows.join(sums, [group, "_bin"]).withColumn("_hi", (F.col("_before") + F.sum(weight).over(inner.rowsBetween(Window.unboundedPreceding, 0))) / F.col("_all")).drop("_before", "_all")
    tops = rows.groupBy(group, "_bin").agg(F.max("_hi").alias("_t"))
    tops = tops.withColumns({"_start": F.coalesce(F.max("_t").over(earlier), F.lit(0.0)), "_top": F.max("_t").over(Window.partitionBy(group))}).drop("_t")
    rows = rows.join(tops, [group, "_bin"]).withColumn("_lo", F.coalesce(F.lag("_hi").over(inner), "_start"))
    return rows.withColumn("_hi", F.when(F.col("_hi") >= F.col("_top"), float("inf")).otherwise(F.col("_hi"))).drop("_bin", "_start", "_top")


def weighted_choice(requests: DataFrame, choices: DataFrame, group: str, choice: str, weight: str, uniform: Column) -> DataFrame:
    """For each request the choice of its group whose span of the running share of weight holds the uniform number.

    Draws and spans meet by buckets of [0, 1), about as many as a group has choices, so a group of all rows is
    dealt to many tasks and none of its choices are gathered.  Choices without weight are never drawn; requests
    of a group without choices are left out.
    """
    spans = cumulative_shares(choices.select(group, choice, F.col(weight).cast("double").alias(weight)), group, choice, weight)
    parts = spans.groupBy(group).agg(F.least(F.lit(1 << 16), F.count("*")).alias("_n"))
    last = F.col("_n") - 1
    bucket = lambda x: F.least(last, F.floor(x * F.col("_n")).cast("long"))
    spread = spans.join(parts, group).withColumn("_b", F.explode(F.sequence(bucket(F.col("_lo")), F.when(F.col("_hi") > 1, last).otherwise(bucket(F.col("_hi")))))).select(group, choice, "_lo", "_hi", "_b")
    drawn = requests.withColumn("_u", uniform).join(parts, group).withColumn("_b", bucket(F.col("_u")))
    return drawn.join(spread, [group, "_b"]).where((F.col("_u") >= F.col("_lo")) & (F.col("_u") < F.col("_hi"))).select(*requests.columns, choice)


def weighted_endpoints(requests: DataFrame, origins: DataFrame, destinations: DataFrame, seed: int, key: str = "id", redraws: int = 4) -> DataFrame:
    """requests (key, origin, destination groups) with from_edge and to_edge drawn by weight.

    origins and destinations (zone, edge, weight).  A destination that is the origin's edge is drawn again, up to
    ``redraws`` times; the last draw stays.  Draws come from hashes of seed, key and attempt.
    """
    start = requests.select(key, F.col("origin").alias("zone"))
    start = weighted_choice(start, origins, "zone", "edge", "weight", hashing.fraction(F.lit(seed), F.col(key), F.lit("from"))).select(key, F.col("edge").alias("from_edge"))
    tries = requests.select(key, F.col("destination").alias("zone"), F.explode(F.sequence(F.lit(0), F.lit(redraws))).alias("attempt"))
    ends = weighted_choice(tries, destinations, "zone", "edge", "weight", hashing.fraction(F.lit(seed), F.col(key), F.lit("to"), F.col("attempt")))
    ends = ends.join(start, key)
    order = F.when(F.col("edge") != F.col("from_edge"), F.col("attempt")).otherwise(2 * redraws + 1 - F.col("attempt"))
    chosen = ends.groupBy(key).agg(F.min_by(F.struct("from_edge", F.col("edge").alias("to_edge")), order).alias("e"))
    return requests.join(chosen, key).select(*requests.columns, "e.from_edge", "e.to_edge")


def dispersed_pairs(requests: DataFrame, starts: DataFrame, ends: DataFrame, count: int, seed: int, key: str = "id", tries: int = 8) -> DataFrame:
    """(key, place, start, end): the request's own pair (origin, destination), then count - 1 pairs of nodes around them.

    starts and ends (key, node) are the nodes around a request's ends; a request without any uses its own node.  A
    pair of equal nodes is drawn again, up to ``tries`` times, and then left out.
    """
    def numbered(around: DataFrame, own: str, n: str) -> DataFrame:
        w = Window.partitionBy(key)
        all_ = requests.select(key, F.col(own).alias("_own")).join(around.select(key, "node"), key, "left").select(key, F.coalesce("node", "_own").alias("node")).distinct()
        return all_.select(key, F.col("node").alias(own), (F.row_number().over(w.orderBy("node")) - 1).cast("long").alias(f"_{own}"), F.count("*").over(w).alias(n))

    a, b = numbered(starts, "origin", "_na"), numbered(ends, "destination", "_nb")
    draws = requests.select(key).withColumn("place", F.explode(F.sequence(F.lit(1), F.lit(count - 1))) if count > 1 else F.explode(F.array().cast("array<int>"))).withColumn("_try", F.explode(F.sequence(F.lit(0), F.lit(tries))))
    sized = draws.join(a.select(key, "_na").distinct(), key).join(b.select(key, "_nb").distinct(), key)
    pick = lambda n, side: hashing.index(F.col(n), F.lit(seed), F.col(key), F.col("place"), F.col("_try"), F.lit(side))
    drawn = sized.withColumns({"_origin": pick("_na", "a"), "_destination": pick("_nb", "b")}).join(a.drop("_na"), [key, "_origin"]).join(b.drop("_nb"), [key, "_destination"])
    drawn = drawn.where("origin <> destination").groupBy(key, "place").agg(F.min_by(F.struct("origin", "destination"), "_try").alias("p")).select(key, "place", "p.*")
    return requests.select(key, F.lit(0).alias("place"), "origin", "destination").unionByName(drawn).withColumnsRenamed({"origin": "start", "destination": "end"})


def trips(units: DataFrame, key: str, count: str, start: float, duration: float, seed: int) -> DataFrame:
    """A row for each unit with a departure in [start, start + duration)."""
    rows = units.where(F.col(count) > 0).withColumn("trip", F.explode(F.sequence(F.lit(1), F.col(count))))
    return rows.withColumn("depart", start + duration * hashing.fraction(F.lit(seed), F.col(key), F.col("trip")))


def conservation_audit(rows: DataFrame, demand: str, units: str, scale: float) -> DataFrame:
    off = F.abs(F.col(demand) - F.col(units) * scale)
    return rows.agg(F.max(off).alias("largest_row_error"), F.abs(F.sum(demand) - F.sum(units) * scale).alias("total_error")).withColumn("passed", (F.col("largest_row_error") <= scale) & (F.col("total_error") <= scale))


def stable_sample(df: DataFrame, key: str, limit: int) -> DataFrame:
    """The rows with the smallest digests: the same ones whatever else is there."""
    return df.orderBy(F.sha1(F.col(key).cast("string")), key).limit(limit)


def allocate(df: DataFrame, key: str, weight: str, cap: int) -> DataFrame:
    """Agents in proportion to weight, at least one each."""
    total = df.agg(F.sum(weight).alias("_t"))
    return df.join(F.broadcast(total)).withColumn("agents", F.greatest(F.lit(1), F.round(F.col(weight) / F.col("_t") * cap).cast("long"))).drop("_t")


def holdout_split(df: DataFrame, group: str, share: float = 0.2, least_groups: int = 5) -> DataFrame:
    """split by the hash fraction of the group; with enough groups and none held out, the one with the least fraction is."""
    f = df.withColumn("_f", hashing.fraction(F.col(group)))
    least = f.select(group, "_f").distinct().agg(F.count("*").alias("_n"), F.min("_f").alias("_m"))
    held = (F.col("_f") < share) | ((F.col("_n") >= least_groups) & (F.col("_m") >= share) & (F.col("_f") == F.col("_m")))
    return f.join(F.broadcast(least)).withColumn("split", F.when(held, "holdout").otherwise("train")).drop("_f", "_n", "_m")
