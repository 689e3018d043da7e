"""Weekday profiles: medians by edge and bucket, multipliers, quantiles, bounded samples, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lanewright.functions import clean, times


def eligible_rows(df: DataFrame) -> DataFrame:
    """Eligible weekday rows of the two periods, with period and bucket."""
    out = df.where("profile_eligible AND iso_weekday BETWEEN 1 AND 5").withColumn("period", times.period_of(F.col("minute_of_day")))
    return out.where("period IS NOT NULL").withColumn("bucket_minute", times.bucket_of(F.col("minute_of_day")))


def accepted_edges(matches: DataFrame) -> DataFrame:
    """One edge for each accepted station, the last by edge_id if there are more."""
    return matches.where("status = 'accepted' AND edge_id IS NOT NULL").groupBy("station_id").agg(F.max("edge_id").alias("edge_id"))


def with_edges(observations: DataFrame, matches: DataFrame) -> DataFrame:
    """Left join, so that what has no edge can be counted before it is dropped."""
    m = accepted_edges(matches)
    return observations.join(m, observations["station_or_segment_id"] == m["station_id"], "left").drop("station_id")


def bucket_medians(df: DataFrame, keys: list[str], speed: str, volume: str, station: str) -> DataFrame:
    s, v = F.col(speed), F.col(volume)
    return df.groupBy(*keys).agg(F.median(F.when(s > 0, s)).alias("speed_median"), F.median(F.when(v >= 0, v)).alias("volume_median"), F.count("*").alias("n"), F.count_distinct(station).alias("stations"))


def two_level_medians(df: DataFrame, instant: list[str], keys: list[str], speed: str, volume: str) -> DataFrame:
    """Sum of volumes and median speed at each instant, then medians and counts over instants."""
    s, v = F.col(speed), F.col(volume)
    first = df.groupBy(*keys, *instant).agg(F.sum(F.when(v > 0, v)).alias("_v"), F.median(F.when(s > 0, s)).alias("_s"))
    return first.groupBy(*keys).agg(F.median("_v").alias("volume_median"), F.median("_s").alias("speed_median"), F.count("*").alias("n"))


def multiplier(maxspeed: Column, speed: Column, travel: Column | None = None, free_flow: Column | None = None) -> Column:
    """Congestion multiplier within 1 and 5; null where nothing is known."""
    out = F.when(speed > 0, F.try_divide(maxspeed, speed))
    if travel is not None:
        out = F.coalesce(out, F.when(travel > 0, F.try_divide(travel, free_flow)))
    return clean.clip(out, 1.0, 5.0)


def exact_quantiles(df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), *(F.percentile(value, F.lit(q)).alias(n) for n, q in quantiles.items()))


def bounded_sample(df: DataFrame, keys: list[str], value: str, limit: int = 10_000, bins: int = 256) -> DataFrame:
    """At most ``limit`` order statistics of each key, evenly spread: place floor(i * (n - 1) / (limit - 1)).

    Values are counted first, and ranked within ``bins`` ranges of about as many rows, so that no
    key is sorted in one task; what stands before a range comes from the ranges' own counts.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    bounds = sorted(set(df.approxQuantile(value, [i / bins for i in range(1, bins)], 0.25 / bins)))
    counts = counts.withColumn("_b", F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<double>"), lambda b: b < F.col(value))) if bounds else F.lit(0))
    # A row for each key and range.
    sizes = counts.groupBy(*keys, "_b").agg(F.sum("_c").alias("_s"))
    before = F.sum("_s").over(Window.partitionBy(*keys).orderBy("_b")) - F.col("_s")
    sizes = sizes.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_b").alias("_bin"), before.alias("_before"), F.sum("_s").over(Window.partitionBy(*keys)).alias("_n"))
    same = F.col("_b") == F.col("_bin")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    ranked = counts.join(sizes, same).withColumn("_end", F.col("_before") + F.sum("_c").over(Window.partitionBy(*keys, "_b").orderBy(value)))
    ranked = ranked.withColumn("_start", F.col("_end") - F.col("_c"))
    k = F.least(F.col("_n"), F.lit(limit))
    step = F.when(k > 1, (F.col("_n") - 1) / (k - 1)).otherwise(F.lit(1.0))
    place = lambda i: F.floor(i * step + 1e-9)
    first = F.ceil((F.col("_start") - 1e-9) / step)
    last = F.least(F.ceil((F.col("_end") - 1e-9) / step) - 1, k - 1)
    chosen = ranked.where(first <= last).withColumn("i", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    return chosen.where((place(F.col("i")) >= F.col("_start")) & (place(F.col("i")) < F.col("_end"))).select(*keys, "i", F.bround(value, 6).alias("sample"))


def nearest_bucket(profiles: DataFrame, minute: int, bucket: str = "bucket_minute") -> DataFrame:
    """Rows of the bucket nearest to the minute, the lower one of two equally near."""
    best = profiles.agg(F.min(F.struct(F.abs(F.col(bucket) - minute).alias("d"), F.col(bucket).alias("b"))).alias("m")).select(F.col("m.b").alias(bucket))
    return profiles.join(F.broadcast(best), bucket, "left_semi")  # one row


def snapshot(profiles: DataFrame, minute: int) -> DataFrame:
    """edge_id, flow, speed of the nearest bucket."""
    return nearest_bucket(profiles, minute).select("edge_id", F.col("volume_median").alias("flow"), F.col("speed_median").alias("speed"), "bucket_minute")
