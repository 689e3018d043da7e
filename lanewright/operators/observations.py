"""Detector observations: lanes to stations, validity, eligibility, campaign quality, imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewright.functions import clean, times
from lanewright.functions.text import MPH

BAD_FLAGS = ("bad", "invalid", "rejected")


def lanes_to_stations(lanes: DataFrame, keys: list[str], resolution_minutes: int = 15, raw_seconds: int = 20) -> DataFrame:
    """Lane rows (speed mph, volume per interval, occupancy, countreadings) to station rows.

    volume is an hourly sum; speed in km/h is weighted by positive volumes, else the median of
    positive speeds; a station is low_sample if any lane has under half of the readings expected.
    """
    v, s = F.col("volume"), F.col("speed")
    usable = (v > 0) & (s > 0)
    weighted = F.try_divide(F.sum(F.when(usable, v * s)), F.sum(F.when(usable, v)))
    speed = F.coalesce(weighted, F.median(F.when(s > 0, s))) * MPH
    expected = resolution_minutes * 60 / raw_seconds
    low = F.coalesce(F.bool_or(F.col("countreadings") < 0.5 * expected), F.lit(False))
    return lanes.groupBy(*keys).agg(speed.alias("speed_kph"), (F.sum("volume") * (60.0 / resolution_minutes)).alias("volume"), F.avg("occupancy").alias("occupancy"), F.when(low, "low_sample").otherwise("good").alias("quality_flag"))


def weighted_speed(df: DataFrame, keys: list[str], volume: str, speed: str) -> DataFrame:
    """The same rule over any columns: total volume, weighted speed, rows."""
    v, s = F.col(volume), F.col(speed)
    ok = (v > 0) & (s > 0)
    return df.groupBy(*keys).agg(F.sum(v).alias("volume"), F.coalesce(F.try_divide(F.sum(F.when(ok, v * s)), F.sum(F.when(ok, v))), F.median(F.when(s > 0, s))).alias("speed"), F.count("*").alias("n"))


def enrich(df: DataFrame) -> DataFrame:
    """Normalised observations with their calendar columns, validity flags and eligibility."""
    text, flag = F.col("timestamp_local"), F.lower(clean.trimmed("quality_flag"))
    date = times.date_of_text(text)
    speed, volume, occupancy = (clean.number(c) for c in ("speed_kph", "volume", "occupancy"))
    out = df.withColumns({"speed_kph": speed, "volume": volume, "occupancy": occupancy})
    speed, volume, occupancy = F.col("speed_kph"), F.col("volume"), F.col("occupancy")
    out = out.withColumns({
        "timestamp_utc": times.instant(text),
        "local_date": date,
        "local_year": F.year(date).cast("short"),
        "local_month": F.month(date).cast("byte"),
        "iso_weekday": (F.weekday(date) + 1).cast("byte"),
        "minute_of_day": times.minute_of_text(text).cast("short"),
        "speed_valid": F.coalesce((speed > 0) & (speed <= 200), F.lit(False)),
        "volume_valid": F.coalesce((volume >= 0) & (volume <= 20000), F.lit(False)),
        "occupancy_valid": F.coalesce(occupancy.between(0, 100), F.lit(True)),
    })
    good = ~flag.isin(*BAD_FLAGS, "low_sample")
    known = F.col("local_date").isNotNull() & F.col("minute_of_day").isNotNull() & (clean.trimmed("station_or_segment_id") != "")
    return out.withColumn("profile_eligible", known & good & F.col("speed_valid") & F.col("volume_valid") & F.col("occupancy_valid"))


def in_dates(df: DataFrame, text: str, first: str, last: str) -> DataFrame:
    """Rows whose date, as text, is within the chunk; the day after the end (a closing midnight) goes."""
    return df.where(F.substring(text, 1, 10).between(first, last))


def chunk_profile(df: DataFrame, grain: list[str]) -> DataFrame:
    """One row of a chunk's counters; rows beyond the first of a grain are duplicates."""
    repeated = df.groupBy(*grain).agg((F.count("*") - 1).alias("_extra")).agg(F.coalesce(F.sum("_extra"), F.lit(0)).alias("duplicate_rows"))
    counts = df.agg(
        F.count("*").alias("n_rows"),
        F.count_distinct("station_or_segment_id").alias("stations"),
        F.count_distinct("local_date").alias("dates"),
        F.count_distinct("minute_of_day").alias("buckets"),
        F.count_if(~F.col("speed_valid")).alias("invalid_speed"),
        F.count_if(~F.col("volume_valid")).alias("invalid_volume"),
        F.count_if(F.col("profile_eligible")).alias("eligible"),
    )
    return counts.join(repeated)  # one row each


def quality_rollup(df: DataFrame, group: str, metrics: dict[str, Column]) -> DataFrame:
    """Totals of the metrics for each group and, with a null group, over all."""
    return df.rollup(group).agg(*(m.alias(n) for n, m in metrics.items()))


def accept_import(df: DataFrame, edges: DataFrame) -> DataFrame:
    """Import rows with their matched edge and acceptance: a time, a station, an edge, and a speed or travel time."""
    speed, travel = clean.number("speed_kph"), clean.number("travel_time_seconds")
    named = df.withColumns({"speed_kph": speed, "travel_time_seconds": travel, "volume": clean.number("volume"), "at": times.instant(F.col("timestamp_local"))})
    known = edges.select(F.col("edge_id").alias("matched_edge_id")).distinct()
    out = named.join(known, clean.trimmed("station_or_segment_id") == F.col("matched_edge_id"), "left")
    usable = F.coalesce(F.col("speed_kph") > 0, F.lit(False)) | F.coalesce(F.col("travel_time_seconds") > 0, F.lit(False))
    return out.withColumn("accepted", F.col("at").isNotNull() & (clean.trimmed("station_or_segment_id") != "") & F.col("matched_edge_id").isNotNull() & usable)


def import_quality(df: DataFrame) -> DataFrame:
    """Counters of accept_import rows: accepted, rejected, stations matched or not, missing percents, flags."""
    missing = lambda c: F.bround(100 * F.avg(F.when(F.coalesce(F.col(c) > 0, F.lit(False)), 0.0).otherwise(1.0)), 1)
    stations = df.groupBy(clean.trimmed("station_or_segment_id").alias("s")).agg(F.bool_or(F.col("matched_edge_id").isNotNull()).alias("m"))
    stations = stations.agg(F.count_if("m").alias("matched_stations"), F.count_if(~F.col("m")).alias("unmatched_stations"))
    rows = df.agg(F.count("*").alias("n_rows"), F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"), missing("speed_kph").alias("missing_speed"), missing("volume").alias("missing_volume"), F.array_sort(F.collect_set(F.lower("quality_flag"))).alias("flags"))
    return rows.join(stations)  # one row each
