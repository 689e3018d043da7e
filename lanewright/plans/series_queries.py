"""Time-series operators on the benchmark tables: events as detector observations (user = station)."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewright.functions import clean, hashing, times
from lanewright.operators import observations, profiles, sampling, schedules, validate
from lanewright.streaming import streams

from .registry import query

MINUTE = "(hour(ts) * 60 + minute(ts))"
BUCKET = f"(({MINUTE} // 15) * 15)"
PERIOD = f"CASE WHEN {MINUTE} >= 300 AND {MINUTE} < 600 THEN 'morning' WHEN {MINUTE} >= 840 AND {MINUTE} < 1140 THEN 'afternoon' END"
DAY = "CASE WHEN isodow(ts) <= 4 THEN 'mon_thu' WHEN isodow(ts) = 5 THEN 'friday' WHEN isodow(ts) = 6 THEN 'saturday' ELSE 'sunday' END"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the calendar columns of observations."""
    e = read(spark, sf_dir, "events")
    minute = times.minute_of_day(F.col("ts"))
    return e.withColumns({"minute_of_day": minute, "bucket": times.bucket_of(minute), "iso_weekday": F.weekday("ts") + 1, "period": times.period_of(minute), "day_type": times.day_type(F.col("ts")), "local_date": F.to_date("ts"), "profile_eligible": F.col("event_type") != "error"})


def r6(c: str, name: str | None = None):
    return F.bround(F.col(c).cast("double"), 6).alias(name or c)


@query("profile_edge_bucket_median", f"""
SELECT user_id, bucket_minute, period, round_even(median(value) FILTER (WHERE value > 0), 6) AS speed_median, round_even(median(value) FILTER (WHERE value >= 0), 6) AS volume_median,
  count(*) AS n, count(DISTINCT event_type) AS stations
FROM (SELECT *, {BUCKET} AS bucket_minute, {PERIOD} AS period FROM events WHERE event_type <> 'error' AND isodow(ts) <= 5) WHERE period IS NOT NULL GROUP BY user_id, bucket_minute, period""")
def profile_edge_bucket_median(spark, sf_dir):
    rows = profiles.eligible_rows(timed(spark, sf_dir))
    out = profiles.bucket_medians(rows, ["user_id", "bucket_minute", "period"], "value", "value", "event_type")
    return out.select("user_id", "bucket_minute", "period", r6("speed_median"), r6("volume_median"), "n", "stations")


@query("profile_two_level_median", f"""
SELECT user_id, bucket, round_even(median(v), 6) AS volume_median, round_even(median(s), 6) AS speed_median, count(*) AS n FROM (
  SELECT user_id, {BUCKET} AS bucket, ts::DATE AS d, sum(value) FILTER (WHERE value > 0) AS v, median(value) FILTER (WHERE value > 0) AS s FROM events GROUP BY 1, 2, 3) GROUP BY user_id, bucket""")
def profile_two_level_median(spark, sf_dir):
    out = profiles.two_level_medians(timed(spark, sf_dir), ["local_date"], ["user_id", "bucket"], "value", "value")
    return out.select("user_id", "bucket", r6("volume_median"), r6("speed_median"), "n")


@query("lane_weighted_speed", """
SELECT l_orderkey, round_even(sum(l_quantity), 6) AS volume, round_even(coalesce(sum(l_quantity * l_extendedprice) FILTER (WHERE l_quantity > 0 AND l_extendedprice > 0) / nullif(sum(l_quantity) FILTER (WHERE l_quantity > 0 AND l_extendedprice > 0), 0), median(l_extendedprice) FILTER (WHERE l_extendedprice > 0)), 6) AS speed, count(*) AS n
FROM lineitem GROUP BY l_orderkey""")
def lane_weighted_speed(spark, sf_dir):
    out = observations.weighted_speed(read(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_quantity", "l_extendedprice")
    return out.select("l_orderkey", r6("volume"), r6("speed"), "n")


@query("period_filter_counts", f"SELECT coalesce({PERIOD}, 'none') AS period, isodow(ts) <= 5 AS weekday, count(*) AS n, count(*) FILTER (WHERE event_type <> 'error') AS eligible FROM events GROUP BY 1, 2")
def period_filter_counts(spark, sf_dir):
    e = timed(spark, sf_dir)
    return e.groupBy(F.coalesce("period", F.lit("none")).alias("period"), (F.col("iso_weekday") <= 5).alias("weekday")).agg(F.count("*").alias("n"), F.count_if("profile_eligible").alias("eligible"))


@query("bucket_15min", f"SELECT {BUCKET} AS bucket, {DAY} AS day_type, count(*) AS n, round_even(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def bucket_15min(spark, sf_dir):
    return timed(spark, sf_dir).groupBy("bucket", "day_type").agg(F.count("*").alias("n"), F.bround(F.sum("value"), 4).alias("total"))


@query("season_window_filter", "SELECT event_id, user_id FROM events WHERE month(ts) IN (1, 10) AND isodow(ts) <= 5 AND hour(ts) BETWEEN 7 AND 9 AND lower(event_type) NOT IN ('bad', 'invalid', 'rejected', 'error')")
def season_window_filter(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.where(F.month("ts").isin(1, 10) & times.is_weekday(F.col("ts")) & F.hour("ts").between(7, 9) & ~F.lower("event_type").isin(*observations.BAD_FLAGS, "error")).select("event_id", "user_id")


@query("observation_validity", """
SELECT event_id, value > 0 AND value <= 200 AS speed_valid, value >= 0 AND value <= 20000 AS volume_valid, k IS NULL OR k BETWEEN 0 AND 100 AS occupancy_valid,
  value > 0 AND value <= 200 AND (k IS NULL OR k BETWEEN 0 AND 100) AND event_type NOT IN ('bad', 'invalid', 'rejected', 'low_sample', 'error') AS eligible
FROM (SELECT *, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events)""")
def observation_validity(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    flag = F.when(F.col("event_type") == "error", "rejected").otherwise(F.col("event_type"))
    rows = e.select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp_local"), F.col("user_id").cast("string").alias("station_or_segment_id"), F.col("value").cast("string").alias("speed_kph"), F.col("value").cast("string").alias("volume"), F.get_json_object("props", "$.k").alias("occupancy"), flag.alias("quality_flag"))
    return observations.enrich(rows).select("event_id", "speed_valid", "volume_valid", "occupancy_valid", F.col("profile_eligible").alias("eligible"))


@query("schedule_moments", f"SELECT user_id, {DAY} AS day_type, count(value) AS n, round_even(avg(value), 6) AS value_mean, round_even(stddev_pop(value), 6) AS value_std FROM events GROUP BY 1, 2")
def schedule_moments(spark, sf_dir):
    out = schedules.moments(timed(spark, sf_dir), ["user_id", "day_type"], "value", "value")
    return out.select("user_id", "day_type", "n", r6("value_mean"), r6("value_std"))


@query("schedule_hist_quantiles", f"""
WITH h AS (SELECT user_id, {DAY} AS day_type, least(99, greatest(0, floor(value / 5.0)))::INT AS bin, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1, 2, 3),
r AS (SELECT *, sum(n) OVER (PARTITION BY user_id, day_type ORDER BY bin) AS run, sum(n) OVER (PARTITION BY user_id, day_type) AS total FROM h)
SELECT user_id, day_type, (min(bin) FILTER (WHERE run >= greatest(1, ceil(total * 0.1::DOUBLE))) + 0.5) * 5.0::DOUBLE AS p10, (min(bin) FILTER (WHERE run >= greatest(1, ceil(total * 0.5::DOUBLE))) + 0.5) * 5.0::DOUBLE AS p50, (min(bin) FILTER (WHERE run >= greatest(1, ceil(total * 0.95::DOUBLE))) + 0.5) * 5.0::DOUBLE AS p95
FROM r GROUP BY user_id, day_type""")
def schedule_hist_quantiles(spark, sf_dir):
    keys = ["user_id", "day_type"]
    h = schedules.histogram(timed(spark, sf_dir), keys, "value", 5.0, 100)
    return schedules.histogram_quantiles(h, keys, 5.0, {"p10": 0.1, "p50": 0.5, "p95": 0.95})


@query("distinct_observed_days", f"SELECT user_id, {DAY} AS day_type, count(DISTINCT ts::DATE) AS days FROM events GROUP BY 1, 2")
def distinct_observed_days(spark, sf_dir):
    return schedules.distinct_days(timed(spark, sf_dir), ["user_id", "day_type"], "local_date")


@query("schedule_cyclic_fill", f"""
WITH obs AS (SELECT user_id, {BUCKET}::INT AS bucket, avg(value) AS v FROM events WHERE user_id < 40 GROUP BY 1, 2),
spine AS (SELECT user_id, unnest(range(0, 1440, 15))::INT AS bucket FROM (SELECT DISTINCT user_id FROM obs)),
s AS (SELECT spine.user_id, spine.bucket, v FROM spine LEFT JOIN obs USING (user_id, bucket)),
t AS (SELECT user_id, bucket + k * 1440 AS b, v FROM s, (VALUES (-1), (0), (1)) AS o(k)),
w AS (SELECT user_id, b, v,
  last_value(CASE WHEN v IS NOT NULL THEN b END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY b ROWS UNBOUNDED PRECEDING) AS b0, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY b ROWS UNBOUNDED PRECEDING) AS v0,
  first_value(CASE WHEN v IS NOT NULL THEN b END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b1, first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v1 FROM t)
SELECT user_id, b AS bucket, round_even(coalesce(v, v0 + (v1 - v0) * coalesce((b - b0)::DOUBLE / nullif(b1 - b0, 0), 0)), 6) AS v FROM w WHERE b >= 0 AND b < 1440""".replace(" WHERE user_id < 40", ""))
def schedule_cyclic_fill(spark, sf_dir):
    e = timed(spark, sf_dir)
    seen = e.groupBy("user_id", "bucket").agg(F.avg("value").alias("v"))
    dense = schedules.calendar(seen, ["user_id"]).join(seen, ["user_id", "bucket"], "left")
    return schedules.cyclic_fill(dense, ["user_id"], ["v"]).select("user_id", "bucket", r6("v"))


@query("schedule_state_interpolate", f"""
WITH b AS (SELECT user_id, {DAY} AS day_type, {BUCKET} AS bucket, avg(value) AS v FROM events GROUP BY 1, 2, 3)
SELECT l.user_id, round_even(least(160.0, greatest(0.1, l.v + (h.v - l.v) * (7.0::DOUBLE / 15))), 6) AS v FROM b l JOIN b h USING (user_id)
WHERE l.day_type = 'mon_thu' AND h.day_type = 'mon_thu' AND l.bucket = 435 AND h.bucket = 450""")
def schedule_state_interpolate(spark, sf_dir):
    b = timed(spark, sf_dir).groupBy("user_id", "day_type", F.col("bucket").alias("bucket_start_minute")).agg(F.avg("value").alias("v"))
    at = datetime(2025, 9, 8, 14, 22, tzinfo=timezone.utc)  # a Monday, 07:22 on the local clock
    return schedules.state_at(b, at, ["user_id"], ["v"], {"v": (0.1, 160.0)}).select("user_id", r6("v"))


@query("nearest_bucket", f"""
WITH p AS (SELECT {BUCKET} AS bucket_minute, user_id, count(*) AS n FROM events GROUP BY 1, 2)
SELECT bucket_minute, user_id, n FROM p WHERE bucket_minute = (SELECT bucket_minute FROM p ORDER BY abs(bucket_minute - 487), bucket_minute LIMIT 1)""")
def nearest_bucket(spark, sf_dir):
    p = timed(spark, sf_dir).groupBy(F.col("bucket").alias("bucket_minute"), "user_id").agg(F.count("*").alias("n"))
    return profiles.nearest_bucket(p, 487)


@query("multiplier_percentiles", """
SELECT event_type, count(*) AS n, round_even(avg(m), 6) AS mean, round_even(quantile_cont(m, 0.5), 6) AS p50, round_even(quantile_cont(m, 0.85), 6) AS p85, round_even(quantile_cont(m, 0.9), 6) AS p90, round_even(quantile_cont(m, 0.95), 6) AS p95
FROM (SELECT event_type, greatest(1.0::DOUBLE, least(5.0::DOUBLE, 100.0::DOUBLE / value)) AS m FROM events WHERE value > 0) GROUP BY event_type""")
def multiplier_percentiles(spark, sf_dir):
    m = read(spark, sf_dir, "events").withColumn("m", profiles.multiplier(F.lit(100.0), F.col("value")))
    out = profiles.exact_quantiles(m, ["event_type"], "m", {"p50": 0.5, "p85": 0.85, "p90": 0.9, "p95": 0.95})
    return out.select("event_type", "n", *(r6(c) for c in ("mean", "p50", "p85", "p90", "p95")))


@query("bounded_sample", """
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL),
i AS (SELECT event_type, n, unnest(range(0, least(n, 200)))::BIGINT AS i FROM (SELECT DISTINCT event_type, n FROM r))
SELECT i.event_type, i, round_even(value, 6) AS sample FROM i JOIN r ON r.event_type = i.event_type AND r.k = floor(i * CASE WHEN least(i.n, 200) > 1 THEN (i.n - 1)::DOUBLE / (least(i.n, 200) - 1) ELSE 1 END + 1e-9)""")
def bounded_sample(spark, sf_dir):
    return profiles.bounded_sample(read(spark, sf_dir, "events"), ["event_type"], "value", 200)


@query("quality_rollup", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS stations, count(*) FILTER (WHERE value > 200) AS invalid_speed, min(ts::DATE)::VARCHAR AS first_date, max(ts::DATE)::VARCHAR AS last_date FROM events GROUP BY ROLLUP (event_type)")
def quality_rollup(spark, sf_dir):
    e = timed(spark, sf_dir)
    return observations.quality_rollup(e, "event_type", {"n": F.count("*"), "stations": F.count_distinct("user_id"), "invalid_speed": F.count_if(F.col("value") > 200), "first_date": F.min("local_date").cast("string"), "last_date": F.max("local_date").cast("string")})


@query("chunk_profile", f"""
SELECT count(*) AS n_rows, count(DISTINCT user_id) AS stations, count(DISTINCT ts::DATE) AS dates, count(DISTINCT {MINUTE}) AS buckets, count(*) FILTER (WHERE NOT (value > 0 AND value <= 200)) AS invalid_speed, 0::BIGINT AS invalid_volume, count(*) FILTER (WHERE event_type <> 'error') AS eligible,
  (SELECT sum(c - 1)::BIGINT FROM (SELECT count(*) AS c FROM events GROUP BY user_id, {BUCKET}, ts::DATE)) AS duplicate_rows FROM events""")
def chunk_profile(spark, sf_dir):
    e = timed(spark, sf_dir).withColumns({"station_or_segment_id": F.col("user_id"), "speed_valid": (F.col("value") > 0) & (F.col("value") <= 200), "volume_valid": F.lit(True)})
    return observations.chunk_profile(e, ["user_id", "bucket", "local_date"])


@query("value_counts", "SELECT coalesce(event_type, 'missing') AS value, count(*) AS n FROM events GROUP BY 1")
def value_counts(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy(F.coalesce("event_type", F.lit("missing")).alias("value")).agg(F.count("*").alias("n"))


@query("windowed_events", "SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS start, event_type, count(*) AS n, round_even(sum(value), 4) AS total, round_even(avg(value), 6) AS mean, max(value) AS largest FROM events GROUP BY 1, 2")
def windowed_events(spark, sf_dir):
    out = streams.windowed(read(spark, sf_dir, "events"), "ts", ["event_type"], "value")
    return out.select("start", "event_type", "n", F.bround("total", 4).alias("total"), r6("mean"), "largest")


@query("edge_tick_stats", f"SELECT edge_id, sum(c)::BIGINT AS entries, round_even(avg(s), 6) AS mean_speed, count(*) AS occupied_ticks FROM (SELECT user_id AS edge_id, floor(epoch(ts))::BIGINT // 3600 AS tick, count(*) AS c, avg(value) AS s FROM events GROUP BY 1, 2) GROUP BY edge_id")
def edge_tick_stats(spark, sf_dir):
    ticks = read(spark, sf_dir, "events").select(F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600).alias("tick"), F.col("user_id").alias("edge_id"), F.col("value").alias("speed"))
    return streams.edge_tick_stats(ticks).select("edge_id", "entries", r6("mean_speed"), "occupied_ticks")


@query("restriction_toggles", "SELECT user_id, ts, active FROM (SELECT *, lag(active) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM (SELECT user_id, ts, event_id, value > 50 AS active FROM events)) WHERE b IS NULL OR b <> active")
def restriction_toggles(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("edge_id"), F.col("ts").alias("at"), (F.col("value") > 50).alias("active"))
    return streams.toggles_batch(e).select(F.col("edge_id").alias("user_id"), F.col("at").alias("ts"), "active")


@query("range_overlaps", "SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, max(l_shipdate + INTERVAL 20 DAY) OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM lineitem) WHERE l_shipdate <= p")
def range_overlaps(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    order = lambda day: F.struct(day.cast("timestamp").alias("day"), "l_partkey", "l_suppkey", "l_linenumber")
    # Ends rank behind every start of their day.
    end = F.struct((F.col("l_shipdate") + F.expr("INTERVAL 20 DAY")).cast("timestamp").alias("day"), *(F.lit((1 << 62)).cast(li.schema[c].dataType).alias(c) if li.schema[c].dataType.simpleString() == "bigint" else F.lit((1 << 31) - 1).cast(li.schema[c].dataType).alias(c) for c in ("l_partkey", "l_suppkey", "l_linenumber")))
    ranges = li.withColumns({"begins": order(F.col("l_shipdate")), "ends": end})
    return validate.overlapping_ranges(ranges, "l_orderkey", "begins", "ends").select("l_orderkey", "l_linenumber", "l_partkey")


@query("holdout_split", """
WITH g AS (SELECT DISTINCT user_id, ('0x' || substr(sha256(user_id::VARCHAR), 1, 13))::BIGINT::DOUBLE / 4503599627370496 AS f FROM events)
SELECT user_id, CASE WHEN f < 0.2 OR ((SELECT count(*) FROM g) >= 5 AND (SELECT min(f) FROM g) >= 0.2 AND f = (SELECT min(f) FROM g)) THEN 'holdout' ELSE 'train' END AS split FROM g""")
def holdout_split(spark, sf_dir):
    groups = read(spark, sf_dir, "events").select("user_id").distinct()
    return sampling.holdout_split(groups, "user_id").select("user_id", "split")


@query("hash_ids", "SELECT event_id, substr(sha256(event_id::VARCHAR || '|' || event_type), 1, 24) AS id, round_even(('0x' || substr(sha256(event_id::VARCHAR || '|' || event_type), 1, 13))::BIGINT::DOUBLE / 4503599627370496, 12) AS fraction FROM events")
def hash_ids(spark, sf_dir):
    parts = [F.col("event_id"), F.col("event_type")]
    return read(spark, sf_dir, "events").select("event_id", hashing.short_id(*parts).alias("id"), F.bround(hashing.fraction(*parts), 12).alias("fraction"))


@query("stable_sample", "SELECT user_id FROM (SELECT DISTINCT user_id FROM events) ORDER BY sha1(user_id::VARCHAR), user_id LIMIT 50")
def stable_sample(spark, sf_dir):
    return sampling.stable_sample(read(spark, sf_dir, "events").select("user_id").distinct(), "user_id", 50)


@query("missing_percent", "SELECT user_id, round_even(100 * avg(CASE WHEN value > 20 THEN 0.0::DOUBLE ELSE 1.0 END), 1) AS missing FROM events GROUP BY user_id")
def missing_percent(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("user_id").agg(F.bround(100 * F.avg(F.when(F.col("value") > 20, 0.0).otherwise(1.0)), 1).alias("missing"))


@query("local_wall_clock", "SELECT event_id, substr(t, 1, 10) AS local_date, CAST(substr(t, 12, 2) AS INT) * 60 + CAST(substr(t, 15, 2) AS INT) AS minute_of_day FROM (SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S-07:00') AS t FROM events)")
def local_wall_clock(spark, sf_dir):
    t = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'-07:00'")
    return read(spark, sf_dir, "events").select("event_id", times.date_of_text(t).cast("string").alias("local_date"), times.minute_of_text(t).alias("minute_of_day"))


@query("clean_numbers", "SELECT event_id, CASE WHEN isnan(x) THEN NULL ELSE x END AS x, least(300.0::DOUBLE, greatest(5.0::DOUBLE, value)) AS clipped FROM (SELECT event_id, value, TRY_CAST(CASE event_id % 4 WHEN 0 THEN 'abc' WHEN 1 THEN 'NaN' WHEN 2 THEN NULL ELSE value::VARCHAR END AS DOUBLE) AS x FROM events)")
def clean_numbers(spark, sf_dir):
    text = F.when(F.col("event_id") % 4 == 0, "abc").when(F.col("event_id") % 4 == 1, "NaN").when(F.col("event_id") % 4 == 3, F.col("value").cast("string"))
    return read(spark, sf_dir, "events").select("event_id", clean.number(text).alias("x"), clean.clip(F.col("value"), 5.0, 300.0).alias("clipped"))


@query("reliability_quantiles", "SELECT count(*) AS n, round_even(avg((value <= 60)::INT::DOUBLE), 6) AS probability, round_even(avg(value), 6) AS mean, round_even(quantile_cont(value, 0.5), 6) AS p50, round_even(quantile_cont(value, 0.85), 6) AS p85, round_even(quantile_cont(value, 0.95), 6) AS p95 FROM events")
def reliability_quantiles(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    out = sampling.reliability(e, "value", 60, {"p50": 0.5, "p85": 0.85, "p95": 0.95})
    return out.join(e.agg(F.count("*").alias("n"))).select("n", *(r6(c) for c in ("probability", "mean", "p50", "p85", "p95")))


@query("bootstrap_draws", """
WITH r AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS k, count(*) OVER () AS n FROM events WHERE value IS NOT NULL),
i AS (SELECT n, unnest(range(0, least(n, 10000)))::BIGINT AS i FROM (SELECT DISTINCT n FROM r)),
pool AS (SELECT list(round_even(value, 6) ORDER BY value) AS p FROM i JOIN r ON r.k = floor(i * CASE WHEN least(i.n, 10000) > 1 THEN (i.n - 1)::DOUBLE / (least(i.n, 10000) - 1) ELSE 1 END + 1e-9)),
d AS (SELECT unnest(range(0, 1000)) AS draw)
SELECT draw::BIGINT AS draw, p[1 + least(floor(('0x' || substr(sha256('7|' || draw::VARCHAR), 1, 13))::BIGINT::DOUBLE / 4503599627370496 * len(p)), len(p) - 1)::INT] AS value FROM d, pool""")
def bootstrap_draws(spark, sf_dir):
    pool = profiles.bounded_sample(read(spark, sf_dir, "events"), [], "value")
    return sampling.bootstrap(spark, pool, "sample", 1000, 7)


@query("latest_departure", "SELECT user_id, max(ts) FILTER (WHERE ts + to_microseconds((value * 1000000)::BIGINT) <= TIMESTAMP '2024-01-20 08:00:00') AS latest FROM events GROUP BY user_id")
def latest_departure(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    arrival = F.timestamp_add("MICROSECOND", F.round(F.col("value") * 1_000_000).cast("long"), F.col("ts"))
    deadline = F.lit("2024-01-20 08:00:00").cast("timestamp_ntz")
    return sampling.latest_departure(e.withColumn("arrival", arrival), "ts", "arrival", deadline, ("user_id",))


@query("schedule_evidence_gate", f"""
WITH s AS (SELECT user_id, {DAY} AS d, quantile_cont(value, 0.1) AS p10, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.9) AS p90 FROM events GROUP BY 1, 2)
SELECT unnest(['ordered', 'day_types', 'no_nulls']) AS "check", unnest([bool_and(p10 <= p50 AND p50 <= p90), count(DISTINCT d) = 4, bool_and(p50 IS NOT NULL)]) AS passed FROM s""")
def schedule_evidence_gate(spark, sf_dir):
    s = timed(spark, sf_dir).groupBy("user_id", "day_type").agg(*(F.percentile("value", F.lit(q)).alias(n) for n, q in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9))))
    return validate.gate(s, {"ordered": F.bool_and(validate.ordered_quantiles("p10", "p50", "p90")), "day_types": F.count_distinct("day_type") == 4, "no_nulls": F.bool_and(F.col("p50").isNotNull())})


@query("playback_windows", "SELECT floor(epoch(ts))::BIGINT // 60 AS w, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY 1")
def playback_windows(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"), "event_id")
    out = streams.playback(e, "at", 60)
    return out.select(F.col("window").alias("w"), F.size("rows").cast("long").alias("n"), F.array_min(F.transform("rows", lambda r: r["event_id"])).alias("first_id"))
