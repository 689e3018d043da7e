"""Zones, lines and planning on the benchmark tables: nations as polygons with holes, customers as points, suppliers as lines."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from lanewright.functions import canonical, times
from lanewright.operators import areas, od, sampling, schedules

from .registry import query
from .series_queries import BUCKET, DAY, timed
from .star_queries import r6, read


def nation_shapes(spark, sf_dir):
    """A diamond for each nation with a hole of half its size; every fifth has a second diamond far away."""
    k = F.col("n_nationkey").cast("double")

    def ring(cx, cy, a, b):
        points = [(cx - a, cy), (cx, cy - b), (cx + a, cy), (cx, cy + b), (cx - a, cy)]
        return F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in points))

    def diamond(cx, cy, a, b):
        return F.array(ring(cx, cy, a, b), ring(cx, cy, a / 2, b / 2))

    one = diamond(400 * k, 3000 + 37 * k, 700 + 10 * k, F.lit(900.0))
    two = diamond(9000 - 300 * k, 500 + 20 * k, F.lit(350.5), F.lit(420.25))
    return read(spark, sf_dir, "nation").select("n_name", F.when(F.col("n_nationkey") % 5 == 0, F.array(one, two)).otherwise(F.array(one)).alias("shape"))


@query("points_in_zones", """
WITH p AS (SELECT c_custkey, c_acctbal::DOUBLE AS x, ((c_custkey * 7919) % 5003)::DOUBLE AS y FROM customer),
d AS (SELECT n_name, 400.0 * n_nationkey AS cx, 3000 + 37.0 * n_nationkey AS cy, 700 + 10.0 * n_nationkey AS a, 900.0 AS b FROM nation
  UNION ALL SELECT n_name, 9000 - 300.0 * n_nationkey, 500 + 20.0 * n_nationkey, 350.5, 420.25 FROM nation WHERE n_nationkey % 5 = 0)
SELECT DISTINCT c_custkey, n_name FROM p JOIN d ON abs(x - cx) / a + abs(y - cy) / b BETWEEN 0.5 AND 1""")
def points_in_zones(spark, sf_dir):
    points = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("x"), F.pmod(F.col("c_custkey") * 7919, F.lit(5003)).cast("double").alias("y"))
    return areas.points_in_zones(points, nation_shapes(spark, sf_dir), "n_name", 100.0).select("c_custkey", "n_name")


@query("zone_areas", """
SELECT n_name, round_even((700 + 10.0::DOUBLE * n_nationkey) * 900 * 2 * 0.75 + CASE WHEN n_nationkey % 5 = 0 THEN 350.5::DOUBLE * 420.25 * 2 * 0.75 ELSE 0 END, 3) AS area, true AS valid, n_nationkey <> 7 AS turned_valid FROM nation""")
def zone_areas(spark, sf_dir):
    shapes = nation_shapes(spark, sf_dir).join(read(spark, sf_dir, "nation").select("n_name", "n_nationkey"), "n_name")
    ring = lambda r: areas.ring_area(r)
    area = F.aggregate("shape", F.lit(0.0), lambda t, rings: t + 2 * ring(F.get(rings, F.lit(0))) - F.aggregate(rings, F.lit(0.0), lambda u, r: u + ring(r)))
    # One nation's outer ring with two corners exchanged crosses itself.
    crossed = F.transform("shape", lambda rings: F.transform(rings, lambda r: F.array(F.get(r, F.lit(0)), F.get(r, F.lit(1)), F.get(r, F.lit(3)), F.get(r, F.lit(2)), F.get(r, F.lit(0)))))
    turned = F.when(F.col("n_nationkey") == 7, crossed).otherwise(F.col("shape"))
    return shapes.select("n_name", F.bround(area, 3).alias("area"), areas.valid_shape(F.col("shape")).alias("valid"), areas.valid_shape(turned).alias("turned_valid"))


@query("line_overlaps", """
WITH a AS (SELECT s_suppkey, (s_suppkey % 89) * 40.0::DOUBLE AS x0, (s_suppkey % 89) * 40.0::DOUBLE + 90 + s_suppkey % 7 AS x1, abs(s_acctbal)::DOUBLE AS y FROM supplier),
b AS (SELECT p_partkey, (p_partkey % 97) * 37.0::DOUBLE AS u0, (p_partkey % 97) * 37.0::DOUBLE + 60 + p_size AS u1, p_retailprice::DOUBLE * 5 AS v FROM part),
j AS (SELECT *, greatest(0, u0 - x1, x0 - u1) AS gap, abs(y - v) AS off FROM a JOIN b ON abs(y - v) <= 12)
SELECT s_suppkey, p_partkey, round_even(sqrt(gap * gap + off * off), 6) AS distance, round_even(CASE WHEN off <= 8 THEN greatest(0, least(x1, u1 + sqrt(64 - off * off)) - greatest(x0, u0 - sqrt(64 - off * off))) ELSE 0 END, 6) AS covered FROM j WHERE sqrt(gap * gap + off * off) <= 12""")
def line_overlaps(spark, sf_dir):
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    x, y = F.pmod("s_suppkey", F.lit(89)) * 40.0, F.abs("s_acctbal")
    a = read(spark, sf_dir, "supplier").select("s_suppkey", F.array(point(x, y), point(x + 45, y), point(x + 90 + F.pmod("s_suppkey", F.lit(7)), y)).alias("line"))
    u, v = F.pmod("p_partkey", F.lit(97)) * 37.0, F.col("p_retailprice").cast("double") * 5
    b = read(spark, sf_dir, "part").select("p_partkey", F.array(point(u, v), point(u + 60 + F.col("p_size"), v)).alias("other"))
    return areas.line_overlaps(a, b, 12.0, ("s_suppkey", "p_partkey"), near=8.0).select("s_suppkey", "p_partkey", r6("distance"), r6("covered"))


#: Seconds of travel by minute of the day: slow for an hour and a half in the morning.
TRAVEL = ((0, 300.0), (450, 300.0), (510, 1500.0), (570, 400.0), (1440, 300.0))
TRAVEL_SQL = "CASE WHEN m < 450 THEN 300.0 WHEN m < 510 THEN 300 + 1200.0 * (m - 450) / 60 WHEN m < 570 THEN 1500 - 1100.0 * (m - 510) / 60 ELSE 400 - 100.0 * (m - 570) / 870 END"


@query("arrive_by", f"""
WITH RECURSIVE o AS (SELECT o_orderkey, (28000 + o_orderkey % 12000)::DOUBLE AS due FROM orders),
halves AS (SELECT o_orderkey, due, due - 28800 AS lo, due AS hi, 0 AS i FROM o
  UNION ALL SELECT o_orderkey, due, CASE WHEN mid + t <= due THEN mid ELSE lo END, CASE WHEN mid + t <= due THEN hi ELSE mid END, i + 1
    FROM (SELECT *, ({TRAVEL_SQL})::DOUBLE AS t FROM (SELECT *, lo + (hi - lo) / 2 AS mid, (((lo + (hi - lo) / 2) / 60) % 1440 + 1440) % 1440 AS m FROM halves WHERE i < 15)))
SELECT o_orderkey, round_even(lo, 8) AS departure, round_even(lo + ({TRAVEL_SQL})::DOUBLE, 8) AS arrival FROM (SELECT *, ((lo / 60) % 1440 + 1440) % 1440 AS m FROM halves WHERE i = 15)""")
def arrive_by(spark, sf_dir):
    due = read(spark, sf_dir, "orders").select("o_orderkey", (28000 + F.pmod("o_orderkey", F.lit(12000))).cast("double").alias("due"))
    plan = times.arrive_by(F.col("due"), lambda t: od.piecewise(F.pmod(t / 60, F.lit(1440.0)), TRAVEL))
    return due.select("o_orderkey", plan.alias("p")).select("o_orderkey", F.bround("p.departure", 8).alias("departure"), F.bround("p.arrival", 8).alias("arrival"))


@query("weighted_endpoints", """
WITH w AS (SELECT s_suppkey AS e, sum(s_acctbal::DOUBLE) OVER (ORDER BY s_suppkey) / sum(s_acctbal::DOUBLE) OVER () AS hi FROM supplier WHERE s_acctbal > 0),
d AS (SELECT c_custkey, a, ('0x' || substr(sha256('5|' || c_custkey::VARCHAR || CASE WHEN a < 0 THEN '|from' ELSE '|to|' || a::VARCHAR END), 1, 13))::BIGINT::DOUBLE / 4503599627370496 AS u FROM customer, (SELECT unnest(range(-1, 5)) AS a)),
p AS (SELECT c_custkey, a, (SELECT min(e) FROM w WHERE hi > u) AS e FROM d)
SELECT o.c_custkey, o.e AS from_edge, coalesce(arg_min(t.e, t.a) FILTER (t.e <> o.e), arg_max(t.e, t.a)) AS to_edge FROM p o JOIN p t ON t.c_custkey = o.c_custkey AND t.a >= 0 WHERE o.a < 0 GROUP BY 1, 2""")
def weighted_endpoints(spark, sf_dir):
    edges = read(spark, sf_dir, "supplier").select(F.lit("all").alias("zone"), F.col("s_suppkey").alias("edge"), F.col("s_acctbal").cast("double").alias("weight"))
    requests = read(spark, sf_dir, "customer").select("c_custkey", F.lit("all").alias("origin"), F.lit("all").alias("destination"))
    return sampling.weighted_endpoints(requests, edges, edges, 5, "c_custkey").select("c_custkey", "from_edge", "to_edge")


@query("schedule_scaling", f"""
WITH b AS (SELECT user_id, {DAY} AS day_type, {BUCKET} AS bucket, avg(value) AS v FROM events GROUP BY 1, 2, 3),
i AS (SELECT * FROM (VALUES ('requested', 435, 450, 7.0::DOUBLE / 15), ('am', 450, 465, 0.0), ('pm', 990, 1005, 0.0)) AS t(name, low, high, f)),
s AS (SELECT name, sum(l.v + (h.v - l.v) * f) AS v FROM i JOIN b l ON l.bucket = low AND l.day_type = 'mon_thu' JOIN b h ON h.bucket = high AND h.day_type = 'mon_thu' AND h.user_id = l.user_id GROUP BY name)
SELECT round_even(coalesce(sum(v) FILTER (name = 'requested'), 0), 6) AS requested_volume, round_even(coalesce(sum(v) FILTER (name = 'am'), 0), 6) AS am_anchor_volume, round_even(coalesce(sum(v) FILTER (name = 'pm'), 0), 6) AS pm_anchor_volume FROM s""")
def schedule_scaling(spark, sf_dir):
    b = timed(spark, sf_dir).groupBy("user_id", "day_type", F.col("bucket").alias("bucket_start_minute")).agg(F.avg("value").alias("volume_mean"))
    at = datetime(2025, 9, 8, 14, 22, tzinfo=timezone.utc)  # a Monday, 07:22 on the local clock
    return schedules.schedule_scaling(b, at, ["user_id"]).select(*(r6(f"{x}_volume") for x in ("requested", "am_anchor", "pm_anchor")))


@query("canonical_keys", """
SELECT o_orderkey, sha256('{"a":{"key":' || o_orderkey::VARCHAR || ',"status":"' || o_orderstatus || '"},"list":[' || o_custkey::VARCHAR || ',null],"z":{"b":true,"c":' || (o_custkey % 8)::VARCHAR || '.5,"n":null}}') AS key FROM orders""")
def canonical_keys(spark, sf_dir):
    z = F.struct(F.lit(None).cast("string").alias("n"), (F.pmod("o_custkey", F.lit(8)) + F.lit(0.5)).alias("c"), F.lit(True).alias("b"))
    value = F.struct(z.alias("z"), F.array("o_custkey", F.lit(None)).alias("list"), F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("key"), F.lit(None).cast("string")).alias("m"), F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("key")).alias("a")).dropFields("m")
    return read(spark, sf_dir, "orders").select("o_orderkey", canonical.cache_key(value).alias("key"))
