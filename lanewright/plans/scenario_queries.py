"""Scenario operators on the benchmark tables: parts as edges, orders as routes, events as runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanewright.operators import scenarios

from .registry import query
from .star_queries import PATHS, paths, r6, read

CLOSED = "SELECT l_partkey AS edge_id, CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN 'full' ELSE 'lanes' END AS type FROM lineitem"
FLOWS = "SELECT l_partkey AS edge_id, sum(l_quantity) AS flow FROM lineitem GROUP BY 1"
ROUTES = f"""SELECT o_custkey, o_orderkey AS route_id, o_totalprice AS travel_seconds, 10.0 * o_totalprice AS distance_m, o_orderkey % 97 * 1.0 AS penalty_seconds, o_orderkey % 89 * 100.0 AS residential_m, edge_ids
  FROM orders JOIN ({PATHS}) ON o_orderkey = l_orderkey"""


def part_edges(spark, sf_dir):
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(k.alias("edge_id"), (k % 97).alias("u"), (k % 89).alias("v"), (20.0 * F.col("p_size")).alias("capacity_vph"), F.col("p_retailprice").alias("speed_kph"))


def part_flows(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("edge_id")).agg(F.sum("l_quantity").alias("flow"))


def closed_parts(spark, sf_dir):
    kind = F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1), "full").otherwise("lanes")
    return read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("edge_id"), kind.alias("type"))


@query("displaced_demand", f"""
WITH c AS (SELECT DISTINCT edge_id FROM ({CLOSED}) WHERE type = 'full'), f AS ({FLOWS})
SELECT edge_id IN (SELECT edge_id FROM c) AS displaced, p_partkey % 97 AS u, p_partkey % 89 AS v, round_even(sum(flow), 6) AS volume, count(*) AS n FROM f JOIN part ON p_partkey = edge_id WHERE flow > 0 OR edge_id NOT IN (SELECT edge_id FROM c) GROUP BY 1, 2, 3""")
def displaced_demand(spark, sf_dir):
    e = part_edges(spark, sf_dir)
    demand, stay = scenarios.displaced_demand(e, part_flows(spark, sf_dir), closed_parts(spark, sf_dir))
    stay = stay.join(e, "edge_id").select(F.lit(False).alias("displaced"), "u", "v", F.col("flow").alias("volume"))
    both = demand.select(F.lit(True).alias("displaced"), F.col("origin").alias("u"), F.col("destination").alias("v"), "volume").unionByName(stay)
    return both.groupBy("displaced", "u", "v").agg(F.bround(F.sum("volume"), 6).alias("volume"), F.count("*").alias("n"))


@query("modelled_flow", f"""
WITH f AS ({FLOWS}), o AS (SELECT p_partkey AS edge_id, CASE WHEN p_partkey % 10 = 0 THEN 'holdout' ELSE 'train' END AS split FROM part WHERE p_partkey % 5 = 0),
r AS (SELECT p_partkey AS edge_id, coalesce(flow, 0) AS flow, coalesce(flow, 0) / greatest(20.0 * p_size, 1) AS ratio, p_retailprice AS s, split FROM part LEFT JOIN f ON f.edge_id = p_partkey LEFT JOIN o ON o.edge_id = p_partkey)
SELECT edge_id, flow, round_even(ratio, 6) AS ratio, round_even(s / (1 + 0.15 * pow(ratio, 4)), 6) AS modeled_speed_kph,
  CASE WHEN split = 'train' THEN 'observed_constraint_train' WHEN split = 'holdout' THEN 'observed_validation_holdout' WHEN flow > 0 THEN 'modeled_proxy_path' ELSE 'no_proxy_path_flow' END AS flow_evidence,
  CASE WHEN ratio >= 1 THEN 'heavy' WHEN ratio >= 0.72 THEN 'slow' ELSE 'free' END AS by_volume,
  CASE WHEN s / (1 + 0.15 * pow(ratio, 4)) / greatest(s, 0.1) < 0.35 THEN 'heavy' WHEN s / (1 + 0.15 * pow(ratio, 4)) / greatest(s, 0.1) < 0.7 THEN 'slow' ELSE 'free' END AS by_speed FROM r""")
def modelled_flow(spark, sf_dir):
    e = part_edges(spark, sf_dir)
    observed = e.where("edge_id % 5 = 0").select("edge_id", F.when(F.col("edge_id") % 10 == 0, "holdout").otherwise("train").alias("split"))
    out = scenarios.flow_columns(e, part_flows(spark, sf_dir), observed)
    return out.select("edge_id", "flow", r6("ratio"), r6("modeled_speed_kph"), "flow_evidence", scenarios.congestion_by_volume(F.col("ratio")).alias("by_volume"), scenarios.congestion_by_speed(F.col("modeled_speed_kph"), F.col("speed_kph")).alias("by_speed"))


@query("route_ranking", f"""
WITH r AS ({ROUTES}), f AS (SELECT o_custkey, route_id AS fr, travel_seconds AS ft, edge_ids AS fe FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY travel_seconds, route_id) AS k FROM r) WHERE k = 1),
j AS (SELECT r.*, fr, ft, len(list_intersect(edge_ids, fe))::DOUBLE / len(list_distinct(edge_ids)) AS overlap FROM r JOIN f USING (o_custkey)),
s AS (SELECT o_custkey, route_id AS sr FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY penalty_seconds / greatest(travel_seconds, 1), travel_seconds, route_id) AS k FROM j WHERE route_id <> fr) WHERE k = 1),
t AS (SELECT o_custkey, route_id AS tr FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY travel_seconds / greatest(ft, 1) + residential_m / greatest(distance_m, 1) + 0.25::DOUBLE * overlap, route_id) AS k FROM j JOIN s USING (o_custkey) WHERE route_id <> fr AND route_id <> sr) WHERE k = 1)
SELECT o_custkey, CASE WHEN route_id = fr THEN 'fastest' WHEN route_id = sr THEN 'reliable' ELSE 'balanced' END AS ranking, route_id, round_even(100 * overlap, 1) AS overlap_percent, round_even(100 * (residential_m / greatest(distance_m, 1)), 1) AS residential_percent
FROM j LEFT JOIN s USING (o_custkey) LEFT JOIN t USING (o_custkey) WHERE route_id = fr OR route_id = sr OR route_id = tr""")
def route_ranking(spark, sf_dir):
    o, p = read(spark, sf_dir, "orders"), paths(spark, sf_dir)
    k = F.col("o_orderkey")
    routes = o.join(p, k == p["l_orderkey"]).select("o_custkey", k.alias("route_id"), F.col("o_totalprice").alias("travel_seconds"), (10.0 * F.col("o_totalprice")).alias("distance_m"), (k % 97 * 1.0).alias("penalty_seconds"), (k % 89 * 100.0).alias("residential_m"), "edge_ids")
    return scenarios.rank_routes(routes, ["o_custkey"])


@query("distribution_summary", "SELECT s_nationkey, round_even(quantile_cont(s_acctbal / 7, 0.5), 3) AS median, round_even(quantile_cont(s_acctbal / 7, 0.85), 3) AS p85, round_even(quantile_cont(s_acctbal / 7, 0.95), 3) AS p95, round_even(max(s_acctbal / 7), 3) AS maximum FROM supplier GROUP BY 1")
def distribution_summary(spark, sf_dir):
    return scenarios.distribution(read(spark, sf_dir, "supplier").withColumn("value", F.col("s_acctbal") / 7), ["s_nationkey"], "value")


@query("closure_windows", """
WITH c AS (SELECT event_id, CASE WHEN event_id % 5 > 0 THEN epoch(ts) - epoch(TIMESTAMP '2024-01-10 07:00:00') + 900 ELSE 0 END AS b, CASE WHEN event_id % 7 > 0 THEN epoch(ts + INTERVAL 2 HOUR) - epoch(TIMESTAMP '2024-01-10 07:00:00') + 900 ELSE 864001 END AS e FROM events)
SELECT event_id, least(864001, greatest(0, trunc(b)::BIGINT)) AS begin_second, least(864001, greatest(0, trunc(e)::BIGINT)) AS end_second FROM c""")
def closure_windows(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    starts, ends = F.when(F.col("event_id") % 5 > 0, ts), F.when(F.col("event_id") % 7 > 0, ts + F.expr("INTERVAL 2 HOUR"))
    begin, end = scenarios.closure_window(starts, ends, F.lit("2024-01-10 07:00:00").cast("timestamp"), 900, 864000)
    return read(spark, sf_dir, "events").select("event_id", begin.cast("long").alias("begin_second"), end.cast("long").alias("end_second"))


@query("class_containment", """SELECT p_size, count(*) AS n, count(*) FILTER (WHERE list_contains(from_json('["' || p_brand || '", "' || p_type || '"]', '["VARCHAR"]'), 'Brand#11')) AS allowed FROM part GROUP BY 1""")
def class_containment(spark, sf_dir):
    classes = F.to_json(F.array("p_brand", "p_type"))
    return read(spark, sf_dir, "part").groupBy("p_size").agg(F.count("*").alias("n"), F.count_if(scenarios.allows(classes, "Brand#11")).alias("allowed"))


@query("campaign_chunks", """
WITH s AS (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-03-05', INTERVAL 7 DAY))::DATE AS a), h AS (SELECT s_suppkey AS highway_id FROM supplier)
SELECT 'highway-' || highway_id || '_' || a || '_' || least(a + 6, DATE '2024-03-05') || '_00-15-00' AS id, highway_id, a::VARCHAR AS start_date, least(a + 6, DATE '2024-03-05')::VARCHAR AS end_date, highway_id AS parsed,
  (SELECT count(*) FROM (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-03-05', INTERVAL 1 DAY))::DATE AS d) WHERE isodow(d) IN (2, 3, 4) AND d BETWEEN a AND least(a + 6, DATE '2024-03-05')) AS expected_days FROM h, s""")
def campaign_chunks(spark, sf_dir):
    highways = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("highway_id"))
    chunks = scenarios.date_chunks(spark, "2024-01-01", "2024-03-05", 7, (3, 4, 5), highways, "00:15:00")
    days = scenarios.expected_dates(spark, "2024-01-01", "2024-03-05", (2, 3, 4)).agg(F.collect_list("date").alias("days"))  # a row
    within = F.size(F.filter("days", lambda d: d.between(F.to_date("start_date"), F.to_date("end_date"))))
    return chunks.join(F.broadcast(days)).select("id", "highway_id", "start_date", "end_date", scenarios.highway_of_chunk(F.col("id")).alias("parsed"), within.cast("long").alias("expected_days"))


@query("path_validation", f"""
WITH p AS (SELECT l_orderkey AS path_id, edge_ids, CASE WHEN l_orderkey % 9 = 0 THEN len(edge_ids) ELSE len(edge_ids) + 1 END AS nodes FROM ({PATHS})), q AS (SELECT * FROM p UNION ALL SELECT * FROM p WHERE path_id % 50 = 1)
SELECT path_id, CASE WHEN nodes <> len(edge_ids) + 1 THEN 'sizes' WHEN count(*) OVER (PARTITION BY path_id) > 1 THEN 'repeated' END AS reason, len(edge_ids) + 2 AS with_ends FROM q""")
def path_validation(spark, sf_dir):
    p = paths(spark, sf_dir).withColumnRenamed("l_orderkey", "path_id")
    n = F.when(F.col("path_id") % 9 == 0, F.size("edge_ids")).otherwise(F.size("edge_ids") + 1)
    p = p.withColumn("node_ids", F.sequence(F.lit(1), n).cast("array<bigint>"))
    p = p.unionByName(p.where("path_id % 50 = 1"))
    zero = F.lit(0).cast("long")
    ended = scenarios.with_ends(scenarios.valid_paths(p), zero, zero, zero, zero)
    return ended.select("path_id", "reason", F.size("edge_ids").cast("long").alias("with_ends"))


@query("running_counters", """
SELECT event_id, count(*) FILTER (WHERE event_type = 'view') OVER w AS view_so_far, count(*) FILTER (WHERE event_type = 'click') OVER w AS click_so_far, max(value) OVER w AS progress
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def running_counters(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("progress", F.col("value"))
    return scenarios.running_counts(e, "user_id", ["ts", "event_id"], "event_type", ("view", "click")).select("event_id", "view_so_far", "click_so_far", "progress")


@query("flag_union", """
WITH e AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS a FROM events WHERE value > 100 GROUP BY 1), g AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS b FROM events WHERE value < 20 GROUP BY 1)
SELECT user_id, array_to_string(list_sort(list_distinct(list_concat(coalesce(a, []), coalesce(b, [])))), ',') AS flags FROM e FULL JOIN g USING (user_id)""")
def flag_union(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    part = lambda rows, name: rows.groupBy("user_id").agg(F.collect_set("event_type").alias(name))
    both = part(e.where("value > 100"), "a").join(part(e.where("value < 20"), "b"), "user_id", "full")
    return both.select("user_id", F.array_join(scenarios.flag_union(F.col("a"), F.col("b")), ",").alias("flags"))


@query("surface_and_class", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 1.35 ELSE 1 END::DOUBLE AS penalty FROM part WHERE p_size % 4 < 2")
def surface_and_class(spark, sf_dir):
    size = F.col("p_size")
    p = read(spark, sf_dir, "part").withColumns({"road_class": F.when(size % 4 == 0, "motorway").when(size % 4 == 1, "primary_link").otherwise("service"), "surface": F.when(size % 3 == 0, "gravel").otherwise("paved")})
    return scenarios.major_roads(p).select("p_partkey", scenarios.surface_penalty(F.col("surface")).alias("penalty"))
