"""Stored records on the benchmark tables: runs and their states, checked rows, routes as tables, scored matches."""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lanewright.operators import evidence, flows, matching, validate
from lanewright.sources import runs

from .registry import query
from .star_queries import r6, read

STATES = {"view": "queued", "click": "running", "purchase": "completed", "error": "failed"}
LOG = """SELECT * FROM (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_id, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS revision,
  CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'cancel_requested' END AS status FROM events) WHERE NOT (revision > 1 AND event_id % 7 = 0)"""


def log(spark, sf_dir):
    """A user's events of a day as the states of a run, some of them lost."""
    e = read(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    status = F.lit("cancel_requested")
    for kind, name in STATES.items():
        status = F.when(F.col("event_type") == kind, name).otherwise(status)
    w = Window.partitionBy("user_id", "day").orderBy("ts", "event_id")
    return e.select("user_id", "day", "event_id", F.row_number().over(w).alias("revision"), status.alias("status")).where("NOT (revision > 1 AND event_id % 7 = 0)")


@query("run_steps", f"""
WITH l AS (SELECT *, lag(status) OVER w AS before, lag(revision) OVER w AS r FROM ({LOG}) WINDOW w AS (PARTITION BY user_id, day ORDER BY revision)),
f AS (SELECT *, CASE WHEN r IS NULL THEN CASE WHEN status <> 'queued' THEN 'no start' END WHEN revision <> r + 1 THEN 'revision missing'
  WHEN (before, status) NOT IN (('queued', 'running'), ('queued', 'failed'), ('queued', 'cancel_requested'), ('running', 'completed'), ('running', 'failed'), ('running', 'cancel_requested'), ('cancel_requested', 'completed'), ('cancel_requested', 'failed')) THEN 'not allowed' END AS reason FROM l)
SELECT user_id, day, revision, status, before, reason FROM f WHERE reason IS NOT NULL""")
def run_steps(spark, sf_dir):
    return runs.broken_steps(log(spark, sf_dir), ["user_id", "day"])


@query("run_states", f"SELECT user_id, day, max(revision) AS revision, max_by(status, revision) AS status, max_by(event_id, revision) AS event_id FROM ({LOG}) GROUP BY user_id, day")
def run_states(spark, sf_dir):
    return runs.current(log(spark, sf_dir), ["user_id", "day"]).select("user_id", "day", "revision", "status", "event_id")


@query("first_statuses", "SELECT user_id, min_by(event_type, (ts, event_id)) AS status FROM events GROUP BY user_id")
def first_statuses(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("status"))
    return validate.first_status(e, ["user_id"], ["ts", "event_id"])


@query("trip_faults", """
WITH t AS (SELECT o_orderkey AS id, CASE WHEN isodow(o_orderdate) <= 4 THEN 'mon_thu' WHEN isodow(o_orderdate) = 5 THEN 'friday' WHEN isodow(o_orderdate) = 6 THEN 'saturday' END AS day_type, o_totalprice - 1500 AS seconds, o_custkey % 11 AS flag,
  o_orderstatus <> 'O' AS a, o_orderstatus <> 'O' AND o_orderkey % 13 > 0 AS b, o_orderstatus = 'O' OR o_orderkey % 17 = 0 AS c, o_orderstatus = 'O' AS d FROM orders)
SELECT id, broken FROM (SELECT id, array_to_string(list_filter([CASE WHEN day_type IS NULL THEN 'day_type is null' END, CASE WHEN NOT seconds > 0 THEN 'actual_travel_seconds' END,
  CASE WHEN flag NOT IN (0, 1) THEN 'incident_flag' END, CASE WHEN NOT ((a AND b AND NOT c AND NOT d) OR (NOT a AND NOT b AND c AND d)) THEN 'ends' END], lambda x: x IS NOT NULL), ',') AS broken FROM t) WHERE broken <> ''""")
def trip_faults(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    day, zone = F.weekday("o_orderdate"), F.col("o_orderstatus") == "O"
    name = F.col("o_custkey").cast("string")
    trips = o.select(
        F.col("o_orderkey").alias("id"), F.lit("g1").alias("graph_version"), F.col("o_orderdate").cast("string").alias("departure_time"),
        F.when(day <= 3, "mon_thu").when(day == 4, "friday").when(day == 5, "saturday").alias("day_type"),
        F.col("o_orderpriority").alias("corridor_label"), (F.col("o_totalprice") - 1500).alias("actual_travel_seconds"), (F.col("o_custkey") % 11).alias("incident_flag"),
        F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("updated_at"),
        F.when(~zone, name).alias("origin_node"), F.when(~zone & (F.col("o_orderkey") % 13 > 0), name).alias("destination_node"),
        F.when(zone | (F.col("o_orderkey") % 17 == 0), name).alias("origin_zone"), F.when(zone, name).alias("destination_zone"),
    )
    return validate.stored_faults(trips, "benchmark_trips").select("id", F.array_join("_broken", ",").alias("broken"))


@query("route_summaries", """
WITH l AS (SELECT DISTINCT ON (l_orderkey, l_linenumber, l_suppkey, l_partkey) *, l_suppkey % 40 AS u, l_partkey % 50 AS v, l_quantity * 100 AS length, l_extendedprice / 100 AS t, l_extendedprice / 100 * (1.02 - l_tax) AS c FROM lineitem ORDER BY l_extendedprice, l_quantity, l_tax, l_returnflag),
e AS (SELECT *, concat_ws('-', l_orderkey, l_linenumber, l_suppkey, l_partkey) AS edge_id, CASE WHEN l_returnflag = 'R' THEN t * 3 WHEN l_returnflag = 'A' THEN greatest(t, length / (30.0 / 3.6)) ELSE t END AS et,
  CASE WHEN l_returnflag = 'R' THEN c * 3 WHEN l_returnflag = 'A' THEN greatest(t, length / (30.0 / 3.6)) * c / t ELSE c END AS ec FROM l WHERE l_linenumber > 1),
b AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY u, v ORDER BY ec, edge_id) = 1),
s AS (SELECT l.l_orderkey AS route_id, row_number() OVER (PARTITION BY l.l_orderkey ORDER BY l.l_linenumber, l.l_suppkey, l.l_partkey) AS position, l.u, l.v, b.edge_id, b.length, b.et, greatest(0, b.c - b.t) AS p, CASE WHEN b.l_linenumber % 3 = 0 THEN b.length ELSE 0 END AS res,
  '"' || concat_ws(':', l.u, l.v, b.l_linenumber, b.edge_id, CASE b.l_returnflag WHEN 'R' THEN 'lane:1:None' WHEN 'A' THEN 'speed:None:30.0' ELSE 'baseline' END) || '"' AS i FROM l LEFT JOIN b ON l.u = b.u AND l.v = b.v),
r AS (SELECT route_id, count(*) FILTER (edge_id IS NULL) AS missing, sum(length) AS d, sum(et) AS t, sum(res) AS res, sum(p) AS p, sha256('["g1","' || min_by(u, position) || '","' || max_by(v, position) || '",[' || string_agg(i, ',' ORDER BY position) || ']]')[:20] AS h FROM s GROUP BY route_id)
SELECT route_id, missing, CASE WHEN missing = 0 THEN round_even(d, 6) END AS distance, CASE WHEN missing = 0 THEN round_even(t, 6) END AS seconds, CASE WHEN missing = 0 THEN round_even(res, 6) END AS residential, CASE WHEN missing = 0 THEN round_even(p, 6) END AS penalty, CASE WHEN missing = 0 THEN h END AS route_hash FROM r""")
def route_summaries(spark, sf_dir):
    key = ["l_orderkey", "l_linenumber", "l_suppkey", "l_partkey"]
    # Dealt by route once, to as many tasks as there are rows for: neither the rows of a key nor the steps of a route move again.
    li = read(spark, sf_dir, "lineitem")
    li = li.repartition(math.ceil(li.count() / 500_000) or 1, "l_orderkey").groupBy(*key).agg(F.min(F.struct("l_extendedprice", "l_quantity", "l_tax", "l_returnflag")).alias("r")).select(*key, "r.*")
    li = li.withColumns({"u": F.col("l_suppkey") % 40, "v": F.col("l_partkey") % 50})
    price, kind = F.col("l_extendedprice") / 100, F.col("l_returnflag")
    edges = li.where("l_linenumber > 1").select(
        "u", "v", F.col("l_linenumber").alias("parallel"), F.concat_ws("-", *key).alias("edge_id"), (F.col("l_quantity") * 100).alias("length_m"), price.alias("free_flow_seconds"), (price * (1.02 - F.col("l_tax"))).alias("cost"),
        F.lit(3).alias("lanes"), F.when(F.col("l_linenumber") % 3 == 0, "residential").otherwise("primary").alias("road_class"),
        F.when(kind == "R", "lane").when(kind == "A", "speed").alias("restriction"), F.when(kind == "R", 1).alias("remaining_lanes"), F.when(kind == "A", 30.0).alias("limit_kph"))
    steps = li.select(F.col("l_orderkey").alias("route_id"), F.struct("l_linenumber", "l_suppkey", "l_partkey").alias("position"), "u", "v")
    out = flows.route_summary(steps, edges, "g1")
    return out.select("route_id", "missing", r6("distance_m", "distance"), r6("travel_time_seconds", "seconds"), r6("residential_distance_m", "residential"), r6("penalty_seconds", "penalty"), "route_hash")


@query("station_match_scores", """
WITH s AS (SELECT s_suppkey AS station_id, s_acctbal AS x, (s_suppkey % 23) * 40.0 AS y, (s_suppkey * 53 % 360)::DOUBLE AS tb, CASE s_suppkey % 3 WHEN 0 THEN 'unknown' WHEN 1 THEN 'link' ELSE 'mainline' END AS road_form, CASE WHEN s_suppkey % 4 = 0 THEN []::VARCHAR[] ELSE ['BUILDING', 'MACHINERY'] END AS tt FROM supplier),
e AS (SELECT c_custkey AS edge_id, c_acctbal AS ox, (c_custkey % 23) * 40.0 AS oy, (c_custkey * 37 % 360)::DOUBLE AS bearing, CASE WHEN c_custkey % 7 = 0 THEN []::VARCHAR[] ELSE [c_mktsegment] END AS tokens, CASE c_custkey % 5 WHEN 0 THEN 'motorway' WHEN 1 THEN 'motorway_link' WHEN 2 THEN 'trunk' WHEN 3 THEN 'primary_link' ELSE 'residential' END AS road_class FROM customer),
q AS (SELECT *, sqrt((x - ox) * (x - ox) + (y - oy) * (y - oy)) AS distance, abs(((bearing - tb + 180) % 360 + 360) % 360 - 180) AS turn,
  CASE WHEN len(tokens) > 0 AND len(tt) > 0 THEN CASE WHEN list_has_any(tokens, tt) THEN 'match' ELSE 'mismatch' END ELSE 'unknown' END AS route,
  CASE WHEN road_form = 'unknown' THEN 'unknown' WHEN (road_form = 'link') = ends_with(road_class, '_link') THEN 'match' ELSE 'mismatch' END AS form FROM s JOIN e ON abs(x - ox) <= 250 AND abs(y - oy) <= 250),
k AS (SELECT *, round_even(greatest(0.0, 42 * (1 - distance / 250)) + 34 * (1 - turn / 90) + CASE route WHEN 'match' THEN 32 WHEN 'mismatch' THEN -36 ELSE 0 END + CASE form WHEN 'match' THEN 10 WHEN 'mismatch' THEN -10 ELSE 0 END
  + CASE road_class WHEN 'motorway' THEN 8 WHEN 'trunk' THEN 7 WHEN 'motorway_link' THEN 6 WHEN 'primary_link' THEN 1 ELSE -10 END, 3) AS score FROM q WHERE distance <= 250),
n AS (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY score DESC, distance, edge_id) AS rk FROM k),
m AS (SELECT b.*, (SELECT max(o.score) FROM n o WHERE o.station_id = b.station_id AND o.rk > 1 AND NOT (ends_with(o.road_class, '_link') = ends_with(b.road_class, '_link') AND NOT (len(o.tokens) > 0 AND len(b.tokens) > 0 AND NOT list_has_any(o.tokens, b.tokens)) AND abs(((o.bearing - b.bearing + 180) % 360 + 360) % 360 - 180) <= 25)) AS rival FROM n b WHERE rk = 1),
z AS (SELECT *, array_to_string(list_filter([CASE WHEN distance > 100 THEN 'distance_over_limit' END, CASE WHEN turn > 55 THEN 'bearing_over_limit' END, CASE WHEN route = 'mismatch' THEN 'route_reference_mismatch' END, CASE WHEN form = 'mismatch' THEN 'road_form_mismatch' END,
  CASE WHEN score < 45 THEN 'low_score' END, CASE WHEN score - rival < 8 THEN 'ambiguous_competing_edge' END], lambda r: r IS NOT NULL), '|') AS reasons FROM m)
SELECT station_id, edge_id, round_even(distance, 6) AS distance, score, round_even(score - rival, 3) AS margin, reasons, CASE WHEN reasons = '' THEN 'accepted' ELSE 'review' END AS status FROM z""")
def station_match_scores(spark, sf_dir):
    s, c = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "customer")
    empty = F.array().cast("array<string>")
    form, road = F.col("s_suppkey") % 3, F.col("c_custkey") % 5
    stations = s.select(F.col("s_suppkey").alias("station_id"), F.col("s_acctbal").alias("x"), (F.col("s_suppkey") % 23 * 40.0).alias("y"), (F.col("s_suppkey") * 53 % 360).cast("double").alias("target_bearing"),
                        F.when(form == 0, "unknown").when(form == 1, "link").otherwise("mainline").alias("road_form"), F.when(F.col("s_suppkey") % 4 == 0, empty).otherwise(F.array(F.lit("BUILDING"), F.lit("MACHINERY"))).alias("target_tokens"))
    edges = c.select(F.col("c_custkey").alias("edge_id"), F.col("c_acctbal").alias("ox"), (F.col("c_custkey") % 23 * 40.0).alias("oy"), (F.col("c_custkey") * 37 % 360).cast("double").alias("bearing"), F.when(F.col("c_custkey") % 7 == 0, empty).otherwise(F.array("c_mktsegment")).alias("tokens"),
                     F.when(road == 0, "motorway").when(road == 1, "motorway_link").when(road == 2, "trunk").when(road == 3, "primary_link").otherwise("residential").alias("road_class"))
    best = matching.match_stations(stations, edges)
    return best.select("station_id", "edge_id", r6("distance"), "score", F.bround("margin", 3).alias("margin"), F.array_join("reasons", "|").alias("reasons"), "status")


@query("missing_dates", """
WITH e AS (SELECT unnest(generate_series(DATE '1992-01-01', DATE '1998-12-31', INTERVAL 1 DAY))::DATE AS day), x AS (SELECT day FROM e WHERE isodow(day) BETWEEN 2 AND 6),
m AS (SELECT day FROM x WHERE day NOT IN (SELECT o_orderdate::DATE FROM orders))
SELECT 'medium' AS severity, 'missing_campaign_dates' AS name, count(*) AS n, round_even(100.0 * count(*) / (SELECT count(*) FROM x), 4) AS rate_percent, array_to_string(list(strftime(day, '%Y-%m-%d') ORDER BY day)[1:20], ' ') AS examples FROM m HAVING count(*) > 0""")
def missing_dates(spark, sf_dir):
    found = evidence.missing_dates(read(spark, sf_dir, "orders"), "o_orderdate", "1992-01-01", "1998-12-31", (2, 3, 4, 5, 6))
    return found.withColumn("examples", F.array_join(F.transform("examples", lambda d: d.cast("string")), " "))


@query("preset_faults", """
WITH g AS (SELECT l_suppkey AS u, l_partkey AS v, l_linenumber AS p, min(l_orderkey) AS edge_id, max(l_returnflag) AS shape FROM lineitem GROUP BY 1, 2, 3),
s AS (SELECT DISTINCT ON (l_orderkey, l_linenumber) l_orderkey, l_linenumber, l_suppkey AS u, l_partkey AS v, CASE WHEN l_tax < 0.02 THEN '' ELSE l_returnflag END AS shape, l_tax FROM lineitem ORDER BY l_orderkey, l_linenumber, l_suppkey, l_partkey, l_tax, l_returnflag),
f AS (SELECT l_orderkey AS preset_id, l_linenumber AS section_id, l_orderkey AS edge_id, CASE WHEN l_tax > 0.07 THEN 'no snapshot' WHEN g.edge_id IS NULL THEN 'no edge' WHEN g.edge_id <> l_orderkey THEN 'another edge' WHEN s.shape <> '' AND s.shape <> g.shape THEN 'another shape' END AS reason
  FROM s LEFT JOIN g ON s.u = g.u AND s.v + CASE WHEN l_tax BETWEEN 0.055 AND 0.065 THEN 1000000 ELSE 0 END = g.v AND s.l_linenumber = g.p)
SELECT * FROM f WHERE reason IS NOT NULL""")
def preset_faults(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    edges = li.groupBy(F.col("l_suppkey").alias("u"), F.col("l_partkey").alias("v"), F.col("l_linenumber").alias("parallel")).agg(F.min("l_orderkey").alias("edge_id"), F.max("l_returnflag").alias("fingerprint"))
    one = li.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_suppkey", "l_partkey", "l_tax", "l_returnflag")).alias("r")).select("l_orderkey", "l_linenumber", "r.*")
    key = [F.col("l_orderkey").alias("preset_id"), F.col("l_linenumber").alias("section_id"), F.col("l_orderkey").alias("edge_id")]
    moved = F.col("l_partkey") + F.when(F.col("l_tax").between(0.055, 0.065), 1000000).otherwise(0)
    shape = F.when(F.col("l_tax") < 0.02, "").otherwise(F.col("l_returnflag"))
    snapshots = one.where("l_tax <= 0.07").select(*key, F.col("l_suppkey").alias("u"), moved.alias("v"), F.col("l_linenumber").alias("parallel"), shape.alias("fingerprint"))
    return evidence.preset_faults(one.select(*key), snapshots, edges)
