"""Paths on a network of the benchmark tables: suppliers as nodes, what follows each other in an order as edges, nations as gateways."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lanewright.operators import od, paths

from .registry import query
from .star_queries import r6, read

#: edges (u, v, edge_id, c): the cheapest of all lines that are followed by one of another supplier in their order.
EDGES_SQL = """
lines AS (SELECT l_suppkey AS u, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS v, l_extendedprice::DOUBLE / 100 AS c, l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR || '-' || l_partkey::VARCHAR AS edge_id FROM lineitem),
g AS MATERIALIZED (SELECT u, v, min(c) AS c, arg_min(edge_id, (c, edge_id)) AS edge_id FROM lines WHERE u <> v GROUP BY u, v)"""
#: From src (key, node, cost): costs by number of edges, the cheapest, and the edge by which each node is reached.
SEARCH_SQL = """
walk AS (SELECT key, node, cost, 0 AS h FROM src UNION ALL SELECT key, v, min(cost + c), h + 1 FROM walk JOIN g ON u = node WHERE h < 24 GROUP BY key, v, h),
best AS MATERIALIZED (SELECT key, node, min(cost) AS cost FROM walk GROUP BY key, node),
via AS MATERIALIZED (SELECT b.key, b.node, arg_min(p.node, (p.cost + g.c, p.node)) AS prev, arg_min(g.edge_id, (p.cost + g.c, p.node)) AS edge_id
  FROM best b JOIN g ON g.v = b.node JOIN best p ON p.key = b.key AND p.node = g.u WHERE p.cost + g.c = b.cost GROUP BY b.key, b.node)"""


def edges(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    # Only the five columns move; names and costs are made behind the window.
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").withColumn("v", F.lead("l_suppkey").over(w)).where("l_suppkey <> v")
    name = F.concat_ws("-", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey")))
    return lines.select(F.col("l_suppkey").alias("u"), "v", name.alias("edge_id"), (F.col("l_extendedprice").cast("double") / 100).alias("cost"))


def zones(spark, sf_dir):
    """The richest supplier of each nation as a zone, its place on a plane from its keys."""
    s = read(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.max_by(F.struct("s_suppkey", "s_acctbal"), F.struct("s_acctbal", "s_suppkey")).alias("s"))
    return s.select(F.concat(F.lit("zone-"), F.col("s_nationkey").cast("string")).alias("zone_id"), F.col("s.s_suppkey").alias("node_id"), (F.col("s_nationkey") * 2500.0).alias("x"), (F.pmod("s.s_suppkey", F.lit(7)) * 1500.0).alias("y"), (F.col("s.s_acctbal").cast("double") / 100 + 10).alias("activity"))


def gateways(spark, sf_dir):
    """Nations whose first supplier is where their traffic comes in and whose last one is where it goes out."""
    s = read(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.min("s_suppkey").alias("first"), F.max("s_suppkey").alias("last"))
    n = read(spark, sf_dir, "nation").join(s, F.col("n_nationkey") == F.col("s_nationkey")).where("n_nationkey % 3 = 0")
    out = lambda tag: F.concat(F.lit(tag), F.col("n_name"))
    return n.select(F.col("n_name").alias("gateway_id"), (F.col("n_nationkey") * 4000.0).alias("x"), F.lit(-9000.0).alias("y"), (F.col("n_regionkey") + 20.0).alias("activity"),
        out("in-").alias("inbound_edge_id"), F.col("first").alias("inbound_interior_node_id"), out("beyond-").alias("inbound_exterior_node_id"), (F.col("n_nationkey") + 1.5).alias("inbound_cost_seconds"),
        out("out-").alias("outbound_edge_id"), F.col("last").alias("outbound_interior_node_id"), out("beyond-").alias("outbound_exterior_node_id"), (F.col("n_nationkey") + 2.5).alias("outbound_cost_seconds"))


@query("gateway_paths", f"""
WITH RECURSIVE {EDGES_SQL},
zone AS (SELECT 'zone-' || s_nationkey::VARCHAR AS id, arg_max(s_suppkey, (s_acctbal, s_suppkey)) AS node, max(s_acctbal)::DOUBLE / 100 + 10 AS activity, s_nationkey * 2500.0::DOUBLE AS x FROM supplier GROUP BY s_nationkey),
gate AS (SELECT n_name AS id, n_nationkey * 4000.0::DOUBLE AS x, -9000.0::DOUBLE AS y, n_regionkey + 20.0::DOUBLE AS activity, min(s_suppkey) AS first, max(s_suppkey) AS last, n_nationkey + 1.5::DOUBLE AS c_in, n_nationkey + 2.5::DOUBLE AS c_out
  FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE n_nationkey % 3 = 0 GROUP BY ALL),
src AS (SELECT node AS key, node, 0.0::DOUBLE AS cost FROM zone UNION SELECT first, first, 0.0 FROM gate), {SEARCH_SQL},
ends AS (
  SELECT 'internal' AS kind, id, node AS start, node AS stop, x, (node % 7) * 1500.0::DOUBLE AS y, activity, node::VARCHAR AS from_node, node::VARCHAR AS to_node, []::VARCHAR[] AS n_in, []::VARCHAR[] AS e_in, []::VARCHAR[] AS n_out, []::VARCHAR[] AS e_out, 0.0::DOUBLE AS c_in, 0.0::DOUBLE AS c_out FROM zone
  UNION ALL SELECT 'gateway', id, first, last, x, y, activity, 'beyond-' || id, 'beyond-' || id, ['beyond-' || id], ['in-' || id], ['beyond-' || id], ['out-' || id], c_in, c_out FROM gate),
pair AS (
  SELECT o.kind || '_' || d.kind AS movement_class, o.id AS o, d.id AS d, o.start, d.stop, sqrt((o.x - d.x) ** 2 + (o.y - d.y) ** 2) AS dist, o.activity AS oa, d.activity AS da, o.n_in, o.e_in, d.n_out, d.e_out, o.c_in, d.c_out,
    CASE WHEN o.kind || d.kind = 'internalinternal' THEN '' ELSE o.kind || '_' || d.kind || '|' END || o.id || '|' || d.id AS tag
  FROM ends o, ends d WHERE (o.kind, o.id) <> (d.kind, d.id) AND (o.kind || d.kind <> 'internalinternal' OR sqrt((o.x - d.x) ** 2 + (o.y - d.y) ** 2) BETWEEN 3000 AND 55000)),
back AS (SELECT DISTINCT start AS key, stop AS stop, stop AS node, []::BIGINT[] AS nodes, []::VARCHAR[] AS ids FROM pair WHERE (start, stop) IN (SELECT (key, node) FROM best)
  UNION ALL SELECT b.key, b.stop, v.prev, list_prepend(b.node, b.nodes), list_prepend(v.edge_id, b.ids) FROM back b JOIN via v ON v.key = b.key AND v.node = b.node WHERE b.node <> b.key),
leg AS (SELECT key, stop, list_prepend(key, nodes) AS nodes, ids FROM back WHERE node = key)
SELECT left(sha256(tag), 20) AS pair_id, movement_class, o AS origin_zone, d AS destination_zone, round_even(dist, 6) AS distance, round_even(c_in + b.cost + c_out, 6) AS seconds, round_even(sqrt(oa * da) / greatest(dist / 1000, 1) ** 1.15, 6) AS weight,
  array_to_string(list_concat(list_concat(n_in, list_transform(leg.nodes, lambda n: n::VARCHAR)), n_out), ' ') AS nodes, array_to_string(list_concat(list_concat(e_in, leg.ids), e_out), ' ') AS edges
FROM pair JOIN leg ON leg.key = start AND leg.stop = pair.stop JOIN best b ON b.key = start AND b.node = pair.stop""")
def gateway_paths(spark, sf_dir):
    p = paths.gateway_paths(edges(spark, sf_dir), zones(spark, sf_dir), gateways(spark, sf_dir))
    return p.select("pair_id", "movement_class", "origin_zone", "destination_zone", r6("straight_distance_m", "distance"), r6("route_free_flow_seconds", "seconds"), r6("prior_weight", "weight"), F.array_join("node_ids", " ").alias("nodes"), F.array_join("edge_ids", " ").alias("edges"))


def trips(spark, sf_dir, e):
    """For each nation the cheapest of edges (u, v, edge_id, _c) out of its suppliers as origins, those of the next region's dearest as destinations."""
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("u"), "s_nationkey")
    own = e.groupBy("u").agg(F.min("_c").alias("low"), F.max("_c").alias("high")).join(s, "u").checkpoint()

    def ends(most, asc, name):
        # The nation's supplier that is the last by its own best edge bounds what counts, so edges stay where they are but few; with fewer suppliers all count.
        by = lambda *names: Window.partitionBy("s_nationkey").orderBy(*(F.col(c).asc() if asc else F.col(c).desc() for c in names))
        best, near = ("low", lambda c: F.col(c) <= F.col("last")) if asc else ("high", lambda c: F.col(c) >= F.col("last"))
        last = own.withColumn("rank", F.row_number().over(by(best))).groupBy("s_nationkey").agg(F.max(F.when(F.col("rank") == most, F.col(best))).alias("last"))
        some = own.join(last, "s_nationkey").where(F.col("last").isNull() | near(best)).select("u", "s_nationkey", "last")
        out = e.join(paths.few(some), "u").where(F.col("last").isNull() | near("_c")).select("s_nationkey", F.col("_c").alias("cost"), "edge_id")
        top = out.withColumn("rank", F.row_number().over(by("cost", "edge_id"))).where(F.col("rank") <= most)
        return top.groupBy("s_nationkey").agg(F.sort_array(F.collect_list(F.struct("rank", "edge_id"))).alias(name))

    other = ends(3, False, "m").select(F.pmod(F.col("s_nationkey") + 24, F.lit(25)).alias("s_nationkey"), "m")
    return ends(4, True, "l").join(other, "s_nationkey").select(F.col("s_nationkey").alias("trip"), F.col("l.edge_id").alias("origins"), F.col("m.edge_id").alias("destinations"))


@query("cheapest_between", f"""
WITH RECURSIVE {EDGES_SQL},
ranked AS (SELECT s_nationkey AS n, g.*, row_number() OVER (PARTITION BY s_nationkey ORDER BY c, edge_id) AS lo, row_number() OVER (PARTITION BY s_nationkey ORDER BY c DESC, edge_id DESC) AS hi FROM g JOIN supplier ON s_suppkey = u),
o AS (SELECT n AS key, v AS node, c, edge_id, lo AS place FROM ranked WHERE lo <= 4 AND (n + 1) % 25 IN (SELECT n FROM ranked)),
d AS (SELECT (n + 24) % 25 AS key, u AS node, c, edge_id, hi AS place FROM ranked WHERE hi <= 3),
walk AS (SELECT key, place, node, c AS cost, 0 AS h FROM o UNION ALL SELECT key, place, v, min(cost + g.c), h + 1 FROM walk JOIN g ON u = node WHERE h < 24 GROUP BY key, place, v, h),
best AS (SELECT key, place, node, min(cost) AS cost FROM walk GROUP BY ALL),
routes AS (SELECT o.key, o.place AS first, d.place AS last, o.edge_id AS origin_edge, d.edge_id AS destination_edge, CASE WHEN o.edge_id = d.edge_id THEN o.c ELSE b.cost + d.c END AS cost
  FROM o JOIN d ON d.key = o.key JOIN best b ON b.key = o.key AND b.place = o.place AND b.node = d.node)
SELECT key AS trip, arg_min(origin_edge, (cost, first, last)) AS origin_edge, arg_min(destination_edge, (cost, first, last)) AS destination_edge, round_even(min(cost), 6) AS cost, true AS fits FROM routes GROUP BY key""")
def cheapest_between(spark, sf_dir):
    # All edges that are named, searched or added up are the cheapest of their ends, so one table serves.
    with paths.stored(edges(spark, sf_dir), best=True) as e:
        r = paths.cheapest_between(e, trips(spark, sf_dir, e), "_c", e).checkpoint()
        # The route's edges, added up, must give its cost; there are as many routes as nations.
        steps = F.broadcast(r.select("trip", F.explode("edge_ids").alias("edge_id")))
        sums = e.select("edge_id", F.col("_c").alias("c")).join(steps, "edge_id").groupBy("trip").agg(F.sum("c").alias("sum"))
        return r.join(sums, "trip").select("trip", "origin_edge", "destination_edge", r6("cost"), (F.abs(F.col("sum") - F.col("cost")) < 1e-6).alias("fits")).checkpoint()


@query("route_checks", f"""
WITH RECURSIVE {EDGES_SQL}, src AS (SELECT n_nationkey AS key, n_nationkey + 1 AS node, 0.0::DOUBLE AS cost FROM nation), {SEARCH_SQL},
nodes AS (SELECT u AS n FROM g UNION SELECT v FROM g)
SELECT n_name AS name, b.cost IS NOT NULL AND n_nationkey + 1 IN (FROM nodes) AS success, CASE WHEN n_nationkey + 1 IN (FROM nodes) THEN round_even(b.cost, 1) END AS travel_time_seconds,
  CASE WHEN n_nationkey + 1 NOT IN (FROM nodes) OR 8 * n_regionkey + 3 NOT IN (FROM nodes) THEN 'NodeNotFound' WHEN b.cost IS NULL THEN 'NetworkXNoPath' END AS reason
FROM nation LEFT JOIN best b ON b.key = n_nationkey AND b.node = 8 * n_regionkey + 3""")
def route_checks(spark, sf_dir):
    routes = read(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), (F.col("n_nationkey") + 1).cast("long").alias("origin"), (8 * F.col("n_regionkey") + 3).cast("long").alias("destination"))
    return paths.check_routes(edges(spark, sf_dir), routes)


@query("band_pairs_2d", """
SELECT a.c_custkey AS a, b.c_custkey AS b, round_even(sqrt((a.c_acctbal::DOUBLE - b.c_acctbal::DOUBLE) ** 2 + ((a.c_custkey % 997) * 10.0::DOUBLE - (b.c_custkey % 997) * 10.0::DOUBLE) ** 2), 6) AS distance
FROM customer a JOIN customer b ON a.c_custkey <> b.c_custkey AND a.c_mktsegment = b.c_mktsegment AND a.c_nationkey = b.c_nationkey WHERE sqrt((a.c_acctbal::DOUBLE - b.c_acctbal::DOUBLE) ** 2 + ((a.c_custkey % 997) * 10.0::DOUBLE - (b.c_custkey % 997) * 10.0::DOUBLE) ** 2) BETWEEN 150 AND 1200""")
def band_pairs_2d(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey", F.col("c_acctbal").cast("double").alias("x"), (F.pmod("c_custkey", F.lit(997)) * 10.0).alias("y"))
    return paths.pairs_in_band(c, 150, 1200, "c_custkey", ("c_mktsegment", "c_nationkey")).select(F.col("a.c_custkey").alias("a"), F.col("b.c_custkey").alias("b"), r6("distance"))


@query("gravity_band_pairs", """
SELECT a.c_custkey AS a, b.c_custkey AS b, round_even(greatest(1e-9, sqrt(a.c_acctbal * b.c_acctbal) / pow(greatest(abs(a.c_acctbal - b.c_acctbal), 1.0), 1.15)), 6) AS weight
FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment AND a.c_custkey < b.c_custkey AND abs(a.c_acctbal - b.c_acctbal) BETWEEN 3 AND 55 WHERE a.c_acctbal > 0 AND b.c_acctbal > 0""")
def gravity_band_pairs(spark, sf_dir):
    c = read(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment")
    p = paths.pairs_in_band(c, 3, 55, "c_custkey", ("c_nationkey", "c_mktsegment"), x="c_acctbal", y=None).where("a.c_custkey < b.c_custkey")
    return p.select(F.col("a.c_custkey").alias("a"), F.col("b.c_custkey").alias("b"), F.bround(od.gravity(F.col("a.c_acctbal"), F.col("b.c_acctbal"), F.col("distance")), 6).alias("weight"))
