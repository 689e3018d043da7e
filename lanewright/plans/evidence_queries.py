"""Operators of evidence on the benchmark tables: orders as paths, parts as edges and matches, events as reports."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lanewright.functions import geo, hashing
from lanewright.operators import evidence, frames

from .registry import query
from .star_queries import r6, read

CLASSES = ("motorway", "motorway_link", "trunk", "primary", "secondary", "tertiary", "unclassified", "residential", "service")
URL_NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


@query("approach_edges", """
WITH p AS (SELECT l_orderkey, l_partkey AS edge_id, 100.0 * sum(l_quantity) AS length, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS pos FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey),
s AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY l_orderkey ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, edge_id IN (SELECT p_partkey FROM part WHERE p_size = 1) AS shut FROM p),
d AS (SELECT a.l_orderkey, a.pos, a.edge_id, c.pos AS shut_pos, c.before - a.before AS distance FROM s c JOIN s a ON a.l_orderkey = c.l_orderkey AND a.pos < c.pos WHERE c.shut)
SELECT max_by(edge_id, pos) AS edge_id FROM d, (SELECT unnest([500.0, 3000.0, 8000.0, 15000.0, 25000.0]) AS least) WHERE distance >= least GROUP BY l_orderkey, shut_pos, least
UNION SELECT edge_id FROM s WHERE pos = 1 AND l_orderkey IN (SELECT l_orderkey FROM s WHERE shut) UNION SELECT p_partkey FROM part WHERE p_size = 1""")
def approach_edges(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber", F.col("l_partkey").alias("edge_id")).agg((100.0 * F.sum("l_quantity")).alias("length"))
    steps = lines.withColumn("position", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "edge_id")))
    closed = read(spark, sf_dir, "part").where("p_size = 1").select(F.col("p_partkey").alias("edge_id"))
    return evidence.approach_edges(steps, closed, "l_orderkey")


@query("class_acceptance", """
SELECT p_brand, count(*) AS total, count(*) FILTER (WHERE p_size > 10) AS accepted, round_even(100.0 * count(*) FILTER (WHERE p_size > 10) / count(*), 3) AS accepted_percent,
  (list(p_partkey ORDER BY p_retailprice DESC, p_partkey) FILTER (WHERE p_size > 10))[1] AS representative FROM part GROUP BY 1""")
def class_acceptance(spark, sf_dir):
    matches = read(spark, sf_dir, "part").withColumn("status", F.when(F.col("p_size") > 10, "accepted").otherwise("review"))
    return evidence.class_acceptance(matches, "p_brand", "p_partkey", "p_retailprice")


@query("quality_findings", """
WITH t AS (SELECT count(*) AS n, (SELECT coalesce(sum(k - 1), 0)::BIGINT FROM (SELECT count(*) AS k FROM lineitem GROUP BY l_orderkey, l_linenumber)) AS dup, count(*) FILTER (WHERE l_shipdate < DATE '1995-01-01') AS early,
  count(*) FILTER (WHERE l_discount > 0.09) AS speed, count(*) FILTER (WHERE l_quantity < 0) AS volume, count(*) FILTER (WHERE l_quantity = 1) AS low FROM lineitem)
SELECT severity, name, k AS n, round_even(100.0 * k / greatest(t.n, 1), 4) AS rate_percent FROM t, LATERAL (VALUES ('high', 'duplicate_grain', dup), ('high', 'invalid_or_out_of_window_timestamps', early), ('medium', 'missing_or_invalid_speed', speed),
  ('medium', 'missing_or_invalid_volume', volume), ('low', 'low_sample_rows', low)) AS v(severity, name, k) WHERE k > 0""")
def quality_findings(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem")
    keys = lines.groupBy("l_orderkey", "l_linenumber").agg(
        F.count("*").alias("k"), F.count_if(F.col("l_shipdate") < F.lit("1995-01-01").cast("timestamp")).alias("early"), F.count_if(F.col("l_discount") > 0.09).alias("speed"),
        F.count_if(F.col("l_quantity") < 0).alias("volume"), F.count_if(F.col("l_quantity") == 1).alias("low"))
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    totals = keys.agg(total(F.col("k"), "rows"), total(F.col("k") - 1, "duplicate_keys"), total(F.col("early"), "outside_chunk_dates"), total(F.col("speed"), "invalid_speed"), total(F.col("volume"), "invalid_volume"), total(F.col("low"), "low_sample"))
    return evidence.findings(totals)


@query("trip_deltas", """
SELECT l_partkey, round_even(sum(l_quantity) FILTER (WHERE l_returnflag = 'R') - sum(l_quantity) FILTER (WHERE l_returnflag = 'N'), 3) AS quantity FROM lineitem WHERE l_returnflag IN ('R', 'N') GROUP BY 1""")
def trip_deltas(spark, sf_dir):
    of = lambda flag: read(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == flag).groupBy("l_partkey").agg(F.sum("l_quantity").alias("quantity"))
    return evidence.deltas(of("N"), of("R"), ["l_partkey"], ["quantity"])


@query("zone_connectors", f"""
WITH r AS (SELECT p_partkey % 2 = 0 AS inner_zone, {list(CLASSES)}[1 + p_partkey % {len(CLASSES)}] AS road_class FROM part)
SELECT inner_zone, road_class, count(*) AS n FROM r WHERE CASE WHEN inner_zone THEN road_class IN ('motorway_link', 'trunk', 'primary', 'secondary', 'tertiary', 'unclassified') ELSE road_class IN ('motorway', 'motorway_link', 'trunk', 'primary') END GROUP BY 1, 2""")
def zone_connectors(spark, sf_dir):
    k = F.col("p_partkey")
    r = read(spark, sf_dir, "part").select((k % 2 == 0).alias("inner_zone"), F.get(F.array(*map(F.lit, CLASSES)), (k % len(CLASSES)).cast("int")).alias("road_class"))
    return r.where(evidence.connects(F.when(F.col("inner_zone"), "internal").otherwise("external"), F.col("road_class"))).groupBy("inner_zone", "road_class").agg(F.count("*").alias("n"))


@query("private_fields", """
WITH j AS (SELECT CASE WHEN event_id % 7 = 0 THEN '{"trip": [{"LAT": 1, "name": "lng", "address" : "x"}], "of": ' || coalesce(props, 'null') || '}' ELSE props END AS body FROM events),
k AS (SELECT list_sort(list_distinct(list_filter(regexp_extract_all(lower(coalesce(body, '')), '"([^"]*)"\\s*:', 1), lambda x: x IN ('address', 'origin_address', 'destination_address', 'lat', 'lng', 'latitude', 'longitude', 'coordinates')))) AS ks FROM j)
SELECT array_to_string(ks, ',') AS found, count(*) AS n FROM k GROUP BY 1""")
def private_fields(spark, sf_dir):
    nested = F.concat(F.lit('{"trip": [{"LAT": 1, "name": "lng", "address" : "x"}], "of": '), F.coalesce("props", F.lit("null")), F.lit("}"))
    body = F.when(F.col("event_id") % 7 == 0, nested).otherwise(F.col("props"))
    return read(spark, sf_dir, "events").select(F.array_join(evidence.place_keys(body), ",").alias("found")).groupBy("found").agg(F.count("*").alias("n"))


@query("both_directions", """
WITH e AS (SELECT p_partkey AS edge_id, p_size AS fingerprint, p_partkey % 7 AS u, p_partkey % 5 AS v FROM part)
SELECT fingerprint, least(u, v) AS u, greatest(u, v) AS v, coalesce(min(edge_id) FILTER (WHERE u <= v), -1) AS ahead, coalesce(min(edge_id) FILTER (WHERE u > v), -1) AS back FROM e GROUP BY ALL""")
def both_directions(spark, sf_dir):
    k = F.col("p_partkey")
    roads = evidence.both_directions(read(spark, sf_dir, "part").select(k.alias("edge_id"), F.col("p_size").alias("fingerprint"), (k % 7).alias("u"), (k % 5).alias("v")))
    return roads.fillna(-1, ["ahead", "back"])


@query("profile_ids", """
WITH h AS (SELECT p_partkey, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(p_name || '|' || p_partkey)) AS h FROM part)
SELECT p_partkey, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || translate(h[17], '0123456789abcdef', '89ab89ab89ab89ab') || h[18:20] || '-' || h[21:32] AS id FROM h""")
def profile_ids(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", hashing.uuid5(URL_NAMESPACE, hashing.joined(F.col("p_name"), F.col("p_partkey"))).alias("id"))


@query("line_positions", """
WITH d AS (SELECT p_partkey, p_size * 0.25 AS d, p_retailprice % 7 AS x FROM part)
SELECT p_partkey, round_even(CASE WHEN d <= 5 THEN 0.6 * d ELSE 3 END, 6) AS x, round_even(CASE WHEN d <= 5 THEN 0.8 * d ELSE least(d, 11) - 1 END, 6) AS y, round_even(5 + least(greatest(x - 4, 0), 6), 6) AS place, d BETWEEN 1 AND 9 AND x BETWEEN 2 AND 5 AS inside FROM d""")
def line_positions(spark, sf_dir):
    line = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (3.0, 4.0), (3.0, 10.0))))
    d = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 0.25).alias("d"), (F.col("p_retailprice") % 7).alias("x0"))
    # Points at x = 30 are nearer to the second segment than to the first wherever they are along it.
    at = geo.along_line(line, F.col("d"))
    d = d.select("p_partkey", at["x"].alias("x"), at["y"].alias("y"), geo.place_on_line(F.lit(30.0), F.greatest("x0", F.lit(4.0)), line).alias("place"), geo.within_extent(F.col("d"), F.col("x0"), 1.0, 2.0, 9.0, 5.0).alias("inside"))
    return d.select("p_partkey", r6("x"), r6("y"), r6("place"), "inside")


@query("frames_between", """
WITH f AS (SELECT c_nationkey AS run, c_custkey % 20 * 10.0 AS elapsed, c_mktsegment AS agent, avg(c_acctbal) AS x, count(*) * 1.0 AS y FROM customer GROUP BY 1, 2, 3),
q AS (SELECT s_suppkey, s_nationkey AS run, s_suppkey % 211 * 1.0 AS moment FROM supplier),
b AS (SELECT q.*, max(elapsed) FILTER (WHERE elapsed < moment) AS l, min(elapsed) FILTER (WHERE elapsed >= moment) AS r FROM q JOIN f USING (run) GROUP BY ALL),
c AS (SELECT s_suppkey, run, moment, coalesce(l, r) AS l, coalesce(r, l) AS r FROM b),
m AS (SELECT *, least(greatest((moment - l) / greatest(r - l, 1), 0), 1) AS share FROM c)
SELECT s_suppkey, a.agent, round_even(CASE WHEN z.x IS NULL THEN a.x ELSE a.x + (z.x - a.x) * share END, 6) AS x, round_even(CASE WHEN z.y IS NULL THEN a.y ELSE a.y + (z.y - a.y) * share END, 6) AS y
FROM m JOIN f a ON a.run = m.run AND a.elapsed = l LEFT JOIN f z ON z.run = m.run AND z.elapsed = r AND z.agent = a.agent""")
def frames_between(spark, sf_dir):
    seen = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("run"), (F.col("c_custkey") % 20 * 10.0).alias("elapsed"), F.col("c_mktsegment").alias("agent")).agg(F.avg("c_acctbal").alias("x"), (F.count("*") * 1.0).alias("y"))
    asked = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("run"), (F.col("s_suppkey") % 211 * 1.0).alias("at"))
    return frames.between(seen, asked).select("s_suppkey", "agent", r6("x"), r6("y"))


@query("star_lookup", """
WITH r AS (SELECT CASE WHEN p_partkey IS NULL THEN 'part' WHEN s_suppkey IS NULL THEN 'supplier' ELSE 'resolved' END AS outcome, l_quantity FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_size > 5) ON l_partkey = p_partkey LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) ON l_suppkey = s_suppkey)
SELECT outcome, count(*) AS n, round_even(sum(l_quantity), 4) AS quantity FROM r GROUP BY 1""")
def star_lookup(spark, sf_dir):
    parts = read(spark, sf_dir, "part").where("p_size > 5").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    suppliers = read(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    joined = frames.star(read(spark, sf_dir, "lineitem"), {"part": (parts, "l_partkey"), "supplier": (suppliers, "l_suppkey")})
    return joined.groupBy(F.coalesce("missing", F.lit("resolved")).alias("outcome")).agg(F.count("*").alias("n"), F.bround(F.sum("l_quantity"), 4).alias("quantity"))
