"""Join, ranking, flow, text and geometry operators on the benchmark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lanewright.functions import geo, hashing, text
from lanewright.operators import flows, matching, od, priors, sampling, spatial, validate
from lanewright.sources import sinks

from .registry import query


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: str, name: str | None = None):
    return F.bround(F.col(c).cast("double"), 6).alias(name or c)


PAIRS = "SELECT s_suppkey, c_custkey, s_nationkey, abs(s_acctbal - c_acctbal) AS d FROM supplier JOIN customer ON s_nationkey = c_nationkey"


def pairs(spark, sf_dir, k):
    """Suppliers with customers of their nation, among them the k nearest by balance."""
    s = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    c = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("s_nationkey"), "c_acctbal", "c_custkey")
    near = matching.nearest_values(s, c, ["s_nationkey"], "s_acctbal", "c_acctbal", "c_custkey", k)
    return near.select("s_suppkey", "c_custkey", "s_nationkey", F.abs(F.col("s_acctbal") - F.col("c_acctbal")).alias("d"))


@query("lookup_join", "SELECT n_name, r_name, count(*) AS n, round_even(sum(c_acctbal), 4) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def lookup_join(spark, sf_dir):
    c, n, r = (read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"]).groupBy("n_name", "r_name").agg(F.count("*").alias("n"), F.bround(F.sum("c_acctbal"), 4).alias("total"))


@query("lookup_misses", "SELECT count(*) AS n, count(*) FILTER (WHERE p_partkey IS NULL) AS missed FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_size > 10) ON l_partkey = p_partkey")
def lookup_misses(spark, sf_dir):
    p = read(spark, sf_dir, "part").where("p_size > 10").select("p_partkey")
    li = read(spark, sf_dir, "lineitem").select("l_partkey")
    return li.join(p, li["l_partkey"] == p["p_partkey"], "left").agg(F.count("*").alias("n"), F.count_if(F.col("p_partkey").isNull()).alias("missed"))


@query("station_match_margin", f"""
WITH k AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY d, c_custkey) AS rk, lead(d) OVER (PARTITION BY s_suppkey ORDER BY d, c_custkey) - d AS margin FROM ({PAIRS}))
SELECT s_suppkey, c_custkey, round_even(d, 6) AS d, round_even(margin, 6) AS margin, CASE WHEN d > 400 OR coalesce(margin < 8, false) THEN 'review' ELSE 'accepted' END AS status FROM k WHERE rk = 1""")
def station_match_margin(spark, sf_dir):
    w = Window.partitionBy("s_suppkey").orderBy(F.col("d").asc_nulls_last(), "c_custkey")
    k = pairs(spark, sf_dir, 2).withColumns({"rk": F.row_number().over(w), "margin": F.lead("d").over(w) - F.col("d")}).where("rk = 1")
    status = F.when((F.col("d") > 400) | F.coalesce(F.col("margin") < 8, F.lit(False)), "review").otherwise("accepted")
    return k.select("s_suppkey", "c_custkey", r6("d"), r6("margin"), status.alias("status"))


@query("authority_select", """
WITH c AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity AS score, l_discount * 100 AS value, l_returnflag <> 'N' AS eligible, l_partkey::VARCHAR || '-' || l_suppkey::VARCHAR || '-' || l_linenumber::VARCHAR || '-' || l_extendedprice::VARCHAR AS source FROM lineitem),
r AS (SELECT *, row_number() OVER w AS rk, lead(score) OVER w AS s2, lead(value) OVER w AS v2, lead(eligible) OVER w AS e2 FROM c WINDOW w AS (PARTITION BY l_orderkey ORDER BY eligible DESC, score DESC, source))
SELECT l_orderkey, l_partkey, eligible AND coalesce(e2 AND score - s2 < 4 AND abs(value - v2) > 0.804672, false) AS ambiguous, eligible AND NOT (eligible AND coalesce(e2 AND score - s2 < 4 AND abs(value - v2) > 0.804672, false)) AS selected FROM r WHERE rk = 1""")
def authority_select(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    c = li.select("l_orderkey", "l_partkey", F.col("l_quantity").alias("score"), (F.col("l_discount") * 100).alias("value"), (F.col("l_returnflag") != "N").alias("eligible"), F.concat_ws("-", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice").alias("source"))
    return matching.select_authority(c, "l_orderkey", "score", "value", "source").select("l_orderkey", "l_partkey", "ambiguous", "selected")


@query("tile_representative", """
SELECT tile_x, tile_y, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY tile_x, tile_y ORDER BY label DESC, vec_id) AS rk FROM (
  SELECT floor(embedding[1]::DOUBLE / 0.1)::BIGINT AS tile_x, floor(embedding[2]::DOUBLE / 0.1)::BIGINT AS tile_y, vec_id, label FROM embeddings)) WHERE rk = 1""")
def tile_representative(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"), "label")
    return spatial.tile_representatives(e, 0.1, "label", "vec_id").select("tile_x", "tile_y", "vec_id")


@query("connector_topk_weights", f"""
WITH k AS (SELECT s_nationkey, s_suppkey, c_custkey, 1 / (1 + d / 500) AS weight, row_number() OVER (PARTITION BY s_nationkey, s_suppkey ORDER BY 1 / (1 + d / 500) DESC, c_custkey) AS rk FROM ({PAIRS}))
SELECT s_suppkey, c_custkey, rk AS "rank", round_even(weight / sum(weight) OVER (PARTITION BY s_suppkey), 6) AS share FROM k WHERE rk <= 4""")
def connector_topk_weights(spark, sf_dir):
    one = F.lit(1.0)
    p = pairs(spark, sf_dir, 4).withColumn("weight", matching.connector_weight(one, one, one, F.col("d")))
    return matching.connectors(p, ["s_suppkey"], "weight", "c_custkey", 4).select("s_suppkey", "c_custkey", F.col("rank").cast("long").alias("rank"), r6("share"))


@query("corridor_consensus", "SELECT p_brand, p_type, median(p_size::DOUBLE) AS consensus, count(*) AS n, max(p_size) - min(p_size) AS spread FROM part WHERE p_size < 30 GROUP BY 1, 2 HAVING count(*) >= 2 AND max(p_size) - min(p_size) <= 25")
def corridor_consensus(spark, sf_dir):
    return priors.corridor_consensus(read(spark, sf_dir, "part").where("p_size < 30"), ["p_brand", "p_type"], "p_size", 25).select("p_brand", "p_type", "consensus", "n", "spread")


PRIORS = """SELECT p_partkey, CASE WHEN p_size % 11 = 0 THEN '' ELSE p_brand END AS corridor, CASE p_size % 4 WHEN 0 THEN 'motorway' WHEN 1 THEN 'primary' WHEN 2 THEN 'residential' ELSE 'other' END AS road_class,
  CASE WHEN p_partkey % 7 = 0 THEN 40.0 + p_size END AS authority_speed, CASE WHEN p_partkey % 7 = 0 THEN p_type END AS authority_source, CASE WHEN p_partkey % 14 = 0 THEN 'high' WHEN p_partkey % 7 = 0 THEN 'medium' END AS authority_confidence,
  CASE WHEN p_partkey % 5 = 0 THEN 45.0 + p_size % 16 END AS osm_speed, CASE WHEN p_partkey % 3 = 0 THEN 1.0 + p_partkey % 2 END AS osm_lanes, p_partkey % 20 AS tile FROM part"""


@query("prior_resolution", f"""
WITH e AS ({PRIORS}), k AS (SELECT *, coalesce(authority_speed, osm_speed) AS s FROM e),
cs AS (SELECT corridor, road_class, tile, median(s) AS v FROM k WHERE corridor <> '' AND s IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 2 AND max(s) - min(s) <= 16.2),
cl AS (SELECT corridor, road_class, tile, median(osm_lanes) AS v FROM k WHERE corridor <> '' AND osm_lanes IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 2 AND max(osm_lanes) - min(osm_lanes) <= 1),
j AS (SELECT k.*, cs.v AS near, cl.v AS lanes_near FROM k LEFT JOIN cs USING (corridor, road_class, tile) LEFT JOIN cl USING (corridor, road_class, tile)),
l AS (SELECT *, greatest(1, coalesce(osm_lanes, lanes_near, CASE road_class WHEN 'motorway' THEN 3 WHEN 'primary' THEN 2 ELSE 1 END))::DOUBLE AS lanes FROM j)
SELECT p_partkey, coalesce(authority_speed, osm_speed, near, CASE road_class WHEN 'motorway' THEN 100 WHEN 'primary' THEN 60 ELSE 30 END)::DOUBLE AS speed_kph,
  CASE WHEN authority_speed IS NOT NULL THEN authority_source WHEN osm_speed IS NOT NULL THEN 'osm_explicit' WHEN near IS NOT NULL THEN 'same_corridor_neighbor' ELSE 'road_class_default' END AS speed_source,
  CASE WHEN authority_speed IS NOT NULL THEN authority_confidence WHEN osm_speed IS NOT NULL THEN 'medium' ELSE 'low' END AS speed_confidence,
  lanes, CASE WHEN osm_lanes IS NOT NULL THEN 'osm_explicit' WHEN lanes_near IS NOT NULL THEN 'same_corridor_neighbor' ELSE 'road_class_default' END AS lanes_source,
  CASE WHEN osm_lanes IS NOT NULL THEN 'medium' ELSE 'low' END AS capacity_confidence,
  lanes * CASE road_class WHEN 'motorway' THEN 2000 WHEN 'primary' THEN 1600 ELSE 700 END AS capacity_vph FROM l""")
def prior_resolution(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size")
    e = read(spark, sf_dir, "part").select(
        "p_partkey",
        F.when(size % 11 == 0, "").otherwise(F.col("p_brand")).alias("corridor"),
        F.when(size % 4 == 0, "motorway").when(size % 4 == 1, "primary").when(size % 4 == 2, "residential").otherwise("other").alias("road_class"),
        F.when(k % 7 == 0, 40.0 + size).alias("authority_speed"),
        F.when(k % 7 == 0, F.col("p_type")).alias("authority_source"),
        F.when(k % 14 == 0, "high").when(k % 7 == 0, "medium").alias("authority_confidence"),
        F.when(k % 5 == 0, 45.0 + size % 16).alias("osm_speed"),
        F.when(k % 3 == 0, 1.0 + k % 2).alias("osm_lanes"),
        (k % 20).alias("tile"),
    )
    return priors.resolve(e, "corridor", ("tile",)).select("p_partkey", "speed_kph", "speed_source", "speed_confidence", "lanes", "lanes_source", "capacity_confidence", "capacity_vph")


@query("speed_cascade_provenance", """
WITH c AS (SELECT p_brand, median(p_size::DOUBLE) AS m FROM part WHERE p_size < 20 GROUP BY 1 HAVING count(*) >= 2 AND max(p_size) - min(p_size) <= 16)
SELECT p_partkey, coalesce(CASE WHEN p_size > 40 THEN p_size::DOUBLE END, CASE WHEN p_retailprice < 950 THEN p_retailprice END, m, 30.0)::DOUBLE AS value,
  CASE WHEN p_size > 40 THEN 'authority' WHEN p_retailprice < 950 THEN 'osm' WHEN m IS NOT NULL THEN 'corridor' ELSE 'class_default' END AS source FROM part LEFT JOIN c USING (p_brand)""")
def speed_cascade_provenance(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    c = priors.corridor_consensus(p.where("p_size < 20"), ["p_brand"], "p_size", 16).select("p_brand", F.col("consensus").alias("m"))
    v, s, _ = priors.cascade([("authority", F.when(F.col("p_size") > 40, F.col("p_size").cast("double")), "high"), ("osm", F.when(F.col("p_retailprice") < 950, F.col("p_retailprice")), "medium"), ("corridor", F.col("m"), "medium"), ("class_default", F.lit(30.0), "low")])
    return p.join(c, "p_brand", "left").select("p_partkey", v.alias("value"), s.alias("source"))


@query("weighted_evidence", "SELECT l_suppkey, round_even(sum(CASE WHEN l_discount > 0 THEN l_extendedprice END * l_quantity) / sum(l_quantity), 6) AS mean, sum(l_quantity) AS weight FROM lineitem GROUP BY 1")
def weighted_evidence(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").withColumn("v", F.when(F.col("l_discount") > 0, F.col("l_extendedprice")))
    return priors.weighted_evidence(li, ["l_suppkey"], "v", "l_quantity").select("l_suppkey", r6("mean"), "weight")


@query("evidence_pivot", """SELECT l_suppkey, max(l_quantity) FILTER (WHERE l_returnflag = 'A') AS am_l_quantity, coalesce(sum(l_linenumber) FILTER (WHERE l_returnflag = 'A'), 0)::BIGINT AS am_l_linenumber, coalesce(bool_or(l_returnflag = 'A'), false) AS am_available,
  max(l_quantity) FILTER (WHERE l_returnflag = 'R') AS pm_l_quantity, coalesce(sum(l_linenumber) FILTER (WHERE l_returnflag = 'R'), 0)::BIGINT AS pm_l_linenumber, coalesce(bool_or(l_returnflag = 'R'), false) AS pm_available FROM lineitem GROUP BY 1""")
def evidence_pivot(spark, sf_dir):
    return priors.evidence_pivot(read(spark, sf_dir, "lineitem"), "l_suppkey", "l_returnflag", {"A": "am", "R": "pm"}, "l_quantity", "l_linenumber")


TRADE = "SELECT s_nationkey AS o, c_nationkey AS d, sum(l_quantity) AS trips, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2"


def trade(spark, sf_dir):
    li, o, c, s = (read(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "supplier"))
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"]).join(s, li["l_suppkey"] == s["s_suppkey"])
    return j.groupBy(F.col("s_nationkey").alias("o"), F.col("c_nationkey").alias("d")).agg(F.sum("l_quantity").alias("trips"), F.count("*").alias("n"))


@query("od_normalize_units", f"SELECT o, d, round_even(CASE WHEN o % 2 = 0 THEN trips ELSE trips * 60 / 120 END, 6) AS trips_vph, round_even(CASE WHEN o % 2 = 0 THEN trips * 120 / 60 ELSE trips END, 6) AS trips_period FROM ({TRADE})")
def od_normalize_units(spark, sf_dir):
    basis = F.when(F.col("o") % 2 == 0, "vph").otherwise("period_total")
    return od.normalize_units(trade(spark, sf_dir), "trips", basis, F.lit(120)).select("o", "d", r6("trips_vph"), r6("trips_period"))


@query("od_duplicate_keys", "SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def od_duplicate_keys(spark, sf_dir):
    return validate.duplicate_keys(read(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"])


@query("keep_unique_rows", "SELECT l_partkey, l_suppkey, l_orderkey FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_partkey, l_suppkey) = 1")
def keep_unique_rows(spark, sf_dir):
    return validate.keep_unique(read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey"), ["l_partkey", "l_suppkey"])


@query("fk_orphans", "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') GROUP BY 1")
def fk_orphans(spark, sf_dir):
    parents = read(spark, sf_dir, "orders").where("o_orderstatus <> 'P'")
    return validate.orphans(read(spark, sf_dir, "lineitem"), "l_orderkey", parents, "o_orderkey")


@query("key_conflicts", "SELECT c_nationkey, count(DISTINCT c_mktsegment) AS n FROM customer GROUP BY 1 HAVING count(DISTINCT c_mktsegment) > 1")
def key_conflicts(spark, sf_dir):
    return validate.key_conflicts(read(spark, sf_dir, "customer"), "c_nationkey", "c_mktsegment")


@query("movement_matrix", f"SELECT m AS movement, coalesce(round_even(sum(trips), 4), 0) AS trips, count(trips) AS n FROM (VALUES ('internal_to_internal'), ('internal_to_external'), ('external_to_internal'), ('external_to_external')) AS v(m) LEFT JOIN (SELECT CASE WHEN o < 15 THEN 'internal' ELSE 'external' END || '_to_' || CASE WHEN d < 15 THEN 'internal' ELSE 'external' END AS k, trips FROM ({TRADE})) ON m = k GROUP BY 1")
def movement_matrix(spark, sf_dir):
    side = lambda c: F.when(F.col(c) < 15, "internal").otherwise("external")
    t = trade(spark, sf_dir).withColumns({"ot": side("o"), "dt": side("d")})
    return od.movement_matrix(t, "ot", "dt", "trips").select("movement", F.bround("trips", 4).alias("trips"), "n")


@query("period_summary", "SELECT l_returnflag AS period, count(*) AS n, round_even(sum(l_quantity), 4) AS trips, array_to_string(list_sort(list_distinct(list(l_linestatus))), ',') AS classes FROM lineitem GROUP BY 1")
def period_summary(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("period"), F.col("l_quantity").alias("trips"), F.col("l_linestatus").alias("vehicle_class"))
    return od.period_summary(li).select("period", "n", F.bround("trips", 4).alias("trips"), F.array_join("classes", ",").alias("classes"))


@query("od_blend", f"WITH t AS ({TRADE}) SELECT o, d, round_even((0.25::DOUBLE * n / (SELECT sum(n) FROM t) + 0.75::DOUBLE * trips / (SELECT sum(trips) FROM t)) * 1000, 6) AS rate FROM t")
def od_blend(spark, sf_dir):
    return od.blend(trade(spark, sf_dir), "n", "trips", 0.75, 1000.0).select("o", "d", r6("rate"))


PATHS = "SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS edge_ids, max(l_quantity) AS w FROM lineitem GROUP BY 1"


def paths(spark, sf_dir):
    steps = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(steps, lambda s: s["l_partkey"]).alias("edge_ids"), F.max("l_quantity").alias("w"))


@query("path_edge_flows", f"SELECT edge_id, round_even(sum(w), 6) AS flow FROM (SELECT unnest(edge_ids) AS edge_id, w FROM ({PATHS})) GROUP BY 1")
def path_edge_flows(spark, sf_dir):
    return flows.edge_flows(paths(spark, sf_dir), "w").select("edge_id", r6("flow"))


@query("path_predictions", f"SELECT edge_id, round_even(sum(w), 6) AS predicted FROM (SELECT unnest(list_distinct(edge_ids)) AS edge_id, w FROM ({PATHS})) GROUP BY 1")
def path_predictions(spark, sf_dir):
    return flows.predictions(paths(spark, sf_dir), "w").select("edge_id", r6("predicted"))


@query("flow_conservation", f"""
WITH p AS ({PATHS}), s AS (SELECT edge_ids[i] AS node, w AS x FROM (SELECT *, unnest(range(1, len(edge_ids))) AS i FROM p) UNION ALL SELECT edge_ids[i + 1], -w FROM (SELECT *, unnest(range(1, len(edge_ids))) AS i FROM p)
  UNION ALL SELECT edge_ids[1], -w FROM p UNION ALL SELECT edge_ids[-1], w FROM p)
SELECT round_even(greatest((SELECT max(abs(x)) FROM (SELECT sum(x) AS x FROM s GROUP BY node)), (SELECT abs(sum(w * (len(edge_ids) - len(list_distinct(edge_ids))))) FROM p), 0.0), 6) AS max_error""")
def flow_conservation(spark, sf_dir):
    p = paths(spark, sf_dir).withColumn("node_ids", F.col("edge_ids"))
    # Flows that count an edge once a path miss what paths with a repeated edge carry.
    return flows.conservation_error(p, flows.predictions(p, "w").withColumnRenamed("predicted", "flow"), "w").select(r6("max_error"))


@query("calibration_error_metrics", f"""
WITH e AS (SELECT edge_id, sum(w) AS predicted FROM (SELECT unnest(list_distinct(edge_ids)) AS edge_id, w FROM ({PATHS})) GROUP BY 1), o AS (SELECT p_partkey AS edge_id, p_retailprice AS observed FROM part),
b AS (SELECT coalesce(predicted, 0) AS p, observed AS a FROM o LEFT JOIN e USING (edge_id))
SELECT count(*) AS edges, round_even(avg((p > 0)::INT::DOUBLE), 6) AS coverage, round_even(avg(abs(p - a)), 6) AS mae, round_even(sum(abs(p - a)) / greatest(sum(a), 1e-9), 6) AS wape, round_even(median(abs(p - a) / greatest(a, 1e-9::DOUBLE)), 6) AS median_ape FROM b""")
def calibration_error_metrics(spark, sf_dir):
    o = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("edge_id"), F.col("p_retailprice").alias("observed"))
    return flows.error_metrics(o, flows.predictions(paths(spark, sf_dir), "w"))


@query("bpr_costs", "SELECT l_orderkey, l_linenumber, l_partkey, round_even(l_extendedprice * (1 + 0.15::DOUBLE * pow(l_quantity / 40, 4)) / (1 + 0.15::DOUBLE * pow(20.0::DOUBLE / 40, 4)), 4) AS cost FROM lineitem")
def bpr_costs(spark, sf_dir):
    f = flows.relative_bpr(F.col("l_quantity"), F.lit(20.0), F.lit(40.0))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.bround(F.col("l_extendedprice") * f, 4).alias("cost"))


HALVES = "SELECT l_partkey, sum(l_quantity) FILTER (WHERE month(l_shipdate) <= 6) AS b, sum(l_quantity) FILTER (WHERE month(l_shipdate) > 6) AS s FROM lineitem GROUP BY 1"


def changes(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    half = lambda c: li.where(c).groupBy("l_partkey").agg(F.sum("l_quantity").alias("flow"))
    return flows.scenario_changes(half(F.month("l_shipdate") <= 6), half(F.month("l_shipdate") > 6), "l_partkey")


@query("scenario_diff_topk", f"SELECT l_partkey, coalesce(b, 0) AS baseline, coalesce(s, 0) AS scenario, coalesce(s, 0) - coalesce(b, 0) AS change FROM ({HALVES}) WHERE abs(coalesce(s, 0) - coalesce(b, 0)) >= 0.5 ORDER BY abs(coalesce(s, 0) - coalesce(b, 0)) DESC, l_partkey LIMIT 100")
def scenario_diff_topk(spark, sf_dir):
    return flows.top_changes(changes(spark, sf_dir), "l_partkey", 100)


@query("scenario_summary", f"SELECT count(*) AS n, sum(greatest(0, c)) AS increase, greatest(0, max(c)) AS largest_increase, least(0, min(c)) AS largest_decrease FROM (SELECT coalesce(s, 0) - coalesce(b, 0) AS c FROM ({HALVES})) WHERE abs(c) >= 0.5")
def scenario_summary(spark, sf_dir):
    return flows.change_summary(changes(spark, sf_dir))


@query("msa_step", f"SELECT l_partkey AS edge_id, round_even(coalesce(b, 0) + (coalesce(s, 0) - coalesce(b, 0)) / 3, 6) AS flow FROM ({HALVES})")
def msa_step(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    half = lambda c: li.where(c).groupBy(F.col("l_partkey").alias("edge_id")).agg(F.sum("l_quantity").alias("flow"))
    return flows.msa_step(half(F.month("l_shipdate") <= 6), half(F.month("l_shipdate") > 6), 3).select("edge_id", r6("flow"))


@query("parallel_edge_reduction", "SELECT l_partkey AS u, l_suppkey AS v, l_orderkey AS edge_id, l_extendedprice AS cost FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_extendedprice, l_orderkey) = 1")
def parallel_edge_reduction(spark, sf_dir):
    e = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("u"), F.col("l_suppkey").alias("v"), F.col("l_orderkey").alias("edge_id"), F.col("l_extendedprice").alias("cost"))
    return flows.best_parallel(e, "cost")


@query("node_activity", "SELECT node_id, round_even(sum(a), 6) AS activity FROM (SELECT s_nationkey AS node_id, sqrt(abs(s_acctbal)) AS a FROM supplier UNION ALL SELECT s_suppkey % 7 + 100, sqrt(abs(s_acctbal)) FROM supplier) GROUP BY 1")
def node_activity(spark, sf_dir):
    e = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("u"), (F.col("s_suppkey") % 7 + 100).alias("v"), F.abs("s_acctbal").alias("c"))
    return flows.node_activity(e, "c").select("node_id", r6("activity"))


@query("degree_counts", "WITH e AS (SELECT DISTINCT l_partkey AS u, l_suppkey AS v FROM lineitem), a AS (SELECT u AS node, 1 AS o, 0 AS i, v AS n FROM e UNION ALL SELECT v, 0, 1, u FROM e) SELECT node, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree, count(DISTINCT n) AS neighbours FROM a GROUP BY 1")
def degree_counts(spark, sf_dir):
    e = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("u"), F.col("l_suppkey").alias("v"))
    return flows.degrees(e, simple=True)


@query("path_pairs", f"SELECT l_orderkey, i - 1 AS step, edge_ids[i] AS u, edge_ids[i + 1] AS v FROM (SELECT *, unnest(range(1, len(edge_ids)))::INT AS i FROM ({PATHS}))")
def path_pairs(spark, sf_dir):
    return flows.path_pairs(paths(spark, sf_dir), "l_orderkey", "edge_ids")


@query("waypoints", """
WITH s AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS step, l_quantity AS len FROM lineitem),
r AS (SELECT *, sum(len) OVER (PARTITION BY l_orderkey ORDER BY step) AS run, sum(len) OVER (PARTITION BY l_orderkey) AS total FROM s)
SELECT l_orderkey, share::DOUBLE AS share, min(step) AS step FROM r, (VALUES (0.25), (0.5), (0.75)) AS t(share) WHERE run >= share * total GROUP BY 1, 2""")
def waypoints(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    s = read(spark, sf_dir, "lineitem").select("l_orderkey", F.row_number().over(w).cast("long").alias("step"), F.col("l_quantity").alias("len"))
    return flows.waypoints(s, "l_orderkey", "step", "len")


@query("collapse_repeats", "SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NULL OR b <> event_type")
def collapse_repeats(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("o", F.struct("ts", "event_id"))
    return flows.collapse_repeats(e, ["user_id"], "o", "event_type").select("user_id", "event_id", "event_type")


@query("active_intervals", """
WITH r AS (SELECT s_suppkey AS k, floor(s_acctbal / 500)::BIGINT AS a, floor(s_acctbal / 500)::BIGINT + 3 AS b FROM supplier), p AS (SELECT DISTINCT unnest([a, b]) AS a FROM r), i AS (SELECT a, lead(a) OVER (ORDER BY a) AS b FROM p)
SELECT i.a, i.b, array_to_string(list_sort(list_distinct(list(k))), ',') AS active FROM i JOIN r ON r.a <= i.a AND r.b >= i.b WHERE i.b IS NOT NULL GROUP BY 1, 2""")
def active_intervals(spark, sf_dir):
    low = F.floor(F.col("s_acctbal") / 500).cast("long")
    r = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), low.alias("s"), (low + 3).alias("e"))
    return flows.elementary_intervals(r, "s", "e", "k").select("a", "b", F.array_join(F.transform("active", lambda x: x.cast("string")), ",").alias("active"))


@query("all_accepted_mapping", "SELECT l_orderkey, array_to_string(list_sort(list_distinct(list(l_suppkey))), ',') AS targets FROM lineitem GROUP BY 1 HAVING bool_and(l_linestatus = 'F')")
def all_accepted_mapping(spark, sf_dir):
    out = matching.all_accepted(read(spark, sf_dir, "lineitem").withColumn("status", F.when(F.col("l_linestatus") == "F", "accepted").otherwise("review")), "l_orderkey", "l_suppkey")
    return out.select("l_orderkey", F.array_join(F.transform("targets", lambda x: x.cast("string")), ",").alias("targets"))


@query("shared_id_pairs", f"SELECT DISTINCT a.l_orderkey AS a, b.l_orderkey AS b FROM (SELECT l_orderkey, unnest(edge_ids) AS i FROM ({PATHS})) a JOIN (SELECT l_orderkey, unnest(edge_ids) AS i FROM ({PATHS}) WHERE w > 48) b USING (i)")
def shared_id_pairs(spark, sf_dir):
    p = paths(spark, sf_dir)
    return matching.shared_ids(p.select(F.col("l_orderkey").alias("a"), "edge_ids"), p.where("w > 48").select(F.col("l_orderkey").alias("b"), "edge_ids"), "a", "b", "edge_ids")


@query("status_pivot", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS \"F\", count(*) FILTER (WHERE o_orderstatus = 'O') AS \"O\", count(*) FILTER (WHERE o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY 1")
def status_pivot(spark, sf_dir):
    return matching.status_pivot(read(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "status"), "o_orderpriority", ("F", "O", "P"))


@query("reason_counts", "SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS reason FROM part) WHERE reason <> '' GROUP BY 1")
def reason_counts(spark, sf_dir):
    return matching.reason_counts(read(spark, sf_dir, "part"), "p_name", " ")


@query("points_within_radius", """
WITH p AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, label FROM embeddings)
SELECT a.vec_id AS a, b.vec_id AS b, round_even(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 6) AS distance FROM p a JOIN p b ON b.label = 0 AND abs(a.x - b.x) <= 0.05 AND abs(a.y - b.y) <= 0.05 WHERE sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 0.05""")
def points_within_radius(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    x, y = (F.get("embedding", F.lit(i)).cast("double") for i in (0, 1))
    out = spatial.points_within(e.select(F.col("vec_id").alias("a"), x.alias("x"), y.alias("y")), e.where("label = 0").select(F.col("vec_id").alias("b"), x.alias("ox"), y.alias("oy")), 0.05)
    return out.select("a", "b", r6("distance"))


@query("nearest_point", """
WITH p AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, label FROM embeddings)
SELECT a.vec_id AS a, b.vec_id AS b FROM p a JOIN p b ON b.label = 1 AND abs(a.x - b.x) <= 0.1 AND abs(a.y - b.y) <= 0.1 WHERE sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 0.1
QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), b.vec_id) = 1""")
def nearest_point(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    x, y = (F.get("embedding", F.lit(i)).cast("double") for i in (0, 1))
    return spatial.nearest_within(e.select(F.col("vec_id").alias("a"), x.alias("x"), y.alias("y")), e.where("label = 1").select(F.col("vec_id").alias("b"), x.alias("ox"), y.alias("oy")), ["a"], "b", 0.1).select("a", "b")


@query("geo_scalars", """
SELECT vec_id, round_even(2 * 6371009.0::DOUBLE * asin(sqrt(pow(sin(radians(y2 - y1) / 2), 2) + cos(radians(y1)) * cos(radians(y2)) * pow(sin(radians(x2 - x1) / 2), 2))), 3) AS metres,
  round_even((degrees(atan2(x2 - x1, y2 - y1)) + 360) % 360, 6) AS bearing, round_even(abs((((degrees(atan2(x2 - x1, y2 - y1)) + 360) % 360 - 270 + 180) % 360 + 360) % 360 - 180), 6) AS off_west,
  round_even(least(abs((degrees(atan2(x2 - x1, y2 - y1)) + 360) % 360 - 270) % 180, 180 - abs((degrees(atan2(x2 - x1, y2 - y1)) + 360) % 360 - 270) % 180), 6) AS off_axis FROM (SELECT vec_id, embedding[1]::DOUBLE AS x1, embedding[2]::DOUBLE AS y1, embedding[3]::DOUBLE AS x2, embedding[4]::DOUBLE AS y2 FROM embeddings)""")
def geo_scalars(spark, sf_dir):
    a, b, c, d = (F.get("embedding", F.lit(i)).cast("double") for i in range(4))
    line = F.array(F.struct(a.alias("x"), b.alias("y")), F.struct(c.alias("x"), d.alias("y")))
    e = read(spark, sf_dir, "embeddings").withColumn("to", geo.line_bearing(line))
    off, axis = geo.bearing_difference(F.col("to"), F.lit(270.0)), geo.undirected_difference(F.col("to"), F.lit(270.0))
    return e.select("vec_id", F.bround(geo.haversine(b, a, d, c), 3).alias("metres"), r6("to", "bearing"), F.bround(off, 6).alias("off_west"), F.bround(axis, 6).alias("off_axis"))


@query("zone_centroids", "SELECT label, round_even(avg(embedding[1]::DOUBLE), 6) AS x, round_even(avg(embedding[2]::DOUBLE), 6) AS y, count(*) AS n FROM embeddings GROUP BY 1")
def zone_centroids(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select("label", F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))
    return spatial.centroids(e, ["label"]).select("label", r6("x"), r6("y"), "n")


@query("road_names", r"SELECT p_partkey, array_to_string(regexp_extract_all(regexp_replace(regexp_replace(upper(p_name || ' north street ' || p_type), '\b(?:NORTH|SOUTH|EAST|WEST|NORTHEAST|NORTHWEST|SOUTHEAST|SOUTHWEST|N|S|E|W|NE|NW|SE|SW)\b', ' ', 'g'), '\bSTREET\b', 'ST', 'g'), '[A-Z0-9]+'), ' ') AS name, list_sort(list_distinct(list_transform(regexp_extract_all('I-' || p_size || ' to US ' || (p_partkey % 100), '\bI\s*[- ]?\s*(\d{1,3})\b', 1), lambda x: 'I' || x) || list_transform(regexp_extract_all('I-' || p_size || ' to US ' || (p_partkey % 100), '\bUS\s*[- ]?\s*(\d{1,3})\b', 1), lambda x: 'US' || x)))[1] AS token FROM part")
def road_names(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    name = F.concat_ws(" ", "p_name", F.lit("north street"), "p_type")
    route = F.concat(F.lit("I-"), "p_size", F.lit(" to US "), F.col("p_partkey") % 100)
    return p.select("p_partkey", text.road_name(name).alias("name"), F.get(text.route_tokens(route), F.lit(0)).alias("token"))


@query("speed_tags", "SELECT p_partkey, CASE WHEN v BETWEEN 5 AND 160 THEN round_even(v, 6) END AS kph FROM (SELECT p_partkey, p_size * CASE WHEN p_partkey % 2 = 0 THEN 1.609344::DOUBLE ELSE 1 END AS v FROM part)")
def speed_tags(spark, sf_dir):
    tag = F.concat(F.col("p_size"), F.when(F.col("p_partkey") % 2 == 0, " mph").otherwise(""))
    return read(spark, sf_dir, "part").select("p_partkey", F.bround(text.tagged_speed(tag), 6).alias("kph"))


@query("balanced_rounding", f"""
WITH t AS (SELECT o * 100 + d AS k, trips / 50 AS e FROM ({TRADE})), f AS (SELECT k, floor(e)::BIGINT AS u, e - floor(e) AS fr, e FROM t),
d AS (SELECT *, CASE WHEN fr > 1e-12 THEN -ln(greatest(1e-300::DOUBLE, ('0x' || substr(sha256('5|' || k::VARCHAR), 1, 13))::BIGINT::DOUBLE / 4503599627370496)) / fr END AS key FROM f),
r AS (SELECT *, row_number() OVER (ORDER BY key NULLS LAST, k) AS rk, (SELECT round_even(sum(e), 0) - sum(u) FROM f)::BIGINT AS need FROM d)
SELECT k, u + CASE WHEN rk <= need AND key IS NOT NULL THEN 1 ELSE 0 END AS units FROM r""")
def balanced_rounding(spark, sf_dir):
    t = trade(spark, sf_dir).select((F.col("o") * 100 + F.col("d")).alias("k"), "trips")
    return sampling.balanced_rounding(t, "k", "trips", 50, 5).select("k", "units")


@query("trip_departures", f"SELECT k, trip, round_even(25200 + 7200 * (('0x' || substr(sha256('9|' || k::VARCHAR || '|' || trip::VARCHAR), 1, 13))::BIGINT::DOUBLE / 4503599627370496), 6) AS depart FROM (SELECT k, unnest(range(1, u + 1)) AS trip FROM (SELECT o * 100 + d AS k, n AS u FROM ({TRADE})))")
def trip_departures(spark, sf_dir):
    u = trade(spark, sf_dir).select((F.col("o") * 100 + F.col("d")).alias("k"), F.col("n").alias("u"))
    return sampling.trips(u, "k", "u", 25200, 7200, 9).select("k", "trip", r6("depart"))


@query("weighted_choice", """
WITH w AS (SELECT c_nationkey, c_custkey, sum(c_acctbal) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) / sum(c_acctbal) OVER (PARTITION BY c_nationkey) AS hi FROM customer WHERE c_acctbal > 0),
r AS (SELECT s_suppkey, s_nationkey, ('0x' || substr(sha256('3|' || s_suppkey::VARCHAR), 1, 13))::BIGINT::DOUBLE / 4503599627370496 AS u FROM supplier)
SELECT s_suppkey, min(c_custkey) AS c_custkey FROM r JOIN w ON s_nationkey = c_nationkey AND hi > u GROUP BY 1""")
def weighted_choice(spark, sf_dir):
    c = read(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_nationkey").alias("g"), "c_custkey", "c_acctbal")
    r = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("g"))
    return sampling.weighted_choice(r, c, "g", "c_custkey", "c_acctbal", hashing.fraction(F.lit(3), F.col("s_suppkey"))).select("s_suppkey", "c_custkey")


@query("agent_allocation", "SELECT c_custkey, greatest(1, round(abs(c_acctbal) / (SELECT sum(abs(c_acctbal)) FROM customer) * 900)::BIGINT) AS agents FROM customer")
def agent_allocation(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", F.abs("c_acctbal").alias("w"))
    return sampling.allocate(c, "c_custkey", "w", 900).select("c_custkey", "agents")


@query("latest_revision", "SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def latest_revision(spark, sf_dir):
    return spatial.latest(read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"])


@query("upsert_rows", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE o_orderstatus END AS status FROM orders UNION ALL SELECT o_orderkey + 100000000, 'new' FROM orders WHERE o_orderkey % 3 = 0")
def upsert_rows(spark, sf_dir):
    old = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    ids = old.where("o_orderkey % 3 = 0").select("o_orderkey")
    new = ids.unionByName(ids.select((F.col("o_orderkey") + 100000000).alias("o_orderkey"))).withColumn("status", F.lit("new"))
    return sinks.upsert(old, new, ["o_orderkey"])


@query("set_operations", "SELECT 'both' AS part, count(*) AS n FROM (SELECT c_nationkey FROM customer WHERE c_acctbal > 5000 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) UNION ALL SELECT 'only', count(*) FROM (SELECT c_nationkey FROM customer WHERE c_acctbal > 5000 EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) UNION ALL SELECT 'any', count(*) FROM (SELECT c_nationkey FROM customer WHERE c_acctbal > 5000 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def set_operations(spark, sf_dir):
    a = read(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_nationkey").alias("k"))
    b = read(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"))
    one = lambda df, n: df.agg(F.count("*").alias("n")).select(F.lit(n).alias("part"), "n")
    return one(a.intersect(b), "both").unionByName(one(a.subtract(b), "only")).unionByName(one(a.union(b).distinct(), "any"))


@query("effective_costs", """
SELECT l_orderkey, l_linenumber, l_partkey, round_even(CASE l_returnflag WHEN 'A' THEN t * 4 / 2 WHEN 'R' THEN greatest(t, l_extendedprice / (30 / 3.6::DOUBLE)) ELSE t END, 6) AS seconds, round_even(CASE l_returnflag WHEN 'A' THEN c * 4 / 2 WHEN 'R' THEN greatest(t, l_extendedprice / (30 / 3.6::DOUBLE)) * c / t ELSE c END, 6) AS cost
FROM (SELECT *, l_extendedprice / ((20 + l_quantity) / 3.6::DOUBLE) AS t, l_extendedprice / ((20 + l_quantity) / 3.6::DOUBLE) * 1.3::DOUBLE AS c FROM lineitem)""")
def effective_costs(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    t = F.col("l_extendedprice") / ((20 + F.col("l_quantity")) / 3.6)
    kind = F.when(F.col("l_returnflag") == "A", "lane").when(F.col("l_returnflag") == "R", "speed").otherwise("none")
    e = li.withColumns({"free_flow_seconds": t, "cost": t * 1.3, "restriction": kind, "lanes": F.lit(4), "remaining_lanes": F.lit(2), "limit_kph": F.lit(30.0), "length_m": F.col("l_extendedprice")})
    return flows.effective_costs(e).select("l_orderkey", "l_linenumber", "l_partkey", r6("effective_seconds", "seconds"), r6("effective_cost", "cost"))


@query("route_overlap", "SELECT round_even(sum(least(x, y)) / greatest(least((SELECT sum(l_quantity) FROM lineitem WHERE l_suppkey % 2 = 0), (SELECT sum(l_quantity) FROM lineitem WHERE l_suppkey % 3 = 0)), 1), 9) AS overlap FROM (SELECT l_partkey, sum(l_quantity) AS x FROM lineitem WHERE l_suppkey % 2 = 0 GROUP BY 1) JOIN (SELECT l_partkey, sum(l_quantity) AS y FROM lineitem WHERE l_suppkey % 3 = 0 GROUP BY 1) USING (l_partkey)")
def route_overlap(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("edge_id"), F.col("l_quantity").alias("length"), "l_suppkey")
    return flows.route_overlap(li.where("l_suppkey % 2 = 0"), li.where("l_suppkey % 3 = 0")).select(F.bround("overlap", 9).alias("overlap"))
