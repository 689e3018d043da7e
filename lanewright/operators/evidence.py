"""What a run is judged by: approach points of closures, acceptance by class, findings, gates, deltas, private fields."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Distances upstream of a closure in metres, keys that name places, classes that connect inner and outer zones.
APPROACHES = (500.0, 3000.0, 8000.0, 15000.0, 25000.0)
PLACE_KEYS = ("address", "origin_address", "destination_address", "lat", "lng", "latitude", "longitude", "coordinates")
INTERNAL_CLASSES = ("motorway_link", "trunk", "trunk_link", "primary", "primary_link", "secondary", "secondary_link", "tertiary", "tertiary_link", "unclassified")
EXTERNAL_CLASSES = ("motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link")
# Severity, name and summed counts of a finding.
FINDINGS = (
    ("high", "duplicate_grain", ("duplicate_keys",)),
    ("high", "invalid_or_out_of_window_timestamps", ("invalid_timestamps", "outside_chunk_dates")),
    ("medium", "missing_or_invalid_speed", ("missing_speed", "invalid_speed")),
    ("medium", "missing_or_invalid_volume", ("missing_volume", "invalid_volume")),
    ("medium", "invalid_occupancy", ("invalid_occupancy",)),
    ("low", "low_sample_rows", ("low_sample",)),
)


def approach_edges(steps: DataFrame, closed: DataFrame, path: str = "path_id", order: str = "position", distances: tuple[float, ...] = APPROACHES) -> DataFrame:
    """Edges at which closures are made known: those that paths over a closed edge start with, those that lie a distance
    upstream of it, and the closed ones.  A path goes through one shuffle: closed steps ask for the step that covers
    their place less the distance, and a running window answers.  Null and negative lengths count as none."""
    along = Window.partitionBy(path).orderBy(order)
    before = F.coalesce(F.sum(F.greatest(F.coalesce(F.col("length").cast("double"), F.lit(0.0)), F.lit(0.0))).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    shut = closed.select("edge_id").where("edge_id IS NOT NULL").distinct()
    s = steps.join(shut.withColumn("shut", F.lit(True)), "edge_id", "left")
    s = s.select(path, order, "edge_id", "shut", before.alias("before"), (F.row_number().over(along) == 1).alias("first"), F.max("shut").over(Window.partitionBy(path)).alias("crossed")).where("crossed")
    step = F.struct(F.col("before").alias("at"), F.lit(0).alias("asks"), F.col(order).alias("place"), F.col("edge_id").alias("edge"), F.col("first"))
    asks = [F.struct((F.col("before") - d).alias("at"), F.lit(1).alias("asks"), F.col(order).alias("place"), F.lit(None).cast(s.schema["edge_id"].dataType).alias("edge"), F.lit(False).alias("first")) for d in distances]
    rows = s.select(path, F.explode(F.when(F.col("shut"), F.array(step, *asks)).otherwise(F.array(step))).alias("r")).select(path, "r.*")
    found = rows.withColumn("edge", F.last("edge", ignorenulls=True).over(Window.partitionBy(path).orderBy("at", "asks", "place").rowsBetween(Window.unboundedPreceding, 0)))
    found = found.where("edge IS NOT NULL AND (asks = 1 OR first)").select(F.col("edge").alias("edge_id"))
    return found.unionByName(shut).distinct()


def class_acceptance(matches: DataFrame, by: str, key: str, score: str, status: str = "status") -> DataFrame:
    """Rows, accepted rows and their share in percent by class, and the accepted key of the best score (ties: the smallest)."""
    accepted = F.coalesce(F.col(status) == "accepted", F.lit(False))
    best = F.min(F.when(accepted, F.struct((-F.col(score)).alias("s"), F.col(key).alias("k"))))
    out = matches.groupBy(by).agg(F.count("*").alias("total"), F.count_if(accepted).alias("accepted"), best["k"].alias("representative"))
    return out.withColumn("accepted_percent", F.bround(100.0 * F.col("accepted") / F.col("total"), 3))


def findings(totals: DataFrame, rows: str = "rows", rules=FINDINGS) -> DataFrame:
    """One row for each kind of defect that occurs, from a row of counts; a missing count is none."""
    count = lambda names: reduce(lambda a, b: a + b, (F.coalesce(F.col(n).cast("long"), F.lit(0)) if n in totals.columns else F.lit(0).cast("long") for n in names))
    found = F.array(*(F.struct(F.lit(severity).alias("severity"), F.lit(name).alias("name"), count(names).alias("n")) for severity, name, names in rules))
    kept = totals.select(F.col(rows).alias("_rows"), F.explode(found).alias("f")).where("f.n > 0")
    return kept.select("f.*", F.bround(100.0 * F.col("f.n") / F.greatest(F.col("_rows"), F.lit(1)), 4).alias("rate_percent"))


def missing_dates(df: DataFrame, date: str, first: str, last: str, weekdays: tuple[int, ...] = (1, 2, 3, 4, 5, 6, 7), examples: int = 20) -> DataFrame:
    """The finding of dates that a campaign (its days of the ISO week from first to last) should have and no row has; none: no row."""
    day = F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day")
    expected = df.sparkSession.range(1).select(day).where((F.weekday("day") + 1).isin(list(weekdays)))
    seen = df.select(F.col(date).cast("date").alias("day")).distinct().withColumn("_seen", F.lit(True))
    both = expected.join(seen, "day", "left").agg(F.count("*").alias("_all"), F.sort_array(F.collect_list(F.when(F.col("_seen").isNull(), F.col("day")))).alias("_missing"))
    n = F.size("_missing").cast("long")
    return both.where(n > 0).select(F.lit("medium").alias("severity"), F.lit("missing_campaign_dates").alias("name"), n.alias("n"), F.bround(100.0 * n / F.greatest(F.col("_all"), F.lit(1)), 4).alias("rate_percent"), F.slice("_missing", 1, examples).alias("examples"))


def preset_faults(selected: DataFrame, snapshots: DataFrame, edges: DataFrame) -> DataFrame:
    """Why presets don't fit a graph: (preset_id, section_id, edge_id, reason), none for those that fit.

    selected (preset_id, section_id, edge_id), snapshots of their edges (and u, v, parallel, fingerprint) and the graph's edges
    (u, v, parallel, edge_id, fingerprint). A selected edge needs a snapshot; at its place the graph must have the same edge, with
    the same fingerprint where the snapshot has one. Only the snapshots of selected edges meet the graph, by one join on places.
    """
    key = ["preset_id", "section_id", "edge_id"]
    snap = snapshots.select(*key, "u", "v", "parallel", F.nullif(F.col("fingerprint"), F.lit("")).alias("fingerprint"), F.lit(True).alias("_snap"))
    wanted = selected.select(*key).distinct().join(snap, key, "left")
    there = edges.select("u", "v", "parallel", F.col("edge_id").alias("_id"), F.coalesce("fingerprint", F.lit("")).alias("_print"))
    on = wanted.join(there, ["u", "v", "parallel"], "left")
    reason = (
        F.when(F.col("_snap").isNull(), "no snapshot").when(F.col("_id").isNull(), "no edge").when(F.col("_id") != F.col("edge_id"), "another edge")
        .when(F.col("fingerprint").isNotNull() & (F.col("fingerprint") != F.col("_print")), "another shape")
    )
    return on.select(*key, reason.alias("reason")).where("reason IS NOT NULL").distinct()


def review_status(found: DataFrame) -> DataFrame:
    """PASS, or REVIEW REQUIRED where a finding is critical or high."""
    return found.agg(F.when(F.count_if(F.col("severity").isin("critical", "high")) > 0, "REVIEW REQUIRED").otherwise("PASS").alias("status"))


def period_gate(edges: int = 20, coverage: float = 0.70, wape: float = 0.5, flow: float = 0.15, conservation: float = 1e-6) -> Column:
    """Whether a period's fit may be used, from the columns of its metrics; false where one is null."""
    holds = (
        (F.col("holdout_edge_count") >= edges) & (F.col("holdout_path_coverage") >= coverage) & (F.col("holdout_wape") <= wape)
        & (F.col("positive_flow_edge_percent") >= 100 * flow) & (F.col("flow_conservation_max_error_vph") <= conservation)
    )
    return F.coalesce(holds, F.lit(False))


def graph_failures(least_percent: float = 95.0) -> Column:
    """Array of what is wrong with a graph, from one row of its counts; empty if it may be used."""
    c = lambda name: F.coalesce(F.col(name), F.lit(0))
    checks = {
        "empty": (c("node_count") == 0) | (c("edge_count") == 0), "disconnected": c("largest_weak_percent") < least_percent, "geometry": c("invalid_geometry") > 0,
        "length": c("zero_length") > 0, "speed": c("missing_speed") > 0, "routes": c("failed_routes") > 0,
    }
    return F.filter(F.array(*(F.when(bad, name) for name, bad in checks.items())), lambda x: x.isNotNull())


def deltas(baseline: DataFrame, scenario: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Scenario less baseline for each key of either; null where one of them is missing."""
    b, s = (df.select(*keys, *(F.col(v).cast("double").alias(p + v) for v in values)) for df, p in ((baseline, "_b_"), (scenario, "_s_")))
    return b.join(s, keys, "full").select(*keys, *(F.bround(F.col("_s_" + v) - F.col("_b_" + v), 3).alias(v) for v in values))


def connects(zone_type: Column, road_class: Column) -> Column:
    """Whether a road of the class may connect a zone of the type (internal, external)."""
    return F.coalesce(F.when(zone_type == "internal", road_class.isin(*INTERNAL_CLASSES)).when(zone_type == "external", road_class.isin(*EXTERNAL_CLASSES)), F.lit(False))


def place_keys(json: Column) -> Column:
    """Sorted array of the keys in a JSON text, at any depth, that name places; null text: empty.

    Keys written with escapes count as what they spell; quotes inside texts don't begin a key.
    """
    text = F.lower(F.coalesce(json, F.lit("")))
    spelled = text
    for c in sorted(set("".join(PLACE_KEYS))):
        spelled = F.regexp_replace(spelled, rf"\\u00(?:{ord(c):02x}|{ord(c.upper()):02x})", c)
    plain = F.regexp_replace(F.when(text.contains("\\u"), spelled).otherwise(text), r"\\.", "?")
    keys = F.regexp_extract_all(plain, F.lit(r'"([^"]*)"\s*:'), F.lit(1))
    return F.array_sort(F.array_intersect(keys, F.array(*map(F.lit, PLACE_KEYS))))


def both_directions(edges: DataFrame, fingerprint: str = "fingerprint") -> DataFrame:
    """Roads by fingerprint and end nodes with the smallest edge each way; the other way is null for one-way roads.
    Edges are reduced to one a direction before they meet, so parallel ones don't multiply."""
    way = F.when(F.col("u") <= F.col("v"), F.struct("u", "v")).otherwise(F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    ahead = F.col("u") <= F.col("v")
    out = edges.groupBy(F.col(fingerprint).alias("fingerprint"), way.alias("w")).agg(F.min(F.when(ahead, F.col("edge_id"))).alias("ahead"), F.min(F.when(~ahead, F.col("edge_id"))).alias("back"))
    return out.select("fingerprint", "w.*", "ahead", "back")
