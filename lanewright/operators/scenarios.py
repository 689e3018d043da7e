"""Scenarios on a road network: closures and what they displace, modelled flows, labels, ranking of routes, paths as arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Classes of main roads, surfaces that slow traffic and their factor, curve of volume and delay.
MAJOR_CLASSES = ("motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link", "secondary", "secondary_link")
ROUGH_SURFACES, ROUGH_FACTOR = ("unpaved", "gravel", "dirt", "ground", "fine_gravel"), 1.35
DELAY, POWER = 0.15, 4.0


def major_roads(edges: DataFrame, road_class: str = "road_class") -> DataFrame:
    return edges.where(F.col(road_class).isin(*MAJOR_CLASSES))


def allows(classes_json: Column, vehicle: str) -> Column:
    """Whether a JSON array of classes holds the vehicle's; false where it is null or no array."""
    return F.coalesce(F.array_contains(F.from_json(classes_json, "array<string>"), vehicle), F.lit(False))


def surface_penalty(surface: Column) -> Column:
    return F.when(surface.isin(*ROUGH_SURFACES), ROUGH_FACTOR).otherwise(F.lit(1.0))


def closure_window(starts: Column, ends: Column, departure: Column, warmup: int, end_second: int) -> tuple[Column, Column]:
    """Seconds of a run between which a closure holds; an open side is the run's own, both stay inside the run."""
    last = F.lit(end_second + 1)
    since = lambda t: (t.cast("double") - departure.cast("double") + warmup)
    clamp = lambda x: F.least(last, F.greatest(F.lit(0), x.cast("long")))
    return clamp(F.coalesce(since(starts), F.lit(0.0))), clamp(F.coalesce(since(ends), last.cast("double")))


def displaced_demand(edges: DataFrame, flows: DataFrame, restrictions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(demand, background): what flows (edge_id, flow) on fully closed edges becomes, from their start to their end, and the flows that stay.

    edges (edge_id, u, v), restrictions (edge_id, type).  An edge closed twice displaces its flow once.
    """
    closed = restrictions.where("type = 'full'").select("edge_id").distinct()
    gone = flows.join(closed, "edge_id", "left_semi").where("flow > 0").join(edges.select("edge_id", "u", "v"), "edge_id")
    return gone.select(F.col("u").alias("origin"), F.col("v").alias("destination"), F.col("flow").alias("volume")), flows.join(closed, "edge_id", "left_anti")


def flow_columns(edges: DataFrame, flows: DataFrame, observed: DataFrame) -> DataFrame:
    """edges (edge_id, capacity_vph, speed_kph) with flow, ratio to capacity, modelled speed and what is known of the flow.

    flows (edge_id, flow), observed (edge_id, split).
    """
    out = edges.join(flows.select("edge_id", "flow"), "edge_id", "left").join(observed.select("edge_id", "split"), "edge_id", "left")
    out = out.withColumn("flow", F.coalesce("flow", F.lit(0.0))).withColumn("ratio", F.col("flow") / F.greatest("capacity_vph", F.lit(1.0)))
    evidence = F.when(F.col("split") == "train", "observed_constraint_train").when(F.col("split") == "holdout", "observed_validation_holdout").when(F.col("flow") > 0, "modeled_proxy_path").otherwise("no_proxy_path_flow")
    return out.withColumns({"modeled_speed_kph": F.col("speed_kph") / (1 + DELAY * F.pow("ratio", F.lit(POWER))), "flow_evidence": evidence}).drop("split")


def congestion_by_speed(speed: Column, allowed: Column) -> Column:
    ratio = speed / F.greatest(allowed, F.lit(0.1))
    return F.when(ratio < 0.35, "heavy").when(ratio < 0.7, "slow").otherwise("free")


def congestion_by_volume(ratio: Column) -> Column:
    return F.when(ratio >= 1, "heavy").when(ratio >= 0.72, "slow").otherwise("free")


def distribution(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """median, p85, p95 and maximum of each key to three places; null where a key has no values."""
    parts = {"median": 0.5, "p85": 0.85, "p95": 0.95}
    return df.groupBy(*keys).agg(*(F.bround(F.percentile(value, F.lit(q)), 3).alias(n) for n, q in parts.items()), F.bround(F.max(F.col(value).cast("double")), 3).alias("maximum"))


def rank_routes(routes: DataFrame, keys: list[str]) -> DataFrame:
    """routes (route_id, travel_seconds, distance_m, penalty_seconds, residential_m, edge_ids) -> the ranked ones of each key.

    fastest has the least time; reliable, of the others, the least share of penalties in its time, then the
    least time; balanced, of what is left, the least time against the fastest plus residential share plus a quarter
    of the share of its edges that the fastest has.  Ties go to the smaller route_id.
    """
    first = routes.groupBy(*keys).agg(F.min_by(F.struct("route_id", "travel_seconds", "edge_ids"), F.struct("travel_seconds", "route_id")).alias("f"))
    r = routes.join(first, keys)
    r = r.withColumn("overlap", F.coalesce(F.try_divide(F.size(F.array_intersect("edge_ids", "f.edge_ids")), F.size(F.array_distinct("edge_ids"))), F.lit(0.0)))
    share = F.col("penalty_seconds") / F.greatest("travel_seconds", F.lit(1.0))
    others = r.where("route_id <> f.route_id")
    second = others.groupBy(*keys).agg(F.min_by("route_id", F.struct(share, "travel_seconds", "route_id")).alias("second"))
    worth = F.col("travel_seconds") / F.greatest("f.travel_seconds", F.lit(1.0)) + F.col("residential_m") / F.greatest("distance_m", F.lit(1.0)) + 0.25 * F.col("overlap")
    third = others.join(second, keys).where("route_id <> second").groupBy(*keys).agg(F.min_by("route_id", F.struct(worth, "route_id")).alias("third"))
    out = r.join(second, keys, "left").join(third, keys, "left")
    ranking = F.when(F.col("route_id") == F.col("f.route_id"), "fastest").when(F.col("route_id") == F.col("second"), "reliable").when(F.col("route_id") == F.col("third"), "balanced")
    percent = lambda x: F.bround(100 * x, 1)
    return out.withColumn("ranking", ranking).where("ranking IS NOT NULL").select(*keys, "ranking", "route_id", percent(F.col("overlap")).alias("overlap_percent"), percent(F.col("residential_m") / F.greatest("distance_m", F.lit(1.0))).alias("residential_percent"))


def valid_paths(paths: DataFrame, key: str = "path_id") -> DataFrame:
    """paths (node_ids, edge_ids) with a reason: empty, sizes, repeated id, or null where nothing is wrong."""
    again = paths.groupBy(key).agg((F.count("*") > 1).alias("_again"))
    reason = F.when(F.size("edge_ids") < 1, "empty").when(F.size("node_ids") != F.size("edge_ids") + 1, "sizes").when(F.col("_again"), "repeated")
    return paths.join(again, key).withColumn("reason", reason).drop("_again")


def with_ends(paths: DataFrame, first_node: Column, first_edge: Column, last_edge: Column, last_node: Column) -> DataFrame:
    """Paths with an edge put before and one behind."""
    return paths.withColumns({"node_ids": F.concat(F.array(first_node), "node_ids", F.array(last_node)), "edge_ids": F.concat(F.array(first_edge), "edge_ids", F.array(last_edge))})


def expected_dates(spark, first: str, last: str, weekdays: tuple[int, ...]) -> DataFrame:
    """(date) of the days from first to last on ISO weekdays (1 is Monday)."""
    days = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).alias("date"))
    return days.where((F.weekday("date") + 1).isin(*weekdays))


def date_chunks(spark, first: str, last: str, days: int, weekdays: tuple[int, ...], highways: DataFrame, resolution: str) -> DataFrame:
    """(id, highway_id, start_date, end_date) for each chunk of days and each highway (highway_id).

    Chunks of one day on a weekday that is not asked for (1 is Sunday) are left out; the last chunk may be shorter.
    """
    starts = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)), F.expr(f"INTERVAL {days} DAY"))).alias("start"))
    if days == 1:
        starts = starts.where(F.dayofweek("start").isin(*weekdays))
    ends = F.least(F.to_date(F.lit(last)), F.date_add("start", days - 1))
    rows = highways.select("highway_id").crossJoin(F.broadcast(starts.withColumn("end", ends)))  # a row for each chunk
    start, end = F.col("start").cast("string"), F.col("end").cast("string")
    name = F.concat(F.lit("highway-"), F.col("highway_id").cast("string"), F.lit("_"), start, F.lit("_"), end, F.lit("_" + resolution.replace(":", "-")))
    return rows.select(name.alias("id"), "highway_id", start.alias("start_date"), end.alias("end_date"))


def highway_of_chunk(chunk_id: Column) -> Column:
    """The highway of a chunk's id; null where there is none."""
    return F.regexp_extract(chunk_id, r"^highway-(\d+)_", 1).try_cast("long")


def running_counts(events: DataFrame, run: str, order: list[str], kind: str, kinds: tuple[str, ...]) -> DataFrame:
    """events with how many of each kind there were so far in their run, and the largest progress so far."""
    w = Window.partitionBy(run).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = events.withColumns({f"{k}_so_far": F.count_if(F.col(kind) == k).over(w) for k in kinds})
    return out.withColumn("progress", F.max("progress").over(w)) if "progress" in events.columns else out


def flag_union(left: Column, right: Column) -> Column:
    """Flags of both arrays, once each and in order; a null array counts as empty."""
    empty = F.array().cast("array<string>")
    return F.array_sort(F.array_union(F.coalesce(left, empty), F.coalesce(right, empty)))
