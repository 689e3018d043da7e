"""Edge priors: values by a cascade of sources with provenance, corridor consensus, capacity, control, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Class defaults: fixed values.
SPEEDS = {"motorway": 100.0, "motorway_link": 70.0, "trunk": 80.0, "trunk_link": 60.0, "primary": 60.0, "primary_link": 50.0, "secondary": 50.0, "secondary_link": 45.0, "tertiary": 45.0, "tertiary_link": 40.0, "unclassified": 35.0, "residential": 30.0, "living_street": 15.0, "service": 20.0, "track": 15.0}
LANES = {"motorway": 3, "motorway_link": 1, "trunk": 2, "trunk_link": 1, "primary": 2, "primary_link": 1, "secondary": 2, "secondary_link": 1, "tertiary": 2, "tertiary_link": 1, "unclassified": 1, "residential": 1, "living_street": 1, "service": 1, "track": 1}
LANE_CAPACITY = {"motorway": 2000.0, "motorway_link": 1600.0, "trunk": 1800.0, "trunk_link": 1500.0, "primary": 1600.0, "primary_link": 1300.0, "secondary": 1400.0, "secondary_link": 1200.0, "tertiary": 1200.0, "tertiary_link": 1000.0, "unclassified": 900.0, "residential": 700.0, "living_street": 400.0, "service": 400.0, "track": 250.0}
SPEED_RANGE, LANE_RANGE = 16.2, 1.0


def by_class(road_class: Column, table: dict, default) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(road_class == k, F.lit(v)).otherwise(out)
    return out


def cascade(sources: list[tuple[str, Column, str]]) -> tuple[Column, Column, Column]:
    """(value, source, confidence) of the first source that has one; sources are (name, value, confidence)."""
    value = F.coalesce(*(v for _, v, _ in sources))
    name, sure = F.lit(None).cast("string"), F.lit(None).cast("string")
    for n, v, c in reversed(sources):
        name, sure = F.when(v.isNotNull(), n).otherwise(name), F.when(v.isNotNull(), c).otherwise(sure)
    return value, name, sure


def corridor_consensus(df: DataFrame, keys: list[str], value: str, spread: float, least: int = 2) -> DataFrame:
    """Median of corridors with enough values that stay within the spread."""
    g = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.median(value).alias("consensus"), F.count("*").alias("n"), (F.max(value) - F.min(value)).alias("spread"))
    return g.where((F.col("n") >= least) & (F.col("spread") <= spread))


def resolve(edges: DataFrame, corridor: str = "corridor", within: tuple[str, ...] = ()) -> DataFrame:
    """edges with speed, lanes and capacity, each with source and confidence.

    edges: road_class, authority_speed with authority_source and authority_confidence (of the source
    matched, null without one), osm_speed and osm_lanes (explicit tags only), the corridor and the
    columns ``within`` which it is one (tiles).  A speed is the authority's, else the tag's, else the
    consensus of the corridor's edges of the class that have one, else the class default; lanes the same
    without an authority.  An edge without a corridor (null or empty) has no neighbours.  Capacity is
    lanes times the class's lane capacity and as sure as the lanes.
    """
    c, keys = F.col("road_class"), [corridor, "road_class", *within]
    known = edges.withColumn("_s", F.coalesce("authority_speed", "osm_speed"))
    named = known.where(F.col(corridor) != "")
    speed = corridor_consensus(named, keys, "_s", SPEED_RANGE).select(*keys, F.col("consensus").alias("_cs"))
    lanes = corridor_consensus(named, keys, "osm_lanes", LANE_RANGE).select(*keys, F.col("consensus").alias("_cl"))
    out = known.join(speed, keys, "left").join(lanes, keys, "left")
    near, by_default = "same_corridor_neighbor", "road_class_default"
    v, s, k = cascade([("authority", F.col("authority_speed"), "high"), ("osm_explicit", F.col("osm_speed"), "medium"), (near, F.col("_cs"), "low"), (by_default, by_class(c, SPEEDS, 30.0), "low")])
    official = F.col("authority_speed").isNotNull()
    out = out.withColumns({"speed_kph": v, "speed_source": F.when(official, F.col("authority_source")).otherwise(s), "speed_confidence": F.when(official, F.col("authority_confidence")).otherwise(k)})
    v, s, k = cascade([("osm_explicit", F.col("osm_lanes"), "medium"), (near, F.col("_cl"), "low"), (by_default, by_class(c, LANES, 1).cast("double"), "low")])
    out = out.withColumns({"lanes": F.greatest(F.lit(1.0), v), "lanes_source": s, "lanes_confidence": k})
    capacity = F.col("lanes") * by_class(c, LANE_CAPACITY, 700.0)
    return out.withColumns({"capacity_vph": capacity, "capacity_source": F.lit("road_class_x_resolved_lanes"), "capacity_confidence": F.col("lanes_confidence")}).drop("_s", "_cs", "_cl")


def weighted_evidence(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """Mean weighted by observations; a row without the value still counts in the weights."""
    return df.groupBy(*keys).agg(F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight)).alias("mean"), F.sum(weight).alias("weight"))


def evidence_pivot(df: DataFrame, key: str, period: str, periods: dict[str, str], value: str, count: str) -> DataFrame:
    """One row a key with value, count and availability for each period ({value in data: prefix})."""
    columns = []
    for p, prefix in periods.items():
        here = F.col(period) == p
        columns += [F.max(F.when(here, F.col(value))).alias(f"{prefix}_{value}"), F.coalesce(F.sum(F.when(here, F.col(count))), F.lit(0)).alias(f"{prefix}_{count}"), F.coalesce(F.bool_or(here), F.lit(False)).alias(f"{prefix}_available")]
    return df.groupBy(key).agg(*columns)


def controls(edges: DataFrame, osm: DataFrame, official: DataFrame) -> DataFrame:
    """Control at the end of each edge: the official one, else the mapped one, else none."""
    out = edges.join(osm.select(F.col("node_id").alias("v"), F.col("control").alias("_m")), "v", "left").join(official.select(F.col("node_id").alias("v"), F.col("control").alias("_o")), "v", "left")
    source = F.when(F.col("_o").isNotNull(), "official").when(F.col("_m").isNotNull(), "osm").otherwise("none")
    return out.withColumns({"control": F.coalesce("_o", "_m", F.lit("none")), "control_source": source}).drop("_m", "_o")


def edge_costs(edges: DataFrame) -> DataFrame:
    """Free-flow time and routing cost with the penalties of service, residential and unpaved roads."""
    seconds = F.col("length_m") / (F.col("speed_kph") / 3.6)
    return edges.withColumns({"free_flow_seconds": seconds, "cost": seconds * F.col("service_penalty") * F.col("residential_penalty") * F.col("surface_penalty")})
