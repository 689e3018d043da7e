"""Scored matches: stations to edges, authority lines to edges, identity across graph versions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lanewright.functions import geo
from lanewright.session import ensure_checkpoints

# Weights, limits and class scores: fixed values.
CLASS_SCORES = {"motorway": 8.0, "trunk": 7.0, "motorway_link": 6.0, "trunk_link": 5.0, "primary": 2.0, "primary_link": 1.0, "secondary": -4.0, "secondary_link": -4.0}
MAX_DISTANCE, REVIEW_DISTANCE, REVIEW_BEARING, LEAST_SCORE, LEAST_MARGIN, SAME_WAY = 250.0, 100.0, 55.0, 45.0, 8.0, 25.0


def class_score(road_class: Column) -> Column:
    out = F.lit(-10.0)
    for name, score in CLASS_SCORES.items():
        out = F.when(road_class == name, F.lit(score)).otherwise(out)
    return out


def evidence(ours: Column, theirs: Column) -> Column:
    """match, mismatch, or unknown where either set of tokens is empty."""
    return F.when((F.size(ours) > 0) & (F.size(theirs) > 0), F.when(F.arrays_overlap(ours, theirs), "match").otherwise("mismatch")).otherwise("unknown")


def score_candidates(pairs: DataFrame) -> DataFrame:
    """pairs (distance, bearing, target_bearing, tokens, target_tokens, road_class, road_form) with their score."""
    link = F.col("road_class").endswith("_link")
    turn = F.coalesce(geo.bearing_difference(F.col("bearing"), F.col("target_bearing")), F.lit(180.0))
    form = F.when(F.col("road_form") == "unknown", "unknown").when((F.col("road_form") == "link") == link, "match").otherwise("mismatch")
    out = pairs.withColumns({"bearing_difference": turn, "route_evidence": evidence(F.col("target_tokens"), F.col("tokens")), "form_evidence": form})
    pick = lambda c, yes, no: F.when(F.col(c) == "match", F.lit(yes)).when(F.col(c) == "mismatch", F.lit(no)).otherwise(F.lit(0.0))
    score = F.greatest(F.lit(0.0), 42 * (1 - F.col("distance") / MAX_DISTANCE)) + 34 * (1 - F.col("bearing_difference") / 90) + pick("route_evidence", 32.0, -36.0) + pick("form_evidence", 10.0, -10.0) + class_score(F.col("road_class"))
    return out.withColumn("score", F.bround(score, 3))


def select_matches(scored: DataFrame, station: str = "station_id", edge: str = "edge_id") -> DataFrame:
    """The best edge of each station, its margin to the next one that isn't the same carriageway, and the status.

    A window over the candidates of a station, which the search radius bounds.
    """
    w = Window.partitionBy(station)
    best = F.first(F.struct("score", "road_class", "tokens", "bearing")).over(w.orderBy(F.desc("score"), "distance", edge).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ranked = scored.withColumns({"rank": F.row_number().over(w.orderBy(F.desc("score"), "distance", edge)), "_b": best})
    family = F.col("road_class").endswith("_link") == F.col("_b.road_class").endswith("_link")
    routes = evidence(F.col("_b.tokens"), F.col("tokens")) != "mismatch"
    same = family & routes & (geo.bearing_difference(F.col("bearing"), F.col("_b.bearing")) <= SAME_WAY)
    rival = F.max(F.when((F.col("rank") > 1) & ~same, F.col("score"))).over(w)
    return reviewed(ranked.withColumn("margin", F.col("_b.score") - rival).where("rank = 1").drop("_b", "rank"))


def reviewed(out: DataFrame) -> DataFrame:
    """Best edges (with margin) with the reasons for a review, and the status."""
    reasons = {
        "distance_over_limit": F.col("distance") > REVIEW_DISTANCE,
        "bearing_over_limit": F.col("bearing_difference") > REVIEW_BEARING,
        "route_reference_mismatch": F.col("route_evidence") == "mismatch",
        "road_form_mismatch": F.col("form_evidence") == "mismatch",
        "low_score": F.col("score") < LEAST_SCORE,
        "ambiguous_competing_edge": F.coalesce(F.col("margin") < LEAST_MARGIN, F.lit(False)),
    }
    out = out.withColumn("reasons", F.array_compact(F.array(*(F.when(c, n) for n, c in reasons.items()))))
    return out.withColumn("status", F.when(F.size("reasons") == 0, "accepted").otherwise("review"))


def _token_keys(tokens: str) -> Column:
    """Tokens marked, so that a missing one and no token at all have texts of their own."""
    return F.transform(F.coalesce(F.col(tokens).cast("array<string>"), F.array().cast("array<string>")), lambda t: F.coalesce(F.concat(F.lit("="), t), F.lit("~")))


#: What edges of one tier share: a token, being a link, the class score, having a bearing.
TIER = ["_tok", "_link", "_class", "_blind"]
CELL = ["_level", "_cx", "_cy", "_cb"]
ROWS = 250_000  # rows of edges, at all levels, that a task of the last join sorts at most
STATIONS = 500  # stations of a task, which meets many cells for each
SLACK = 0.01  # of scores, more than what rounding moves them


def _cell(level: Column, x: Column, y: Column, b: Column) -> list[Column]:
    """Cell of a level: from 2 * MAX_DISTANCE and the full circle on, each level halves all three sides."""
    n = F.pow(F.lit(2.0), level)
    at = lambda v: F.floor(v / (2 * MAX_DISTANCE) * n).cast("long")
    return [at(x).alias("_cx"), at(y).alias("_cy"), F.least(F.floor(F.pmod(b, F.lit(360.0)) / 360 * n), n - 1).cast("long").alias("_cb")]


def _tiered(edges: DataFrame) -> tuple[DataFrame, int]:
    """Edges that differ, each in its tiers, kept, and the finest level, at which few edges of a tier share a cell."""
    columns = ["ox", "oy", "bearing", "tokens", "road_class"]
    one = edges.where("ox IS NOT NULL AND oy IS NOT NULL").groupBy(*columns).agg(F.min("edge_id").alias("edge_id"))
    keys = _token_keys("tokens")
    link = F.coalesce(F.col("road_class").endswith("_link"), F.lit(False))
    tiers = one.withColumn("_tok", F.explode(F.when(F.size(keys) > 0, F.array_distinct(keys)).otherwise(F.array(F.lit("")))))
    tiers = tiers.withColumns({"_link": link, "_class": class_score(F.col("road_class")), "_blind": F.col("bearing").isNull()}).checkpoint()
    cells = tiers.groupBy(*TIER, *_cell(F.lit(0), F.col("ox"), F.col("oy"), F.lit(0.0))[:2]).count()
    most = cells.agg(F.max("count")).head()[0] or 1
    return tiers, min(12, 1 + math.ceil(math.log(most, 8)))


def _search(stations: DataFrame, tiers: DataFrame, finest: int, rival: bool = False) -> DataFrame:
    """Scored pairs of stations and edges within MAX_DISTANCE, among them all of the best score of each station.

    First a station meets one edge of each tier in each of the cells around it, from coarse to fine, one a level; the best score
    among these is a floor.  Then it meets the edges of a tier only as far, and as far off its bearing, as could still reach the floor,
    on a grid of about this size.  rival: stations have their best edge in _b; only edges of other carriageways count.
    """
    at = lambda name: F.coalesce(F.col(name).cast("double"), F.lit(0.0))
    levels = tiers.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(finest))))
    levels = levels.select("*", *_cell(F.col("_level"), F.col("ox"), F.col("oy"), at("bearing")))
    edge = [c for c in tiers.columns if c not in TIER]
    if rival:
        same = (F.col("road_class").endswith("_link") == F.col("_b.road_class").endswith("_link")) & (evidence(F.col("_b.tokens"), F.col("tokens")) != "mismatch") & (geo.bearing_difference(F.col("bearing"), F.col("_b.bearing")) <= SAME_WAY)
        other = ~same
    else:
        other = F.lit(True)

    def scored(pairs: DataFrame) -> DataFrame:
        return score_candidates(pairs.withColumn("distance", F.hypot(F.col("ox") - F.col("x"), F.col("oy") - F.col("y"))).where((F.col("distance") <= MAX_DISTANCE) & other))

    ours = stations.where("x IS NOT NULL AND y IS NOT NULL")
    ours = ours.repartition(math.ceil(ours.count() / STATIONS) or 1, "station_id")
    some = levels.groupBy(*CELL, *TIER).agg(F.min(F.struct(*edge)).alias("_e")).select(*CELL, "_e.*")
    own = ours.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(finest))))
    own = own.select("*", *_cell(F.col("_level"), F.col("x"), F.col("y"), at("target_bearing")))
    # Exploded rows are far more than what Spark takes them for, so these joins never broadcast.
    floors = scored(own.hint("merge").join(some, CELL)).groupBy("station_id").agg(F.max("score").alias("_floor"))

    # Tiers that are in reach, with the most that an edge of theirs can score.
    reach = lambda v, by, size: F.sequence(F.floor((F.col(v) - by) / size), F.floor((F.col(v) + by) / size))
    wide = 2 * MAX_DISTANCE
    there = levels.where("_level = 0").select("_cx", "_cy", *TIER).distinct()
    near = ours.join(floors, "station_id", "left").withColumn("_cx", F.explode(reach("x", MAX_DISTANCE + 1e-6, wide))).withColumn("_cy", F.explode(reach("y", MAX_DISTANCE + 1e-6, wide)))
    near = near.join(there, ["_cx", "_cy"]).drop("_cx", "_cy")
    wanted = _token_keys("target_tokens")
    top = 76.0 + F.col("_class")
    top = top + F.when((F.col("_tok") == "") | (F.size(wanted) == 0), 0.0).when(F.array_contains(wanted, F.col("_tok")), 32.0).otherwise(-36.0)
    top = top + F.when(F.col("road_form") == "unknown", 0.0).when((F.col("road_form") == "link") == F.col("_link"), 10.0).otherwise(-10.0)
    blind = F.col("_blind") | F.col("target_bearing").isNull()
    # The least turn of a rival that must differ from the best edge in its bearing.
    least, inside = F.lit(0.0), F.lit(False)
    if rival:
        theirs = F.filter(_token_keys("_b.tokens"), lambda t: t != "~")
        alike = (F.col("_link") == F.coalesce(F.col("_b.road_class").endswith("_link"), F.lit(False))) & ((F.col("_tok") == "") | (F.coalesce(F.size("_b.tokens"), F.lit(0)) <= 0) | F.array_contains(theirs, F.col("_tok")))
        inside = F.coalesce(alike & F.col("_b.bearing").isNotNull() & ~blind, F.lit(False))
        least = F.when(inside, F.greatest(F.lit(0.0), SAME_WAY - geo.bearing_difference(F.col("target_bearing"), F.col("_b.bearing")))).otherwise(0.0)
    top = F.coalesce(top, F.lit(126.0)) - 34 * F.when(blind, 180.0).otherwise(least) / 90
    near = near.withColumns({"_inside": inside, "_least": least, "_left": F.when(F.col("_floor").isNotNull(), top - F.col("_floor") + SLACK)}).where("_left IS NULL OR _left >= 0").distinct()

    # As far as the tier's edges can reach the floor.
    near = near.withColumns({"_far": F.coalesce(F.least(F.lit(MAX_DISTANCE), F.col("_left") * MAX_DISTANCE / 42), F.lit(MAX_DISTANCE)) + 1e-6, "_turn": F.coalesce(F.least(F.lit(180.0), F.col("_least") + F.col("_left") * 90 / 34), F.lit(180.0)) + 1e-6})
    near = near.withColumn("_level", F.greatest(F.lit(0), F.least(F.lit(finest), F.floor(F.log2(wide / F.col("_far"))).cast("int"))))
    n = F.pow(F.lit(2.0), F.col("_level"))
    width = 360 / n
    every = F.col("target_bearing").isNull() | (2 * F.col("_turn") + width >= 360)
    slots = F.when(F.col("_blind"), F.array(F.lit(0).cast("long"))).when(every, F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).otherwise(
        F.transform(F.sequence(F.floor((F.col("target_bearing") - F.col("_turn")) / width), F.floor((F.col("target_bearing") + F.col("_turn")) / width)), lambda i: F.pmod(i, n.cast("long"))))
    if rival:
        slots = F.filter(slots, lambda i: ~(F.col("_inside") & (geo.bearing_difference((i + 0.5) * width, F.col("_b.bearing")) + width / 2 < SAME_WAY - 1e-6)))
    cells = near.withColumn("_cx", F.explode(reach("x", F.col("_far"), wide / n))).withColumn("_cy", F.explode(reach("y", F.col("_far"), wide / n))).withColumn("_cb", F.explode(slots))
    cells = cells.drop("_inside", "_least", "_left", "_far", "_turn")
    parts = math.ceil(tiers.count() * (finest + 1) / ROWS)
    if parts > int(tiers.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        cells, levels = (df.repartition(parts, *CELL, *TIER) for df in (cells, levels))
    return scored(cells.hint("merge").join(levels, [*CELL, *TIER])).where("_floor IS NULL OR score >= _floor").drop("_floor", *CELL, *TIER)


def match_stations(stations: DataFrame, edges: DataFrame) -> DataFrame:
    """select_matches of all pairs within MAX_DISTANCE, of which only those are made that can be a station's best or rival.

    stations (station_id, x, y, target_bearing, road_form, target_tokens), edges (edge_id, ox, oy, bearing, tokens, road_class).
    Edges that differ in nothing but their id are one, the least: another is never a rival of its like and scores the same.
    """
    ensure_checkpoints(stations.sparkSession)
    tiers, finest = _tiered(edges)
    found = _search(stations, tiers, finest)
    rest = [c for c in found.columns if c not in stations.columns]
    best = found.groupBy("station_id").agg(F.min_by(F.struct(*rest), F.struct((-F.col("score")).alias("s"), "distance", "edge_id")).alias("_b")).checkpoint()
    rivals = _search(stations.join(best.select("station_id", F.struct("_b.road_class", "_b.tokens", "_b.bearing").alias("_b")), "station_id"), tiers, finest, rival=True)
    second = rivals.groupBy("station_id").agg(F.max("score").alias("_rival"))
    out = best.select("station_id", "_b.*").join(second, "station_id", "left")
    return reviewed(out.withColumn("margin", F.col("score") - F.col("_rival")).drop("_rival"))


def status_pivot(matches: DataFrame, group: str, statuses: tuple[str, ...] = ("accepted", "review", "unmatched")) -> DataFrame:
    return matches.groupBy(group).agg(*(F.count_if(F.col("status") == s).alias(s) for s in statuses))


def reason_counts(df: DataFrame, column: str, by: str = "|") -> DataFrame:
    """Counts of the entries of separated text."""
    import re

    return df.select(F.explode(F.split(column, re.escape(by))).alias("reason")).where("reason <> ''").groupBy("reason").agg(F.count("*").alias("n"))


def authority_score(pairs: DataFrame) -> DataFrame:
    """overlap, distance, angle, agrees -> score of 100 and eligibility."""
    o, d, a = F.col("overlap"), F.col("distance"), F.col("angle")
    score = 60 * o + 20 * F.greatest(F.lit(0.0), 1 - d / 18) + 10 * F.greatest(F.lit(0.0), 1 - a / 35) + F.when(F.col("agrees"), 10.0).otherwise(0.0)
    eligible = (d <= 18) & (a <= 35) & (o >= 0.45) & (F.col("agrees") | ((o >= 0.82) & (a <= 15)))
    return pairs.withColumns({"score": score, "eligible": eligible})


def select_authority(df: DataFrame, key: str, score: str, value: str, source: str, eligible: str = "eligible", least_gap: float = 4.0, same: float = 0.5 * 1.609344) -> DataFrame:
    """The top candidate of each key, ambiguous where the next eligible one scores close by and says another value."""
    w = Window.partitionBy(key).orderBy(F.desc(eligible), F.desc(score), source)
    nxt = lambda c: F.lead(c).over(w)
    close = F.coalesce(nxt(eligible) & ((F.col(score) - nxt(score)) < least_gap) & (F.abs(F.col(value) - nxt(value)) > same), F.lit(False))
    ranked = df.withColumns({"rank": F.row_number().over(w), "ambiguous": F.col(eligible) & close})
    return ranked.where("rank = 1").drop("rank").withColumn("selected", F.col(eligible) & ~F.col("ambiguous"))


def connectors(df: DataFrame, keys: list[str], weight: str, order: str, k: int) -> DataFrame:
    """The k heaviest of each key with weights that sum to one."""
    w = Window.partitionBy(*keys)
    top = df.withColumn("rank", F.row_number().over(w.orderBy(F.desc(weight), order))).where(F.col("rank") <= k)
    return top.withColumn("share", F.col(weight) / F.sum(weight).over(w))


def nearest_values(left: DataFrame, right: DataFrame, keys: list[str], value: str, other: str, id_: str, k: int) -> DataFrame:
    """Pairs of rows that agree in keys, among them for each left row the k right ones with the nearest values, ties by id.

    Every left value meets the k nearest other values on either side and, of each, the k least ids: at most 2 * k * k pairs
    for a left row, however many rows have its keys or its value.  Values are dealt by range, ranked within a range and
    numbered on by the counts of the ranges before, and meet by these numbers.  Other values that are missing rank last;
    left rows without a value meet the k least ids of their keys.
    """
    ensure_checkpoints(left.sparkSession)
    first = lambda df, by: df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(id_))).where(F.col("_n") <= k).drop("_n")
    kept = first(right, [*keys, other])
    points = kept.select(*keys, F.col(other).alias("_v"), F.lit(0).alias("_left")).distinct().unionByName(left.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"), F.lit(1).alias("_left")).distinct())
    order = [F.col("_v").asc_nulls_last(), F.col("_left")]
    ranged = points.repartitionByRange(*(F.col(c) for c in keys), *order).withColumn("_part", F.spark_partition_id()).checkpoint()
    counts = ranged.groupBy(*keys, "_part").agg(F.count_if(F.col("_left") == 0).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    here = F.count_if(F.col("_left") == 0).over(Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    placed = ranged.withColumn("_here", here).join(counts.select(*keys, "_part", before.alias("_before")), [*keys, "_part"]).select(*keys, "_v", "_left", (F.col("_here") + F.col("_before")).alias("_at"))
    around = placed.where("_left = 1").select(*keys, F.col("_v").alias(value), F.explode(F.sequence(F.col("_at") - k + 1, F.col("_at") + k)).alias("_at"))
    near = around.join(placed.where("_left = 0").select(*keys, "_at", F.col("_v").alias(other)), [*keys, "_at"]).drop("_at")
    same = F.col(f"_r.{other}").eqNullSafe(F.col(f"_o.{other}"))
    for c in keys:
        same = same & (F.col(f"_r.{c}") == F.col(f"_o.{c}"))
    theirs = near.alias("_r").join(kept.alias("_o"), same).select(*(F.col(f"_r.{c}") for c in (*keys, value)), *(F.col(f"_o.{c}") for c in right.columns if c not in keys))
    # Without a value all are alike.
    alike = left.where(F.col(value).isNull()).join(first(right, keys), keys)
    return left.join(theirs, [*keys, value]).unionByName(alike)


def connector_weight(hierarchy: Column, lanes: Column, speed: Column, distance: Column) -> Column:
    return hierarchy * lanes * F.sqrt(speed) / (1 + distance / 500)


def mapping_status(overlap: Column, angle: Column, endpoints: Column) -> Column:
    """accepted, review or unmatched for two edges' shares of overlap, angle and equal endpoints."""
    good = (angle <= 45) & ((overlap >= 0.88) | (endpoints & (overlap >= 0.70)))
    return F.when(overlap.isNull(), "unmatched").when(good, "accepted").otherwise("review")


def all_accepted(df: DataFrame, key: str, target: str, status: str = "status") -> DataFrame:
    """Targets of keys of which every row is accepted and at least one has a target."""
    g = df.groupBy(key).agg(F.bool_and(F.col(status) == "accepted").alias("_ok"), F.array_sort(F.collect_set(target)).alias("targets"))
    return g.where("_ok AND size(targets) > 0").drop("_ok")


def shared_ids(left: DataFrame, right: DataFrame, a: str, b: str, ids: str) -> DataFrame:
    """Pairs of keys whose id arrays share an entry, each once.

    A pair is made only where the least entry that both share is met, so the pairs, of which there are far more than rows, move
    nowhere to be told apart.  Arrays travel with their entries: they are short.
    """
    def spread(df: DataFrame, key: str, name: str) -> DataFrame:
        whole = df.groupBy(key).agg(F.array_distinct(F.flatten(F.collect_list(ids))).alias(name))
        return whole.select(key, name, F.explode(name).alias("_id"))

    met = spread(left, a, "_ours").join(spread(right, b, "_theirs"), "_id")
    return met.where(F.array_min(F.array_intersect("_ours", "_theirs")) == F.col("_id")).select(a, b)


def rematch(old: DataFrame, new: DataFrame, identity: list[str], fallback: list[str], edge: str = "edge_id") -> DataFrame:
    """The new edge of each old one: by its full identity, else by the fallback where that is unique."""
    unique = new.groupBy(*fallback).agg(F.count("*").alias("_n"), F.min(edge).alias("_f")).where("_n = 1").drop("_n")
    exact = new.groupBy(*identity).agg(F.min(edge).alias("_e"))
    out = old.join(exact, identity, "left").join(unique, fallback, "left")
    status = F.when(F.col("_e").isNotNull(), "accepted").when(F.col("_f").isNotNull(), "fallback").otherwise("unmatched")
    return out.withColumns({"new_edge_id": F.coalesce("_e", "_f"), "status": status}).drop("_e", "_f")
