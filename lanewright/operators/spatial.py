"""Joins by distance on a grid: an equi-join on cells, refined by exact distances.

The side that is spread over the cells around it should be the smaller one; no pair is made
that isn't in neighbouring cells, so work follows the local density, not the product of both sides.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewright.functions import geo


def _around(x: Column, size: float) -> Column:
    c = geo.cell(x, size)
    return F.explode(F.sequence(c - 1, c + 1))


def points_within(left: DataFrame, right: DataFrame, radius: float, xy: tuple[str, str] = ("x", "y"), other: tuple[str, str] = ("ox", "oy")) -> DataFrame:
    """Pairs of points at most radius apart, with their distance; the right side is spread."""
    a = left.withColumns({"_cx": geo.cell(F.col(xy[0]), radius), "_cy": geo.cell(F.col(xy[1]), radius)})
    b = right.withColumn("_cx", _around(F.col(other[0]), radius)).withColumn("_cy", _around(F.col(other[1]), radius))
    d = F.hypot(F.col(xy[0]) - F.col(other[0]), F.col(xy[1]) - F.col(other[1]))
    return a.join(b, ["_cx", "_cy"]).drop("_cx", "_cy").withColumn("distance", d).where(F.col("distance") <= radius)


def nearest_within(left: DataFrame, right: DataFrame, keys: list[str], order: str, radius: float, xy: tuple[str, str] = ("x", "y"), other: tuple[str, str] = ("ox", "oy")) -> DataFrame:
    """The nearest right point of each left one within radius, ties by ``order``; left rows without one are not there."""
    pairs = nearest_pairs(left, right, order, radius, xy, other)
    rest = [c for c in pairs.columns if c not in keys]
    return pairs.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("distance", order)).alias("_n")).select(*keys, "_n.*")


def nearest_pairs(left: DataFrame, right: DataFrame, order: str, radius: float, xy: tuple[str, str], other: tuple[str, str]) -> DataFrame:
    """Pairs of points at most radius apart, with their distance, among them the nearest of each left point.

    Cells of the radius are halved until they hold few right points.  The farthest that a left point can be from the box of the right
    points in its own cell, at the best level, bounds its nearest; then it meets the cells this near, of about this size.
    Right points at one place are one, the first by ``order``.
    """
    at = lambda v, level: F.floor(v / radius * F.pow(F.lit(2.0), level)).cast("long")
    x, y, ox, oy = (F.col(c) for c in (*xy, *other))
    rest = [c for c in right.columns if c not in other]
    points = right.where(ox.isNotNull() & oy.isNotNull()).groupBy(*other).agg(F.min_by(F.struct(*rest), F.struct(order)).alias("_r")).select(*other, "_r.*")
    most = points.groupBy(at(ox, F.lit(0)), at(oy, F.lit(0))).count().agg(F.max("count")).head()[0] or 1
    finest = min(24, 1 + math.ceil(math.log(most, 4)))
    leveled = lambda df: df.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(finest))))
    cell = ["_level", "_cx", "_cy"]
    b = leveled(points).withColumns({"_cx": at(ox, F.col("_level")), "_cy": at(oy, F.col("_level"))})
    boxes = b.groupBy(*cell).agg(F.min(ox).alias("_x0"), F.max(ox).alias("_x1"), F.min(oy).alias("_y0"), F.max(oy).alias("_y1"))
    off = lambda v, lo, hi: F.greatest(F.abs(v - F.col(lo)), F.abs(v - F.col(hi)))
    own = leveled(left.where(x.isNotNull() & y.isNotNull())).withColumns({"_cx": at(x, F.col("_level")), "_cy": at(y, F.col("_level"))})
    # Rows of all levels are far more than what Spark takes them for, so these joins never broadcast.
    bound = F.min(F.hypot(off(x, "_x0", "_x1"), off(y, "_y0", "_y1")))
    a = own.hint("merge").join(boxes, cell, "left").groupBy(*left.columns).agg(F.least(bound, F.lit(float(radius))).alias("_far"))
    # A little farther, for what rounding leaves.
    a = a.withColumn("_far", F.col("_far") * (1 + 1e-9) + (F.abs(x) + F.abs(y) + radius) * 1e-12)
    a = a.withColumn("_level", F.greatest(F.lit(0), F.least(F.lit(finest), F.floor(F.log2(radius / F.col("_far"))).cast("int"))))
    for name, v in (("_cx", x), ("_cy", y)):
        a = a.withColumn(name, F.explode(F.sequence(at(v - F.col("_far"), F.col("_level")), at(v + F.col("_far"), F.col("_level")))))
    d = F.hypot(x - ox, y - oy)
    return a.hint("merge").join(b, cell).withColumn("distance", d).where((d <= radius) & (d <= F.col("_far"))).drop(*cell, "_far")


def line_cells(line: Column, size: float, margin: float) -> Column:
    """Cells that a line's segments' boxes, widened by margin, touch."""
    def cells(s: Column) -> Column:
        lo = lambda f: geo.cell(F.least(s["a"][f], s["b"][f]) - margin, size)
        hi = lambda f: geo.cell(F.greatest(s["a"][f], s["b"][f]) + margin, size)
        return F.flatten(F.transform(F.sequence(lo("x"), hi("x")), lambda i: F.transform(F.sequence(lo("y"), hi("y")), lambda j: F.struct(i.alias("cx"), j.alias("cy")))))

    return F.array_distinct(F.flatten(F.transform(geo.segments(line), cells)))


def points_near_lines(points: DataFrame, lines: DataFrame, radius: float, line: str = "line", xy: tuple[str, str] = ("x", "y"), size: float | None = None) -> DataFrame:
    """Point and line rows at most radius apart, with their distance."""
    size = size or 4 * radius
    a = points.withColumns({"_c": F.struct(geo.cell(F.col(xy[0]), size).alias("cx"), geo.cell(F.col(xy[1]), size).alias("cy"))})
    b = lines.withColumn("_c", F.explode(line_cells(F.col(line), size, radius)))
    return a.join(b, "_c").drop("_c").withColumn("distance", geo.point_line(F.col(xy[0]), F.col(xy[1]), F.col(line))).where(F.col("distance") <= radius)


def lines_near_lines(left: DataFrame, right: DataFrame, within: float, ids: tuple[str, str], line: str = "line", other: str = "other", size: float = 200.0) -> DataFrame:
    """Line pairs within the distance, with distance, share of overlap and undirected angle."""
    cells = lambda df, c, m: df.withColumn("_c", F.explode(line_cells(F.col(c), size, m)))
    pairs = cells(left, line, within).join(cells(right, other, 0.0), "_c").drop("_c").dropDuplicates(list(ids))
    pairs = pairs.withColumn("distance", geo.line_line(F.col(line), F.col(other))).where(F.col("distance") <= within)
    return pairs.withColumns({"overlap": geo.overlap_fraction(F.col(line), F.col(other), within), "angle": geo.undirected_difference(geo.line_bearing(F.col(line)), geo.line_bearing(F.col(other)))})


def tile_representatives(nodes: DataFrame, size: float, activity: str, node: str, xy: tuple[str, str] = ("x", "y")) -> DataFrame:
    """The most active node of each tile, ties by node: an aggregate, not a sort."""
    tile = [geo.cell(F.col(xy[0]), size).alias("tile_x"), geo.cell(F.col(xy[1]), size).alias("tile_y")]
    best = F.min_by(F.struct(*nodes.columns), F.struct((-F.col(activity)).alias("a"), F.col(node)))
    return nodes.groupBy(*tile).agg(best.alias("n")).select("tile_x", "tile_y", "n.*")


def select_zones(nodes: DataFrame, count: int, activity: str = "activity", node: str = "node_id", tile: float = 1000.0, limit: int = 50_000):
    """Zone nodes by greedy choice: .75 of the distance to the nearest chosen one and .25 of activity, after one node a tile.

    Tiles bound what reaches the driver; more than ``limit`` of them is an error, larger tiles the answer.
    """
    import numpy as np

    reps = tile_representatives(nodes, tile, activity, node).select(node, "x", "y", activity).limit(limit + 1).toPandas()
    if len(reps) > limit:
        raise ValueError(f"over {limit} tiles: choose larger ones")
    reps = reps.sort_values([activity, node], ascending=[False, True]).reset_index(drop=True)
    xy, act = reps[["x", "y"]].to_numpy(float), np.log1p(reps[activity].to_numpy(float))
    diagonal = float(np.hypot(*(xy.max(0) - xy.min(0)))) if len(xy) else 1.0
    act, chosen = act / max(act.max(initial=0), 1e-9), [0] if len(xy) else []
    near = np.hypot(*(xy - xy[0]).T) if len(xy) else np.zeros(0)
    while len(chosen) < min(count, len(xy)):
        score = 0.75 * near / max(diagonal, 1e-9) + 0.25 * act
        score[chosen] = -np.inf
        chosen.append(int(np.argmax(score)))
        near = np.minimum(near, np.hypot(*(xy - xy[chosen[-1]]).T))
    return nodes.sparkSession.createDataFrame(reps.iloc[chosen].assign(zone=range(len(chosen)))) if chosen else nodes.limit(0)


def centroids(points: DataFrame, keys: list[str], xy: tuple[str, str] = ("x", "y")) -> DataFrame:
    return points.groupBy(*keys).agg(F.avg(xy[0]).alias("x"), F.avg(xy[1]).alias("y"), F.count("*").alias("n"))


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by order."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), F.struct(*order)).alias("_r")).select(*keys, "_r.*")
