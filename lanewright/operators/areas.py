"""Polygons and exact lines: points in zones by a covering of cells, circles, overlap of lines by segments.

A shape is an array of polygons, each an array of rings, each an array of points (structs x, y), first the outer
ring, then holes.  Points meet zones by cells of a grid: cells that no ring touches lie wholly inside or
outside, so their points need no test; only points in cells that a ring touches are tested, against the
rings of that polygon.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewright.functions import geo

SHAPE = "array<array<array<struct<x:double,y:double>>>>"


def _let(value: Column, use) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _difference(a: Column, b: Column) -> Column:
    """a - b as a rounded value and what rounding left."""
    d = a - b
    z = a - d
    return F.struct(d.alias("hi"), ((a - (d + z)) + (z - b)).alias("lo"))


def _product(a: Column, b: Column) -> Column:
    """a * b as a rounded value and what rounding left, by halves of the digits."""
    half = lambda v: v * 134217729.0 - (v * 134217729.0 - v)
    p, ah, bh = a * b, half(a), half(b)
    al, bl = a - ah, b - bh
    return F.struct(p.alias("hi"), (al * bl - (((p - ah * bh) - al * bh) - ah * bl)).alias("lo"))


def side(s: Column, x: Column, y: Column) -> Column:
    """Above zero where a point lies left of a segment, 0 on its line; null for values that are no numbers.

    Where rounding could turn the sign, products and differences are taken with what rounding left of them.
    """
    ax, ay, bx, by = s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"]
    one, two = (bx - ax) * (y - ay), (by - ay) * (x - ax)

    def exact(d: Column) -> Column:
        rest = lambda p, q: d[p]["hi"] * d[q]["lo"] + d[p]["lo"] * d[q]["hi"] + d[p]["lo"] * d[q]["lo"]
        both = F.struct(_product(d["p"]["hi"], d["q"]["hi"]).alias("m"), _product(d["r"]["hi"], d["t"]["hi"]).alias("n"))
        return _let(both, lambda e: (e["m"]["hi"] - e["n"]["hi"]) + ((e["m"]["lo"] - e["n"]["lo"]) + (rest("p", "q") - rest("r", "t"))))

    parts = F.struct(_difference(bx, ax).alias("p"), _difference(y, ay).alias("q"), _difference(by, ay).alias("r"), _difference(x, ax).alias("t"))
    return F.when(F.isnan(one - two), F.lit(None).cast("double")).when(F.abs(one - two) > 3.4e-16 * (F.abs(one) + F.abs(two)), one - two).otherwise(_let(parts, exact))


def in_rings(x: Column, y: Column, rings: Column) -> Column:
    """Whether a polygon covers a point: its rings' segments to the right are odd in number, or the point is on one."""
    def on(s: Column) -> Column:
        near = x.between(F.least(s["a"]["x"], s["b"]["x"]), F.greatest(s["a"]["x"], s["b"]["x"])) & y.between(F.least(s["a"]["y"], s["b"]["y"]), F.greatest(s["a"]["y"], s["b"]["y"]))
        return near & (side(s, x, y) == 0)

    def right(s: Column) -> Column:
        at = side(s, x, y)
        return ((s["a"]["y"] > y) != (s["b"]["y"] > y)) & F.coalesce(F.when(s["b"]["y"] > s["a"]["y"], at > 0).otherwise(at < 0), F.lit(False))

    all_segments = F.flatten(F.transform(rings, geo.segments))
    return F.coalesce(F.exists(all_segments, on) | (F.pmod(F.size(F.filter(all_segments, right)), F.lit(2)) == 1), F.lit(False))


def ring_area(ring: Column) -> Column:
    """Area that a closed ring encloses."""
    return F.abs(F.aggregate(geo.segments(ring), F.lit(0.0), lambda t, s: t + s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"])) / 2


def _apart(s: Column, t: Column) -> Column:
    """Whether two segments have no point in common."""
    side = lambda p, q, r: (q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"])
    a, b, c, d = side(s["a"], s["b"], t["a"]), side(s["a"], s["b"], t["b"]), side(t["a"], t["b"], s["a"]), side(t["a"], t["b"], s["b"])
    boxes = lambda f: (F.greatest(s["a"][f], s["b"][f]) < F.least(t["a"][f], t["b"][f])) | (F.greatest(t["a"][f], t["b"][f]) < F.least(s["a"][f], s["b"][f]))
    return (a * b > 0) | (c * d > 0) | boxes("x") | boxes("y")


def segment_distance(s: Column, t: Column) -> Column:
    """Distance of two segments: 0 where they meet, else from an end of one to the other."""
    ends = F.least(*(geo.point_segment(p["x"], p["y"], q) for q, one in ((t, s), (s, t)) for p in (one["a"], one["b"])))
    return F.when(_apart(s, t), ends).otherwise(F.lit(0.0))


def valid_shape(shape: Column) -> Column:
    """Whether there is a polygon, and every ring is closed, has an area and touches itself nowhere but where its ends meet."""
    def ring_ok(ring: Column) -> Column:
        s, n = geo.segments(ring), F.size(ring)
        closed = (n >= 4) & (F.get(ring, F.lit(0)) == F.get(ring, n - 1))
        numbered = F.transform(s, lambda q, i: F.struct(i.alias("i"), q.alias("q")))
        # Neighbours share an end; others must lie apart.
        clash = F.exists(numbered, lambda p: F.exists(numbered, lambda o: (o["i"] > p["i"] + 1) & ~((p["i"] == 0) & (o["i"] == n - 2)) & ~_apart(p["q"], o["q"])))
        finite = F.forall(ring, lambda p: p["x"].isNotNull() & p["y"].isNotNull() & (F.abs(p["x"]) < float("inf")) & (F.abs(p["y"]) < float("inf")))
        return F.coalesce(closed & finite & (ring_area(ring) > 0) & ~clash, F.lit(False))

    return F.coalesce((F.size(shape) > 0) & F.forall(shape, lambda rings: (F.size(rings) > 0) & F.forall(rings, ring_ok)), F.lit(False))


def circle(x: Column, y: Column, radius: float, quarter: int = 16) -> Column:
    """The shape of a buffer around a point: one ring with so many sides a quarter, clockwise from the east."""
    turn = [-i * math.pi / (2 * quarter) for i in range(4 * quarter)] + [0.0]
    return F.array(F.array(F.array(*(F.struct((x + radius * math.cos(t)).alias("x"), (y + radius * math.sin(t)).alias("y")) for t in turn))))


def zone_buffers(connectors: DataFrame, radius: float = 750.0) -> DataFrame:
    """connectors (zone_id, zone_type, x, y) -> zone_id, zone_type, shape: a circle around the mean point of each zone."""
    centre = connectors.groupBy("zone_id", "zone_type").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    return centre.select("zone_id", "zone_type", circle(F.col("x"), F.col("y"), radius).alias("shape"))


def covering(polygons: DataFrame, size: float) -> DataFrame:
    """polygons (id, part, rings) -> id, part, cell (cx, cy) and whether it lies wholly inside.

    Touched cells come from the rings' segments, row of cells by row.  Every row of cells is cut at its middle by the rings;
    between an odd and the next even cut untouched cells are inside.
    """
    rings = polygons.select("id", "part", F.explode("rings").alias("ring"))
    steps = rings.select("id", "part", F.explode(geo.segments(F.col("ring"))).alias("s"))
    low, high, slack = F.least("s.a.y", "s.b.y"), F.greatest("s.a.y", "s.b.y"), size * 1e-6
    rows = steps.select("id", "part", "s", F.explode(F.sequence(geo.cell(low - slack, size), geo.cell(high + slack, size))).alias("cy"))
    # The segment's columns within a row of cells, from where it enters to where it leaves.
    slope = F.try_divide(F.col("s.b.x") - F.col("s.a.x"), F.col("s.b.y") - F.col("s.a.y"))
    ends = [F.coalesce(F.col("s.a.x") + slope * (F.least(high, F.greatest(low, (F.col("cy") + i) * size)) - F.col("s.a.y")), F.col(f"s.{p}.x")) for i, p in ((0, "a"), (1, "b"))]
    touched = rows.select("id", "part", F.explode(F.sequence(geo.cell(F.least(*ends) - slack, size), geo.cell(F.greatest(*ends) + slack, size))).alias("cx"), "cy").distinct()
    middle = (F.col("cy") + 0.5) * size
    crossed = rows.where((F.col("s.a.y") > middle) != (F.col("s.b.y") > middle))
    at = F.col("s.a.x") + (middle - F.col("s.a.y")) * (F.col("s.b.x") - F.col("s.a.x")) / (F.col("s.b.y") - F.col("s.a.y"))
    cuts = crossed.groupBy("id", "part", "cy").agg(F.sort_array(F.collect_list(at)).alias("x"))
    spans = cuts.select("id", "part", "cy", F.explode(F.transform(F.sequence(F.lit(0), (F.size("x") / 2).cast("int") - 1), lambda i: F.struct(F.get("x", 2 * i).alias("a"), F.get("x", 2 * i + 1).alias("b")))).alias("p"))
    filled = spans.select("id", "part", F.explode(F.sequence(geo.cell(F.col("p.a"), size), geo.cell(F.col("p.b"), size))).alias("cx"), "cy").distinct()
    inside = filled.join(touched, ["id", "part", "cx", "cy"], "left_anti")
    return inside.withColumn("inside", F.lit(True)).unionByName(touched.withColumn("inside", F.lit(False)))


def points_in_zones(points: DataFrame, zones: DataFrame, id_: str, size: float, shape: str = "shape", xy: tuple[str, str] = ("x", "y")) -> DataFrame:
    """Points, all their columns, with the id of every zone that covers them, once a zone; equal rows count once."""
    polygons = zones.select(F.col(id_).alias("id"), F.posexplode(shape).alias("part", "rings"))
    x, y = F.col(xy[0]).alias("_x"), F.col(xy[1]).alias("_y")
    placed = points.select(geo.cell(F.col(xy[0]), size).alias("cx"), geo.cell(F.col(xy[1]), size).alias("cy"), x, y, F.struct(*points.columns).alias("_p"))
    met = placed.join(covering(polygons, size), ["cx", "cy"])
    asked = met.where("NOT inside").join(polygons, ["id", "part"]).where(in_rings(F.col("_x"), F.col("_y"), F.col("rings")))
    return met.where("inside").select("_p", "id").unionByName(asked.select("_p", "id")).distinct().select("_p.*", F.col("id").alias(id_))


def _near_interval(within: float) -> Column:
    """Part of segment s, in metres from its start, that lies within a distance of segment t: the convex hull of what lies near its ends and along it; null if none."""
    s, t = F.col("s"), F.col("t")
    length = F.hypot(s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"])
    ux, uy = F.try_divide(s["b"]["x"] - s["a"]["x"], length), F.try_divide(s["b"]["y"] - s["a"]["y"], length)

    def around(p: Column) -> tuple[Column, Column, Column]:
        along = (p["x"] - s["a"]["x"]) * ux + (p["y"] - s["a"]["y"]) * uy
        off = F.pow(p["x"] - s["a"]["x"] - along * ux, 2) + F.pow(p["y"] - s["a"]["y"] - along * uy, 2)
        half = F.sqrt(F.when(off <= within * within, within * within - off))
        return F.greatest(F.lit(0.0), along - half), F.least(length, along + half), half

    # Along t: where the foot of a point of s falls on t and its distance from t's line is small enough.
    size = F.hypot(t["b"]["x"] - t["a"]["x"], t["b"]["y"] - t["a"]["y"])
    vx, vy = F.try_divide(t["b"]["x"] - t["a"]["x"], size), F.try_divide(t["b"]["y"] - t["a"]["y"], size)
    foot, side = (s["a"]["x"] - t["a"]["x"]) * vx + (s["a"]["y"] - t["a"]["y"]) * vy, (s["a"]["x"] - t["a"]["x"]) * vy - (s["a"]["y"] - t["a"]["y"]) * vx
    d_foot, d_side = ux * vx + uy * vy, ux * vy - uy * vx
    thin = 1e-12

    def band(start: Column, slope: Column, low: Column, high: Column) -> tuple[Column, Column]:
        flat = F.abs(slope) < thin
        one, two = F.try_divide(low - start, slope), F.try_divide(high - start, slope)
        inside = start.between(low, high)
        return F.when(flat, F.when(inside, 0.0).otherwise(1.0)).otherwise(F.least(one, two)), F.when(flat, F.when(inside, length).otherwise(0.0)).otherwise(F.greatest(one, two))

    f0, f1 = band(foot, d_foot, F.lit(0.0), size)
    w0, w1 = band(side, d_side, F.lit(-within), F.lit(within))
    p0, p1 = F.greatest(F.lit(0.0), f0, w0), F.least(length, f1, w1)
    found = [around(t[e]) for e in "ab"] + [(p0, p1, vx + ux)]
    # greatest and least pass over nulls, so what has no value is told by the third.
    lows = [F.when(there.isNotNull() & (a <= b), a) for a, b, there in found]
    highs = [F.when(there.isNotNull() & (a <= b), b) for a, b, there in found]
    return F.struct(F.least(*lows).alias("lo"), F.greatest(*highs).alias("hi"))


#: Lines of at most so many points and cells are paired as a whole, others by their segments.
POINTS, CELLS = 64, 64
#: Pairs of segments that are measured at once.
AT_ONCE = 100_000


def _apart_and_near(s: tuple, t: tuple, near: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """segment_distance and the ends of _near_interval (nan if none) for arrays of segments (ax, ay, bx, by)."""
    sax, say, sbx, sby = s
    tax, tay, tbx, tby = t
    turn = lambda px, py, qx, qy, rx, ry: (qx - px) * (ry - py) - (qy - py) * (rx - px)
    beside = lambda a, b, c, d: (np.maximum(a, b) < np.minimum(c, d)) | (np.maximum(c, d) < np.minimum(a, b))
    apart = (turn(sax, say, sbx, sby, tax, tay) * turn(sax, say, sbx, sby, tbx, tby) > 0) | (turn(tax, tay, tbx, tby, sax, say) * turn(tax, tay, tbx, tby, sbx, sby) > 0)
    apart |= beside(sax, sbx, tax, tbx) | beside(say, sby, tay, tby)

    def to(x, y, ax, ay, bx, by):
        dx, dy = bx - ax, by - ay
        whole = dx * dx + dy * dy
        f = np.where(whole == 0, 0.0, ((x - ax) * dx + (y - ay) * dy) / whole)
        f = np.minimum(1.0, np.maximum(0.0, f))
        return np.hypot(x - ax - f * dx, y - ay - f * dy)

    distance = np.where(apart, np.minimum(np.minimum(to(sax, say, *t), to(sbx, sby, *t)), np.minimum(to(tax, tay, *s), to(tbx, tby, *s))), 0.0)
    length, size = np.hypot(sbx - sax, sby - say), np.hypot(tbx - tax, tby - tay)
    # Without a length there is no direction: nan, which no comparison lets pass.
    ux, uy = (np.where(length == 0, np.nan, d / length) for d in (sbx - sax, sby - say))
    vx, vy = (np.where(size == 0, np.nan, d / size) for d in (tbx - tax, tby - tay))
    found = []
    for x, y in ((tax, tay), (tbx, tby)):
        along = (x - sax) * ux + (y - say) * uy
        off = (x - sax - along * ux) ** 2 + (y - say - along * uy) ** 2
        half = np.sqrt(np.where(off <= near * near, near * near - off, np.nan))
        found.append((np.maximum(0.0, along - half), np.minimum(length, along + half)))

    def band(start, slope, low, high):
        flat, inside = np.abs(slope) < 1e-12, (start >= low) & (start <= high)
        one, two = (low - start) / slope, (high - start) / slope
        return np.where(flat, np.where(inside, 0.0, 1.0), np.minimum(one, two)), np.where(flat, np.where(inside, length, 0.0), np.maximum(one, two))

    f0, f1 = band((sax - tax) * vx + (say - tay) * vy, ux * vx + uy * vy, 0.0, size)
    w0, w1 = band((sax - tax) * vy - (say - tay) * vx, ux * vy - uy * vx, -near, near)
    known = np.where(np.isnan(ux + vx), np.nan, 0.0)
    found.append((np.maximum(np.maximum(0.0, f0), w0) + known, np.minimum(np.minimum(length, f1), w1) + known))
    lo, hi = np.full(len(distance), np.nan), np.full(len(distance), np.nan)
    for a, b in found:
        good = a <= b
        lo, hi = np.where(good, np.fmin(lo, a), lo), np.where(good, np.fmax(hi, b), hi)
    return distance, lo, hi


def _measured(xs: list[np.ndarray], first: list[np.ndarray], parts: list[np.ndarray], near: float, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """Distance and covered length of pairs of lines: coordinates (ax, ay, bx, by) of all their points, each line's first point, its number of segments."""
    (ax, ay, bx, by), (i, j), (m, n) = xs, first, parts
    each = m * n
    pair = np.repeat(np.arange(len(m)), each)
    starts = np.cumsum(each) - each
    k = np.arange(len(pair)) - starts[pair]
    own = k // n[pair]
    p, q = i[pair] + own, j[pair] + k % n[pair]
    d, lo, hi = _apart_and_near((ax[p], ay[p], ax[p + 1], ay[p + 1]), (bx[q], by[q], bx[q + 1], by[q + 1]), near)
    distance = np.minimum.reduceat(d, starts)
    use = (d <= margin) & ~np.isnan(lo)
    # Intervals of one segment of a line are merged from the left; in the j-th step all segments merge their j-th.
    segment, lo, hi = (np.cumsum(m) - m)[pair[use]] + own[use], lo[use], hi[use]
    order = np.lexsort((hi, lo, segment))
    segment, lo, hi = segment[order], lo[order], hi[order]
    place = np.arange(len(segment)) - np.searchsorted(segment, segment)
    total, to = np.zeros(m.sum()), np.zeros(m.sum())
    for step in range(place.max() + 1 if len(place) else 0):
        at = place == step
        g = segment[at]
        total[g] += np.maximum(0.0, hi[at] - np.maximum(lo[at], to[g]))
        to[g] = np.maximum(to[g], hi[at])
    return distance, np.add.reduceat(total, np.cumsum(m) - m)


def _overlaps(batches: Iterable[pa.RecordBatch], within: float, near: float, ids: tuple[str, str], at_once: int) -> Iterator[pa.RecordBatch]:
    """Pairs of lines (ids, _length, coordinates as arrays _ax, _ay, _bx, _by) that are at most within apart, with distance and covered."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = [batch.column(c) for c in ("_ax", "_ay", "_bx", "_by")]
        xs = [x.flatten().to_numpy(zero_copy_only=False) for x in lists]
        points = [pc.list_value_length(lists[x]).to_numpy(zero_copy_only=False).astype(np.int64) for x in (0, 2)]
        first, parts = [np.cumsum(x) - x for x in points], [x - 1 for x in points]
        chunk = (np.cumsum(parts[0] * parts[1]) - 1) // at_once
        cuts = np.flatnonzero(np.diff(chunk, prepend=-1, append=chunk[-1] + 1))
        with np.errstate(divide="ignore", invalid="ignore"):
            got = [_measured(xs, [x[a:b] for x in first], [x[a:b] for x in parts], near, max(within, near)) for a, b in zip(cuts, cuts[1:], strict=False)]
        distance, covered = (np.concatenate(x) for x in zip(*got, strict=True))
        out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*ids, "_length")), pa.array(distance), pa.array(covered)], names=[*ids, "_length", "distance", "covered"])
        yield out.filter(pa.array(distance <= within))


def line_overlaps(left: DataFrame, right: DataFrame, within: float, ids: tuple[str, str], near: float | None = None, line: str = "line", other: str = "other", size: float | None = None) -> DataFrame:
    """Line pairs at most ``within`` apart: ids, exact distance, covered (length of the line at most ``near`` from the other), share of its length.

    Short lines (at most POINTS points, a box of at most CELLS cells) are paired as a whole in one cell only, the one that holds the lower left corner of what
    their boxes share, and measured there: pairs, of which there may be many more than lines, don't move.  Pairs with a longer line are made by segments.
    An id stands for one line.
    """
    near = within if near is None else near
    margin = max(within, near)
    size, parts = size or 4 * margin or 200.0, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def sorted_out(df: DataFrame, id_: str, c: str, m: float, name: str) -> tuple[DataFrame, DataFrame]:
        """Short lines with their boxes and coordinates; longer ones as they are."""
        of = lambda f: F.transform(c, lambda p: p[f].cast("double"))
        df = df.select(F.col(id_), F.col(c), of("x").alias("_x"), of("y").alias("_y")).where(F.size(c) >= 2)
        box = {f"_{name}{f}{e}": g(f"_{f}") for f in "xy" for e, g in ((0, F.array_min), (1, F.array_max))}
        cells = lambda f: geo.cell(F.col(f"_{name}{f}1") + m, size) - geo.cell(F.col(f"_{name}{f}0") - m, size) + 1
        finite = lambda v: F.forall(v, lambda p: p.isNotNull() & (F.abs(p) < 1e15 * size))
        small = F.when((F.size(c) <= POINTS) & finite("_x") & finite("_y"), (cells("x") <= CELLS) & (cells("y") <= CELLS) & (cells("x") * cells("y") <= CELLS))
        df = df.withColumns(box).withColumn("_short", F.coalesce(small, F.lit(False)))
        return df.where("_short").drop("_short"), df.where("NOT _short").select(id_, c)

    (a, long_a), (b, long_b) = sorted_out(left, ids[0], line, margin, "a"), sorted_out(right, ids[1], other, 0.0, "b")

    def placed(df: DataFrame, m: float, name: str) -> DataFrame:
        cells = lambda f: F.explode(F.sequence(geo.cell(F.col(f"_{name}{f}0") - m, size), geo.cell(F.col(f"_{name}{f}1") + m, size)))
        df = df.withColumnsRenamed({f"_{f}": f"_{name}{f}" for f in "xy"})
        # The work lies in the pairs, not in these few bytes, so adaptive execution may not merge the partitions.
        return df.withColumn("_cx", cells("x")).withColumn("_cy", cells("y")).repartition(parts, "_cx", "_cy")

    met = placed(a.withColumn("_length", geo.line_length(F.col(line))).drop(line), margin, "a").join(placed(b.drop(other), 0.0, "b"), ["_cx", "_cy"])
    gaps = []
    for f in "xy":
        a0, a1, b0, b1 = (F.col(f"_{n}{f}{e}") for n in "ab" for e in (0, 1))
        met = met.where((F.greatest(a0 - margin, b0) <= F.least(a1 + margin, b1)) & (geo.cell(F.greatest(a0 - margin, b0), size) == F.col(f"_c{f}")))
        gaps.append(F.greatest(F.lit(0.0), b0 - a1, a0 - b1))
    # Boxes are no farther apart than their lines, but for rounding.
    met = met.where(gaps[0] * gaps[0] + gaps[1] * gaps[1] <= margin * margin * (1 + 1e-9) + 1e-18)
    kinds = [f"`{i}` {df.schema[i].dataType.simpleString()}" for df, i in zip((left, right), ids, strict=True)]
    measured = met.select(*ids, "_length", "_ax", "_ay", "_bx", "_by").mapInArrow(partial(_overlaps, within=within, near=near, ids=ids, at_once=AT_ONCE), ", ".join([*kinds, "_length double, distance double, covered double"]))
    out = measured.select(*ids, "distance", "covered", (F.col("covered") / F.greatest("_length", F.lit(0.1))).alias("share"))
    if not long_a.isEmpty():
        out = out.unionByName(_overlaps_by_segments(long_a, right, within, near, ids, line, other, size))
    if not long_b.isEmpty():
        out = out.unionByName(_overlaps_by_segments(a.select(ids[0], line), long_b, within, near, ids, line, other, size))
    return out


def _overlaps_by_segments(left: DataFrame, right: DataFrame, within: float, near: float, ids: tuple[str, str], line: str, other: str, size: float) -> DataFrame:
    """line_overlaps of lines of any length.

    Segments meet by cells, so long lines cost what lies around them; the covered intervals of a segment are merged.
    Two segments whose boxes meet are paired in one cell only, the one that holds the lower left corner of what the boxes share.
    """
    margin, parts = max(within, near), int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    low, high = (lambda c, f, m: F.least(F.col(f"{c}.a.{f}"), F.col(f"{c}.b.{f}")) - m), (lambda c, f, m: F.greatest(F.col(f"{c}.a.{f}"), F.col(f"{c}.b.{f}")) + m)

    def boxed(df: DataFrame, c: str, m: float, name: str) -> DataFrame:
        df = df.withColumns({f"_{name}{f}{e}": v for f in "xy" for e, v in ((0, low(c, f, m)), (1, high(c, f, m)))})
        cells = lambda f: F.explode(F.sequence(geo.cell(F.col(f"_{name}{f}0"), size), geo.cell(F.col(f"_{name}{f}1"), size)))
        # The work lies in the pairs, not in these few bytes, so adaptive execution may not merge the partitions.
        return df.withColumn("_cx", cells("x")).withColumn("_cy", cells("y")).repartition(parts, "_cx", "_cy")

    a = boxed(left.select(F.col(ids[0]), geo.line_length(F.col(line)).alias("_length"), F.posexplode(geo.segments(F.col(line))).alias("_k", "s")), "s", margin, "a")
    b = boxed(right.select(F.col(ids[1]), F.explode(geo.segments(F.col(other))).alias("t")), "t", 0.0, "b")
    pairs = a.join(b, ["_cx", "_cy"])
    for f in "xy":
        corner = F.greatest(f"_a{f}0", f"_b{f}0")
        pairs = pairs.where((corner <= F.least(f"_a{f}1", f"_b{f}1")) & (geo.cell(corner, size) == F.col(f"_c{f}")))
    pairs = pairs.select(*ids, "_k", "_length", segment_distance(F.col("s"), F.col("t")).alias("_d"), "s", "t").where(F.col("_d") <= margin)
    pairs = pairs.withColumn("_i", _near_interval(near))
    per = pairs.groupBy(*ids, "_k").agg(F.min("_d").alias("_d"), F.first("_length").alias("_length"), F.sort_array(F.collect_list(F.when(F.col("_i.lo").isNotNull(), F.col("_i")))).alias("_parts"))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("to"))
    merged = F.aggregate("_parts", start, lambda acc, i: F.struct((acc["sum"] + F.greatest(F.lit(0.0), i["hi"] - F.greatest(i["lo"], acc["to"]))).alias("sum"), F.greatest(acc["to"], i["hi"]).alias("to")), lambda acc: acc["sum"])
    out = per.groupBy(*ids).agg(F.min("_d").alias("distance"), F.sum(merged).alias("covered"), F.first("_length").alias("_length"))
    return out.where(F.col("distance") <= within).select(*ids, "distance", "covered", (F.col("covered") / F.greatest("_length", F.lit(0.1))).alias("share"))
