"""Polygons, circles, overlaps of lines and GeoParquet against plain computations."""

from __future__ import annotations

import json
import math
import random
import struct
from fractions import Fraction

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lanewright.functions import times
from lanewright.operators import areas
from lanewright.sources import geoparquet


def ring(points):
    return [{"x": float(x), "y": float(y)} for x, y in [*points, points[0]]]


def star(rng, cx, cy, r):
    n = rng.randrange(3, 12)
    return [(cx + r * rng.uniform(0.4, 1) * math.cos(2 * math.pi * i / n), cy + r * rng.uniform(0.4, 1) * math.sin(2 * math.pi * i / n)) for i in range(n)]


def inside(x, y, rings):
    odd = False
    for r in rings:
        for a, b in zip(r, r[1:], strict=False):
            if (a["y"] > y) != (b["y"] > y) and a["x"] + (y - a["y"]) * (b["x"] - a["x"]) / (b["y"] - a["y"]) > x:
                odd = not odd
    return odd


@pytest.mark.parametrize("size", [0.7, 5.0, 400.0])
def test_points_in_zones(spark, size):
    rng = random.Random(2)
    zones = []
    for i in range(12):
        cx, cy, r = rng.uniform(-50, 50), rng.uniform(-50, 50), rng.uniform(3, 40)
        parts = [[ring(star(rng, cx, cy, r)), ring(star(rng, cx, cy, r * 0.3))]]
        if i % 3 == 0:
            parts.append([ring(star(rng, cx + 80, cy, r / 2))])
        zones.append((f"z{i}", parts))
    zones += [("empty", []), ("null", None)]
    points = [(i, rng.uniform(-100, 150), rng.uniform(-100, 100)) for i in range(1500)] + [(-1, None, 1.0)]
    z, p = spark.createDataFrame(zones, f"zone string, shape {areas.SHAPE}"), spark.createDataFrame(points, "id int, x double, y double")
    got = {(r.id, r.zone) for r in areas.points_in_zones(p, z, "zone", size).collect()}
    want = {(i, n) for i, x, y in points if x is not None for n, parts in zones for rings in parts or [] if inside(x, y, rings)}
    assert got == want


def test_borders_count_as_covered(spark):
    z = spark.createDataFrame([("sq", [[ring([(0, 0), (10, 0), (10, 10), (0, 10)]), ring([(4, 4), (6, 4), (6, 6), (4, 6)])]])], f"zone string, shape {areas.SHAPE}")
    cases = {(0.0, 0.0): 1, (10.0, 5.0): 1, (5.0, 10.0): 1, (4.0, 5.0): 1, (5.0, 5.0): 0, (10.1, 5.0): 0, (2.0, 2.0): 1, (-0.1, 0.0): 0}
    p = spark.createDataFrame(list(cases), "x double, y double")
    for size in (1.0, 2.5, 64.0):
        got = {(r.x, r.y) for r in areas.points_in_zones(p, z, "zone", size).collect()}
        assert got == {c for c, n in cases.items() if n}


def test_circles_and_validity(spark):
    c = spark.createDataFrame([("a", "internal", 0.0, 0.0), ("a", "internal", 10.0, 0.0)], "zone_id string, zone_type string, x double, y double")
    (zone,) = areas.zone_buffers(c).select("*", areas.ring_area(F.col("shape")[0][0]).alias("area"), areas.valid_shape(F.col("shape")).alias("ok")).collect()
    assert len(zone["shape"][0][0]) == 65 and zone.ok and zone.area == pytest.approx(32 * 750**2 * math.sin(math.pi / 32))
    assert max(abs(math.hypot(q.x - 5, q.y) - 750) for q in zone["shape"][0][0]) < 1e-6
    square = ring([(0, 0), (4, 0), (4, 4), (0, 4)])
    shapes = {"good": [[square]], "bow": [[ring([(0, 0), (4, 4), (4, 0), (0, 4)])]], "open": [[square[:-1]]], "flat": [[ring([(0, 0), (4, 0), (8, 0)])]], "none": [], "null": None, "touch": [[ring([(0, 0), (4, 0), (2, 0), (4, 4)])]], "nan": [[ring([(0, 0), (4, float("nan")), (4, 4)])]]}
    got = {r.k: r.ok for r in spark.createDataFrame(list(shapes.items()), f"k string, shape {areas.SHAPE}").select("k", areas.valid_shape(F.col("shape")).alias("ok")).collect()}
    assert got == {k: k == "good" for k in shapes}


def distance(p, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    t = 0 if dx == dy == 0 else min(1, max(0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / (dx * dx + dy * dy)))
    return math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)


def covered(line, other, within):
    """Length of the parts of a line that are near another one, their ends found by halving."""
    total = 0.0
    for a, b in zip(line, line[1:], strict=False):
        def off(t, a=a, b=b):
            p = (a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1]))
            return min(distance(p, c, d) for c, d in zip(other, other[1:], strict=False)) - within

        size, n = math.hypot(b[0] - a[0], b[1] - a[1]), 1500
        for i in range(n):
            lo, hi = i / n, (i + 1) / n
            f, g = off(lo) <= 0, off(hi) <= 0
            if f and g:
                total += size / n
            elif f != g:
                x, y = lo, hi
                for _ in range(45):
                    m = (x + y) / 2
                    x, y = (m, y) if (off(m) <= 0) == f else (x, m)
                total += size * ((x - lo) if f else (hi - x))
    return total


def test_line_overlaps(spark):
    rng = random.Random(8)
    walk = lambda: [(rng.uniform(0, 60), rng.uniform(0, 60)) for _ in range(rng.randrange(2, 5))]
    left, right = [walk() for _ in range(9)], [walk() for _ in range(9)]
    right[0] = left[0]
    right[1] = [(x + 3, y) for x, y in left[1]]
    left[2], right[2] = [(0, 0), (0, 0), (9, 0)], [(4, 1), (4, 1)]
    frame = lambda rows, i, c: spark.createDataFrame([(k, [{"x": float(x), "y": float(y)} for x, y in r]) for k, r in enumerate(rows)], f"{i} int, {c} array<struct<x:double,y:double>>")
    for size in (15.0, 300.0):
        got = {(r.l, r.r): r for r in areas.line_overlaps(frame(left, "l", "line"), frame(right, "r", "other"), 6.0, ("l", "r"), near=4.0, size=size).collect()}
        for i, a in enumerate(left):
            for j, b in enumerate(right):
                cross = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
                apart = min(0.0 if cross(*s, t[0]) * cross(*s, t[1]) < 0 and cross(*t, s[0]) * cross(*t, s[1]) < 0 else min(distance(s[0], *t), distance(s[1], *t), distance(t[0], *s), distance(t[1], *s)) for s in zip(a, a[1:], strict=False) for t in zip(b, b[1:], strict=False))
                assert ((i, j) in got) == (apart <= 6)
                if apart <= 6:
                    assert got[i, j].distance == pytest.approx(apart, abs=1e-9)
                    if size == 300.0:
                        assert got[i, j].covered == pytest.approx(covered(a, b, 4.0), abs=1e-6)


def wkb(kind, body, order="<", z=False):
    return (b"\x01" if order == "<" else b"\x00") + struct.pack(order + "I", kind + (1000 if z else 0)) + body


def test_wkb():
    pts = lambda p, o="<": b"".join(struct.pack(o + f"{len(q)}d", *q) for q in p)
    n = lambda k, o="<": struct.pack(o + "I", k)
    tri = [(0, 0), (1, 0), (1, 1), (0, 0)]
    xy = lambda p: [{"x": float(q[0]), "y": float(q[1])} for q in p]
    line = wkb(2, n(2, ">") + pts([(1, 2), (3, 4)], ">"), ">")
    polygon = wkb(3, n(2) + n(4) + pts(tri) + n(4) + pts(tri))
    assert geoparquet.parse_wkb(wkb(1, pts([(1, 2, 9)]), z=True)) == ("Point", [[xy([(1, 2)])]])
    assert geoparquet.parse_wkb(wkb(1, pts([(math.nan, math.nan)]))) == ("Point", [])
    assert geoparquet.parse_wkb(line) == ("LineString", [[xy([(1, 2), (3, 4)])]])
    assert geoparquet.parse_wkb(polygon) == ("Polygon", [[xy(tri), xy(tri)]])
    assert geoparquet.parse_wkb(wkb(6, n(2) + polygon + polygon)) == ("MultiPolygon", [[xy(tri), xy(tri)]] * 2)
    assert geoparquet.parse_wkb(wkb(5, n(1) + line)) == ("MultiLineString", [[xy([(1, 2), (3, 4)])]])
    srid = b"\x01" + struct.pack("<I", 1 | 0x20000000) + struct.pack("<I", 4326) + pts([(5, 6)])
    assert geoparquet.parse_wkb(srid) == ("Point", [[xy([(5, 6)])]])
    with pytest.raises(ValueError, match="not read"):
        geoparquet.parse_wkb(wkb(7, n(0)))


def test_geoparquet(spark, tmp_path):
    body = b"".join(struct.pack("<2d", *p) for p in [(0, 0), (3, 4)])
    table = pa.table({"edge_id": ["a", "b"], "geometry": pa.array([wkb(2, struct.pack("<I", 2) + body), None], pa.binary()), "n": [1, 2]})

    def write(name, crs, encoding="WKB", geo=True):
        column = {"encoding": encoding, "geometry_types": []} | ({} if crs == "default" else {"crs": crs})
        meta = {"version": "1.1.0", "primary_column": "geometry", "columns": {"geometry": column}}
        at = str(tmp_path / name)
        pq.write_table(table.replace_schema_metadata({"geo": json.dumps(meta)} if geo else {}), at)
        return at

    utm = {"id": {"authority": "EPSG", "code": 32610}}
    one, two, other, none = write("1.parquet", utm), write("2.parquet", utm), write("3.parquet", "default"), write("4.parquet", None)
    df, crs = geoparquet.read_geoparquet(spark, [one, two], "EPSG:32610")
    assert crs == "EPSG:32610" and df.columns == ["edge_id", "n", "kind", "shape"]
    assert sorted((r.edge_id, r.kind, r["shape"] and [(p.x, p.y) for p in r["shape"][0][0]]) for r in df.collect()) == [("a", "LineString", [(0, 0), (3, 4)])] * 2 + [("b", None, None)] * 2
    assert [[(p.x, p.y) for p in r.line] for r in geoparquet.lines(df).collect()] == [[(0, 0), (3, 4)]] * 2
    assert geoparquet.read_geoparquet(spark, other)[1] == "OGC:CRS84"
    for paths, crs, what in (([one, other], None, "differ"), ([none], None, "no CRS"), ([one], "EPSG:4326", "not EPSG:4326"), ([write("5.parquet", utm, geo=False)], None, "no geometry"), ([write("6.parquet", utm, "point")], None, "WKB")):
        with pytest.raises(ValueError, match=what):
            geoparquet.read_geoparquet(spark, paths, crs)


def test_zone_features(spark):
    square = [[[0, 0], [4, 0], [4, 4], [0, 0]]]
    rows = [({"id": "p"}, "Polygon", json.dumps(square)), ({"id": "m"}, "MultiPolygon", json.dumps([square, square])), ({"id": "x"}, "Point", "[1, 2]")]
    got = {r.properties["id"]: r["shape"] for r in geoparquet.zone_features(spark.createDataFrame(rows, "properties map<string,string>, kind string, coordinates string")).collect()}
    assert [len(got[k]) for k in "pmx"] == [1, 2, 0] and (got["p"][0][0][1].x, got["p"][0][0][1].y) == (4.0, 0.0)


def test_planning(spark):
    df = spark.createDataFrame([(10_000.0,), (50_000.0,)], "due double")
    plan = lambda travel, **o: [r.p for r in df.select(times.arrive_by(F.col("due"), travel, **o).alias("p")).collect()]
    for row, due in zip(plan(lambda t: F.lit(900.0) + t / 100), (10_000, 50_000), strict=True):
        assert row.arrival <= due and due - row.arrival <= 1.01 and row.travel == pytest.approx(900 + row.departure / 100)
    assert plan(lambda t: F.lit(40_000.0), strict=False) == [None, None]
    with pytest.raises(Exception, match="no feasible departure"):
        plan(lambda t: F.lit(40_000.0))
    with pytest.raises(Exception, match="must be positive"):
        plan(lambda t: F.lit(-1.0))
    assert df.select(times.depart_at(F.col("due"), lambda t: t * 0 + 5).alias("p")).first().p.arrival == 10_005.0


def test_points_a_rounding_beside_a_ring(spark):
    """Points whose stored values lie just inside or outside a slanted side: what is stored counts, not what rounding makes of it."""
    def ring(cx, cy, a, b):
        return [(cx - a, cy), (cx, cy - b), (cx + a, cy), (cx, cy + b), (cx - a, cy)]

    cases = [(1, 5179.4, 3441.0, 11), (2, 1393.6, 3232.0, 2), (3, 3491.2, 3182.0, 8)]
    rows = []
    for i, x, y, k in cases:
        cx, cy, a, b = 400.0 * k, 3000 + 37.0 * k, 700 + 10.0 * k, 900.0
        rows.append((i, x, y, [ring(cx, cy, a, b), ring(cx, cy, a / 2, b / 2)]))
        far = abs(Fraction(x) - Fraction(cx)) / Fraction(a) + abs(Fraction(y) - Fraction(cy)) / Fraction(b)
        assert (Fraction(1, 2) <= far <= 1) == (i < 3)
    df = spark.createDataFrame(rows, "i int, x double, y double, rings array<array<struct<x:double,y:double>>>")
    assert {r["i"] for r in df.where(areas.in_rings(F.col("x"), F.col("y"), F.col("rings"))).collect()} == {1, 2}


def test_line_overlaps_pairs_segments_once(spark):
    """Segments that share many cells are one pair, made without a shuffle of all that share a cell."""
    a = spark.createDataFrame([(1, [(0.0, 0.0), (500.0, 300.0)])], "a int, line array<struct<x:double,y:double>>")
    b = spark.createDataFrame([(2, [(0.0, 5.0), (500.0, 305.0)]), (3, [(0.0, 900.0), (500.0, 900.0)])], "b int, other array<struct<x:double,y:double>>")
    out = areas.line_overlaps(a, b, 10.0, ("a", "b"), size=20.0)
    assert [(r["a"], r["b"]) for r in out.collect()] == [(1, 2)]
    assert "Deduplicate" not in out._jdf.queryExecution().analyzed().toString()


def test_short_lines_are_paired_where_they_meet(spark):
    """20 lines and 20 others make 400 pairs, which are measured in their cell: only lines are dealt out, and no pair is put together again."""
    a = spark.createDataFrame([(i, [(0.0, i / 10), (5.0, i / 10), (9.0, i / 10)]) for i in range(20)], "a int, line array<struct<x:double,y:double>>")
    b = spark.createDataFrame([(i, [(1.0, i / 10), (8.0, 3 + i / 10)]) for i in range(20)], "b int, other array<struct<x:double,y:double>>")
    out = areas.line_overlaps(a, b, 10.0, ("a", "b"))
    assert out.count() == 400
    assert "Aggregate" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_short_and_long_lines_give_the_same(spark, monkeypatch):
    rng = random.Random(5)
    walk = lambda: [(rng.randrange(0, 90) / rng.choice((1, 7)), rng.randrange(0, 90) / rng.choice((1, 7))) for _ in range(rng.randrange(2, 7))]
    left, right = [walk() for _ in range(30)] + [[(3, 3), (3, 3)], [(1, 1)], [], None], [walk() for _ in range(30)] + [[(4, 4), (4, 4), (4, 4)], [(2, 2)], [], None, [(2, 2), (None, 5), (4, 4)], [(2, 2), (float("nan"), 5)]]
    frame = lambda rows, i, c: spark.createDataFrame([(f"{k}", r and [(x if x is None else float(x), float(y)) for x, y in r]) for k, r in enumerate(rows)], f"{i} string, {c} array<struct<x:double,y:double>>")
    a, b = frame(left, "l", "line"), frame(right, "r", "other")

    def rows():
        return {(r.l, r.r): (r.distance, r.covered, r.share) for r in areas.line_overlaps(a, b, 6.0, ("l", "r"), near=4.0, size=15.0).collect()}

    monkeypatch.setattr(areas, "POINTS", 0)
    want = rows()
    assert len(want) > 100
    for points, at_once in ((64, 100_000), (64, 7), (4, 100_000)):
        monkeypatch.setattr(areas, "POINTS", points)
        monkeypatch.setattr(areas, "AT_ONCE", at_once)
        got = rows()
        assert set(got) == set(want)
        assert all(g == pytest.approx(w, abs=1e-9) for k, w in want.items() for g in [got[k]])
