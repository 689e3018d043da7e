"""Plane and sphere geometry as column expressions over points and arrays of points (structs x, y)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH = 6371009.0
MERCATOR = 6378137.0
# UTM zone 10 north on WGS 84: fixed values.
_A, _F, _K0, _LON0, _E0 = 6378137.0, 1 / 298.257223563, 0.9996, -123.0, 500000.0
_E2 = _F * (2 - _F)
_EP2 = _E2 / (1 - _E2)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres on the sphere."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def bearing(dx: Column, dy: Column) -> Column:
    """Degrees clockwise from north."""
    return F.pmod(F.degrees(F.atan2(dx, dy)) + 360, F.lit(360.0))


def line_bearing(line: Column) -> Column:
    """From the first to the last point; 0 for fewer than two."""
    a, b = F.get(line, F.lit(0)), F.get(line, F.size(line) - 1)
    return F.when(F.size(line) >= 2, bearing(b["x"] - a["x"], b["y"] - a["y"])).otherwise(F.lit(0.0))


def bearing_difference(a: Column, b: Column) -> Column:
    return F.abs(F.pmod(a - b + 180, F.lit(360.0)) - 180)


def undirected_difference(a: Column, b: Column) -> Column:
    d = F.pmod(F.abs(a - b), F.lit(180.0))
    return F.least(d, 180 - d)


def segments(line: Column) -> Column:
    """Array of the line's consecutive pairs of points."""
    n = F.size(line)
    return F.when(n >= 2, F.zip_with(F.slice(line, 1, F.greatest(n - 1, F.lit(1))), F.slice(line, 2, F.greatest(n - 1, F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).otherwise(F.array())


def point_segment(x: Column, y: Column, s: Column) -> Column:
    """Distance of a point to a segment."""
    dx, dy = s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]
    t = F.coalesce(F.try_divide((x - s["a"]["x"]) * dx + (y - s["a"]["y"]) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))
    return F.hypot(x - s["a"]["x"] - t * dx, y - s["a"]["y"] - t * dy)


def point_line(x: Column, y: Column, line: Column) -> Column:
    """Distance of a point to a line; of a line of one point, to that."""
    one = F.get(line, F.lit(0))
    return F.when(F.size(line) == 1, F.hypot(x - one["x"], y - one["y"])).otherwise(F.array_min(F.transform(segments(line), lambda s: point_segment(x, y, s))))


def line_length(line: Column) -> Column:
    return F.aggregate(segments(line), F.lit(0.0), lambda t, s: t + F.hypot(s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]))


def densified(line: Column, step: float) -> Column:
    """Points along the line, at most step apart."""
    def along(s: Column) -> Column:
        n = F.greatest(F.lit(1), F.ceil(F.hypot(s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]) / step)).cast("int")
        return F.transform(F.sequence(F.lit(0), n), lambda i: F.struct((s["a"]["x"] + (s["b"]["x"] - s["a"]["x"]) * i / n).alias("x"), (s["a"]["y"] + (s["b"]["y"] - s["a"]["y"]) * i / n).alias("y")))

    return F.flatten(F.transform(segments(line), along))


def overlap_fraction(line: Column, other: Column, within: float, step: float = 5.0) -> Column:
    """Share of the line's points, step apart, that lie within the distance of the other line."""
    near = F.transform(densified(line, step), lambda p: (point_line(p["x"], p["y"], other) <= within).cast("double"))
    return F.coalesce(F.try_divide(F.aggregate(near, F.lit(0.0), lambda a, b: a + b), F.size(near)), F.lit(0.0))


def line_line(line: Column, other: Column) -> Column:
    """Distance of two lines from their vertices to the other's segments (crossings not looked for)."""
    one = lambda a, b: F.array_min(F.transform(a, lambda p: point_line(p["x"], p["y"], b)))
    return F.least(one(line, other), one(other, line))


def oriented(line: Column, x: Column, y: Column) -> Column:
    """The line, turned round if its end is nearer to the point than its start."""
    a, b = F.get(line, F.lit(0)), F.get(line, F.size(line) - 1)
    return F.when(F.hypot(b["x"] - x, b["y"] - y) < F.hypot(a["x"] - x, a["y"] - y), F.reverse(line)).otherwise(line)


def fingerprint(line: Column) -> Column:
    """Digest that is the same for a line and its reverse."""
    text = lambda c: F.array_join(F.transform(c, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ",")
    return F.sha2(F.least(text(line), text(F.reverse(line))), 256)


def cell(x: Column, size: float) -> Column:
    return F.floor(x / size).cast("long")


def web_mercator_to_lonlat(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / MERCATOR), F.degrees(2 * F.atan(F.exp(y / MERCATOR)) - F.lit(1.5707963267948966))


def lonlat_to_utm10(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Easting and northing by the usual series; under a millimetre off within the zone."""
    p, d = F.radians(lat), F.radians(lon - _LON0)
    s, c, t = F.sin(p), F.cos(p), F.tan(p)
    n = _A / F.sqrt(1 - _E2 * s * s)
    t2, c2, a = t * t, _EP2 * c * c, c * d
    e4, e6 = _E2**2, _E2**3
    m = _A * ((1 - _E2 / 4 - 3 * e4 / 64 - 5 * e6 / 256) * p - (3 * _E2 / 8 + 3 * e4 / 32 + 45 * e6 / 1024) * F.sin(2 * p) + (15 * e4 / 256 + 45 * e6 / 1024) * F.sin(4 * p) - (35 * e6 / 3072) * F.sin(6 * p))
    east = _K0 * n * (a + (1 - t2 + c2) * F.pow(a, 3) / 6 + (5 - 18 * t2 + t2 * t2 + 72 * c2 - 58 * _EP2) * F.pow(a, 5) / 120) + _E0
    north = _K0 * (m + n * t * (a * a / 2 + (5 - t2 + 9 * c2 + 4 * c2 * c2) * F.pow(a, 4) / 24 + (61 - 58 * t2 + t2 * t2 + 600 * c2 - 330 * _EP2) * F.pow(a, 6) / 720))
    return east, north


def along_line(line: Column, distance: Column) -> Column:
    """Point at a distance along a line, its ends beyond them; null for a line without points."""
    start = F.struct(F.greatest(distance.cast("double"), F.lit(0.0)).alias("left"), F.get(line, F.lit(0))["x"].cast("double").alias("x"), F.get(line, F.lit(0))["y"].cast("double").alias("y"))

    def walk(acc: Column, s: Column) -> Column:
        dx, dy = s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]
        share = F.coalesce(F.try_divide(F.least(acc["left"], F.hypot(dx, dy)), F.hypot(dx, dy)), F.lit(0.0))
        moved = F.struct((acc["left"] - F.least(acc["left"], F.hypot(dx, dy))).alias("left"), (s["a"]["x"] + share * dx).alias("x"), (s["a"]["y"] + share * dy).alias("y"))
        return F.when(acc["left"] > 0, moved).otherwise(acc)

    return F.when(F.size(line) >= 1, F.aggregate(segments(line), start, walk, lambda acc: F.struct(acc["x"].alias("x"), acc["y"].alias("y"))))


def place_on_line(x: Column, y: Column, line: Column) -> Column:
    """Distance along a line of its point next to (x, y), the first such point; null without points."""
    start = F.struct(F.lit(0.0).alias("walked"), F.lit(float("inf")).alias("best"), F.lit(0.0).alias("at"))

    def walk(acc: Column, s: Column) -> Column:
        dx, dy = s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]
        t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.try_divide((x - s["a"]["x"]) * dx + (y - s["a"]["y"]) * dy, dx * dx + dy * dy), F.lit(0.0))))
        far = F.hypot(x - s["a"]["x"] - t * dx, y - s["a"]["y"] - t * dy)
        near = far < acc["best"]
        return F.struct((acc["walked"] + F.hypot(dx, dy)).alias("walked"), F.when(near, far).otherwise(acc["best"]).alias("best"), F.when(near, acc["walked"] + t * F.hypot(dx, dy)).otherwise(acc["at"]).alias("at"))

    return F.when(F.size(line) >= 1, F.aggregate(segments(line), start, walk, lambda acc: acc["at"]))


def within_extent(x: Column, y: Column, west: float, south: float, east: float, north: float) -> Column:
    """Whether a point lies in the box, its sides included; false for null."""
    return F.coalesce(x.between(west, east) & y.between(south, north), F.lit(False))
