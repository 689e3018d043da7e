"""Text of roads: route tokens, names, references, directions, speeds and lanes in tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings, suffixes and bearings that data use.
ROUTE_PREFIXES = {"I": "I", "US": "US", "OR": "(?:OR|OREGON)", "WA": "(?:WA|SR)"}
SUFFIXES = {"AVENUE": "AVE", "STREET": "ST", "ROAD": "RD", "BOULEVARD": "BLVD", "HIGHWAY": "HWY", "DRIVE": "DR", "LANE": "LN", "PARKWAY": "PKWY"}
COMPASS = {"N": 0.0, "NE": 45.0, "E": 90.0, "SE": 135.0, "S": 180.0, "SW": 225.0, "W": 270.0, "NW": 315.0}
LONG_COMPASS = {"N": "NORTH", "NE": "NORTHEAST", "E": "EAST", "SE": "SOUTHEAST", "S": "SOUTH", "SW": "SOUTHWEST", "W": "WEST", "NW": "NORTHWEST"}
MPH = 1.609344


def route_tokens(x: Column) -> Column:
    """Sorted distinct tokens like I5 or US26 of upper-cased text with dashes made plain."""
    t = F.replace(F.upper(x), F.lit("–"), F.lit("-"))
    one = lambda k, p: F.transform(F.regexp_extract_all(t, F.lit(rf"\b{p}\s*[- ]?\s*(\d{{1,3}})\b"), F.lit(1)), lambda n: F.concat(F.lit(k), n))
    found = [one(k, p) for k, p in ROUTE_PREFIXES.items()]
    return F.array_sort(F.array_distinct(F.concat(*found)))


def road_form(x: Column) -> Column:
    """Whether a location text speaks of a link, the main line, or neither."""
    t = F.lower(x)
    return F.when(t.rlike(r"ramp|frontage| hov|\bto\s+(?:nb|sb|eb|wb)\b"), "link").when(t.contains(" @ "), "mainline").otherwise("unknown")


def road_name(x: Column) -> Column:
    """Upper case, without compass words, with short suffixes, letters and digits only."""
    compass = "|".join([*LONG_COMPASS.values(), *COMPASS])
    t = F.regexp_replace(F.upper(F.coalesce(x, F.lit(""))), rf"\b(?:{compass})\b", " ")
    for long, short in SUFFIXES.items():
        t = F.regexp_replace(t, rf"\b{long}\b", short)
    return F.array_join(F.regexp_extract_all(t, F.lit(r"[A-Z0-9]+"), F.lit(0)), " ")


def road_ref(x: Column) -> Column:
    """The first route reference, its space made a dash; empty without one."""
    return F.replace(F.regexp_extract(F.upper(F.coalesce(x, F.lit(""))), r"\b(?:I|US|OR|SR|WA)[ -]?\d+\b", 0), F.lit(" "), F.lit("-"))


def names_agree(name: Column, ref: Column, other_name: Column, other_ref: Column) -> Column:
    """Equal references or names, or enough shared words besides suffixes."""
    telling = lambda c: F.array_except(F.array_distinct(F.split(c, " ")), F.array(*map(F.lit, SUFFIXES.values())))
    shared = F.size(F.array_intersect(telling(name), telling(other_name)))
    enough = (shared > 0) & (shared >= F.least(F.lit(2), F.size(telling(name))))
    return ((ref != "") & (ref == other_ref)) | ((name != "") & (other_name != "") & ((name == other_name) | enough))


def direction_bearing(x: Column) -> Column:
    """Degrees of a direction's text: N, NB, NORTH, NORTHBOUND and so on; null for others."""
    t = F.regexp_replace(F.upper(x), r"[^A-Z]", "")
    out = F.lit(None).cast("double")
    for short, degrees in COMPASS.items():
        names = [short, LONG_COMPASS[short], LONG_COMPASS[short] + "BOUND"] + ([short + "B"] if len(short) == 1 else [])
        out = F.when(t.isin(*names), F.lit(degrees)).otherwise(out)
    return out


def _entries(x: Column) -> Column:
    """The entries of a JSON list, or the text as the only one."""
    parsed = F.from_json(x, "array<string>", {"mode": "PERMISSIVE"})
    return F.when(F.ltrim(x).startswith("["), F.coalesce(parsed, F.array())).otherwise(F.array(x))


def tagged_speed(x: Column, low: float = 5.0, high: float = 160.0) -> Column:
    """km/h of a speed tag (mph where it says so), the least of a list, null out of bounds."""
    def one(t: Column) -> Column:
        n = F.regexp_extract(t, r"(\d+(?:\.\d+)?)", 1).try_cast("double")
        return n * F.when(F.lower(t).contains("mph"), MPH).otherwise(1.0)

    speeds = F.filter(F.transform(_entries(x), one), lambda v: v.isNotNull() & v.between(low, high))
    return F.array_min(speeds)


def tagged_number(x: Column) -> Column:
    """The largest positive number of a lanes tag, entries separated by semicolons or in a list."""
    parts = F.flatten(F.transform(_entries(x), lambda t: F.split(t, ";")))
    return F.array_max(F.filter(F.transform(parts, lambda t: F.trim(t).try_cast("double")), lambda v: v > 0))


def json_list(x: Column) -> Column:
    """A list from JSON text; text that is not JSON is its own only entry, null gives none."""
    parsed = F.from_json(x, "array<string>")
    return F.when(x.isNull(), F.array().cast("array<string>")).when(F.ltrim(x).startswith("["), F.coalesce(parsed, F.array(x))).otherwise(F.array(x))


def first_entry(x: Column) -> Column:
    return F.coalesce(F.get(json_list(x), F.lit(0)), F.lit(""))


def joined_entries(x: Column, by: str = " / ") -> Column:
    return F.array_join(json_list(x), by)


def safe_name(x: Column) -> Column:
    return F.regexp_replace(x, r"[^A-Za-z0-9._-]+", "_")


def truthy(x: Column) -> Column:
    return F.coalesce(F.lower(F.trim(x.cast("string"))).isin("1", "true", "yes", "y"), F.lit(False))


def human_bytes(n: Column) -> Column:
    out = F.format_string("%.1f TB", n / 1024.0**4)
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB")):
        out = F.when(n < 1024 ** (power + 1), F.format_string(f"%.1f {unit}", n / 1024.0**power)).otherwise(out)
    return F.when(n < 1024, F.format_string("%d B", n.cast("long"))).otherwise(out)
