"""Canonical JSON of nested columns, keys and seeds from its digest.

Keys are sorted at every depth and texts are escaped to ASCII; numbers are written as the shortest text that
reads back as the same number.  Neither order nor numbers can be had from to_json, so the text is written in
Arrow batches, a value at a time; a text alone needs no Python.
"""

from __future__ import annotations

import datetime
import json
import math
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def plain(value: object, kind: pa.DataType) -> object:
    """A value of an Arrow array as JSON knows it: maps and structs as objects, times in ISO form, decimals as numbers."""
    if value is None:
        return None
    if pa.types.is_map(kind):
        return {str(k): plain(v, kind.item_type) for k, v in value}
    if pa.types.is_struct(kind):
        return {f.name: plain(value[f.name], f.type) for f in kind}
    if pa.types.is_list(kind) or pa.types.is_large_list(kind):
        return [plain(v, kind.value_type) for v in value]
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    if isinstance(value, Decimal):
        return int(value) if value == value.to_integral_value() and kind.scale == 0 else float(value)
    if isinstance(value, float) and not math.isfinite(value):
        raise ValueError("numbers of canonical JSON are finite")
    return value


def dumps(array: pa.Array, separators: tuple[str, str]) -> pa.Array:
    return pa.array([json.dumps(plain(v, array.type), sort_keys=True, separators=separators) for v in array.to_pylist()], pa.string())


def canonical_json(value: Column, compact: bool = True) -> Column:
    """The canonical text of a column of any type; null as null's text.  Not compact: a space behind commas and colons."""
    separators = (",", ":") if compact else (", ", ": ")

    def write(array: pa.Array) -> pa.Array:
        return dumps(array, separators)

    write.__annotations__ = {"array": pa.Array, "return": pa.Array}
    return F.arrow_udf(write, "string")(value)


def _escaped(text: Column) -> Column:
    """Text as JSON writes it between quotes, in ASCII."""
    def one(c: Column) -> Column:
        code = F.ascii(c)
        unit = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))
        high, low = F.lit(0xD800) + F.floor((code - 0x10000) / 0x400), F.lit(0xDC00) + (code - 0x10000) % 0x400
        out = F.when(code > 0xFFFF, F.concat(unit(high), unit(low))).when((code < 32) | (code > 126), unit(code)).otherwise(c)
        for raw, name in (('"', '\\"'), ("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\f", "\\f"), ("\b", "\\b")):
            out = F.when(c == raw, F.lit(name)).otherwise(out)
        return out

    every = F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), one), "")
    return F.when(text.rlike(r"^[ !#-\[\]-~]*\z"), text).otherwise(every)


def json_text(text: Column) -> Column:
    """canonical_json of a text, by built-in functions: no row goes to Python."""
    return F.coalesce(F.concat(F.lit('"'), _escaped(text), F.lit('"')), F.lit("null"))


def cache_key(value: Column) -> Column:
    """SHA-256 of the compact text."""
    return F.sha2(canonical_json(value).cast("binary"), 256)


def stable_seed(value: Column) -> Column:
    """The first eight bytes, as an unsigned number, of the SHA-256 of the text with spaces."""
    digest = F.sha2(canonical_json(value, compact=False).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")
