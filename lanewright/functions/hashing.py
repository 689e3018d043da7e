"""Stable ids, fractions and uniforms from SHA-256."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def joined(*parts: Column) -> Column:
    return F.concat_ws("|", *(p.cast("string") for p in parts))


def short_id(*parts: Column, digits: int = 24) -> Column:
    return F.substring(F.sha2(joined(*parts), 256), 1, digits)


def fraction(*parts: Column) -> Column:
    """Number in [0, 1) from the first 52 bits of the digest."""
    return F.conv(F.substring(F.sha2(joined(*parts), 256), 1, 13), 16, 10).cast("long").cast("double") / float(1 << 52)


def fraction64(*parts: Column) -> Column:
    """Number in [0, 1] from the first 64 bits."""
    return F.conv(F.substring(F.sha2(joined(*parts), 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / float(1 << 64)


def index(n: Column, *parts: Column) -> Column:
    """Number from 0 to n - 1."""
    return F.least(F.floor(fraction(*parts) * n), n - 1).cast("long")


def uuid5(namespace: str, name: Column) -> Column:
    """Version 5 UUID of a name: SHA-1 of the namespace's bytes and the name, with version and variant set."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name.cast("string"), "UTF-8")))
    part = lambda start, length: F.substring(digest, start, length)
    variant = F.translate(part(17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))
