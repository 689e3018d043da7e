"""Scalar rules that keep missing values missing: NaN to null, lenient casts, guarded arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def number(x: Column | str) -> Column:
    """Text or number as double; what doesn't parse, NaN and null become null."""
    c = F.col(x) if isinstance(x, str) else x
    d = c.cast("string").try_cast("double")
    return F.when(~F.isnan(d), d)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN to null in every floating column."""
    kinds = ("double", "float")
    return df.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n, t in df.dtypes if t in kinds})


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bounds that leave null alone (greatest and least would skip it)."""
    out = x
    if low is not None:
        out = F.greatest(F.lit(float(low)), out)
    if high is not None:
        out = F.least(F.lit(float(high)), out)
    return F.when(x.isNotNull(), out)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero or either is null."""
    return F.try_divide(a, b)


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """100 * part / max(whole, 1), rounded half to even."""
    return F.bround(100.0 * part / F.greatest(whole, F.lit(1)), digits)


def trimmed(x: Column | str) -> Column:
    return F.trim(F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit("")))


def blank_to_null(x: Column) -> Column:
    """Text that only says that nothing is there becomes null."""
    return F.when(~F.lower(F.trim(x)).isin("", "nan", "none", "null"), F.trim(x))


def canonical_id(x: Column) -> Column:
    """Ids that passed through floats: 123.0 becomes 123."""
    return F.regexp_replace(x.cast("string"), r"^(-?\d+)\.0+$", "$1")
