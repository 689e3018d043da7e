"""Calendar and clock: quarter-hour buckets, day types, periods, local wall time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BUCKET = 15
#: Minute ranges of the weekday periods and the dates of day types: fixed values.
PERIODS = {"morning": (300, 600), "afternoon": (840, 1140)}
DAY_TYPES = ("mon_thu", "friday", "saturday", "sunday")


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def bucket_of(minute: Column, width: int = BUCKET) -> Column:
    return (F.floor(minute / width) * width).cast("int")


def bucket_at(ts: Column, width: int = BUCKET) -> Column:
    return bucket_of(minute_of_day(ts), width)


def day_type(ts: Column) -> Column:
    d = F.weekday(ts)
    return F.when(d < 4, "mon_thu").when(d == 4, "friday").when(d == 5, "saturday").when(d == 6, "sunday")


def period_of(minute: Column) -> Column:
    """Period of a minute of the day; null between them. Ranges hold their start, not their end."""
    out = F.lit(None).cast("string")
    for name, (low, high) in PERIODS.items():
        out = F.when((minute >= low) & (minute < high), name).otherwise(out)
    return out


def is_weekday(ts: Column) -> Column:
    return F.weekday(ts) < 5


def minute_of_text(text: Column) -> Column:
    """Minute of the day in ISO text as written there, its offset not applied; null if malformed."""
    hour, minute = (F.regexp_extract(text, r"^\d{4}-\d{2}-\d{2}[T ](\d{2}):(\d{2})", i).try_cast("int") for i in (1, 2))
    return F.when((hour < 24) & (minute < 60), hour * 60 + minute)


def date_of_text(text: Column) -> Column:
    return F.substring(text, 1, 10).try_cast("date")


def instant(text: Column) -> Column:
    """Timestamp of text; null if it doesn't parse."""
    return F.try_to_timestamp(text)


def local_instant(text: Column, zone: Column, default: str = "America/Los_Angeles") -> Column:
    """Instant of text with an offset, or of wall time in its zone (a default where it has none)."""
    has_offset = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    wall = F.try_to_timestamp(F.regexp_replace(text, r"(Z|[+-]\d{2}:?\d{2})$", ""))
    return F.when(has_offset, F.try_to_timestamp(text)).otherwise(F.to_utc_timestamp(wall, F.coalesce(zone, F.lit(default))))


def active(at: Column, start: Column, end: Column) -> Column:
    """start <= at < end, where a missing bound is no bound."""
    return F.coalesce(at >= start, F.lit(True)) & F.coalesce(at < end, F.lit(True))


def depart_at(departure: Column, travel: Callable[[Column], Column]) -> Column:
    """departure, arrival and travel in seconds; an error where the travel time is not above zero."""
    seconds = _above_zero(travel(departure))
    return F.struct(departure.alias("departure"), (departure + seconds).alias("arrival"), seconds.alias("travel"))


def _above_zero(seconds: Column) -> Column:
    return F.when(seconds > 0, seconds).otherwise(F.raise_error(F.lit("travel time must be positive")).cast("double"))


def arrive_by(deadline: Column, travel: Callable[[Column], Column], window: float = 8 * 3600.0, precision: float = 1.0, strict: bool = True) -> Column:
    """The latest departure that arrives by the deadline: departure, arrival, travel in seconds.

    travel gives seconds of travel from a column of departures, and later departures never arrive earlier.  The
    window before the deadline is halved within the expression, as often as the precision asks for.  Where even
    its start arrives late: an error, or null if not strict.
    """
    steps, width = 0, window
    while width > precision:
        steps, width = steps + 1, width / 2
    first = deadline - window

    def halve(span: Column, _: Column) -> Column:
        middle = span["lo"] + (span["hi"] - span["lo"]) / 2
        good = middle + _above_zero(travel(middle)) <= deadline
        return F.struct(F.when(good, middle).otherwise(span["lo"]).alias("lo"), F.when(good, span["hi"]).otherwise(middle).alias("hi"))

    last = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(first.alias("lo"), deadline.alias("hi")), halve, lambda span: depart_at(span["lo"], travel))
    late = F.raise_error(F.lit("no feasible departure inside the search window")).cast("struct<departure:double,arrival:double,travel:double>") if strict else F.lit(None)
    return F.when(first + travel(first) <= deadline, last).otherwise(late)
