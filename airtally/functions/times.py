"""Event time: seconds, UTC dates and hours, dayparts, ages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from airtally.functions.hashes import _c

DAYPARTS = ("morning", "afternoon", "primetime", "latenight")


def seconds_of(col: Column | str, unit: str = "s") -> Column:
    """Epoch seconds from a column in seconds or milliseconds."""
    if unit == "s":
        return _c(col).cast("bigint")
    if unit == "ms":
        return F.floor(_c(col) / F.lit(1000)).cast("bigint")
    raise ValueError(f"unit must be 's' or 'ms', not {unit!r}")


def utc_date(seconds: Column | str) -> Column:
    return F.date_format(F.timestamp_seconds(_c(seconds)), "yyyy-MM-dd")


def utc_hour(seconds: Column | str) -> Column:
    return F.hour(F.timestamp_seconds(_c(seconds)))


def whole_minutes(seconds: Column | str) -> Column:
    s = _c(seconds)
    return ((s - s % 60) / 60).cast("int")


def daypart(hour: Column | str) -> Column:
    """Named part of the day; hour 23 is already late night."""
    h = _c(hour)
    return (
        F.when(h.between(6, 11), "morning")
        .when(h.between(12, 17), "afternoon")
        .when(h.between(18, 22), "primetime")
        .when(h.isNotNull(), "latenight")
    )


def nearest_minute(seconds: Column | str) -> Column:
    return (F.floor((_c(seconds) + 30) / F.lit(60)) * 60).cast("bigint")


def minute_floor(seconds: Column | str) -> Column:
    return (F.floor(_c(seconds) / F.lit(60)) * 60).cast("bigint")


def date_parts(ts: Column | str) -> list[Column]:
    return [
        F.date_format(_c(ts), "yyyy").alias("year"),
        F.date_format(_c(ts), "MM").alias("month"),
        F.date_format(_c(ts), "dd").alias("day"),
    ]


def older_than(now: Column, last: Column | str, ttl_seconds: int) -> Column:
    """True when more than `ttl_seconds` have passed since `last` (epoch seconds)."""
    return (now - _c(last)) > ttl_seconds
