"""Timestamps from text and numbers of unknown unit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom.functions.base import let
from logloom.functions.json_text import as_number, as_text, number_or_numeric_text, parse_float

# --- fixed value: shape of an RFC 3339 timestamp --------------------------------------------------
RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}([.,]\d+)?(Z|[+-]\d{2}:\d{2})$"
# ------------------------------------------------------------------------------------------------


def rfc3339(text: Column) -> Column:
    """Strict RFC 3339, NULL otherwise."""
    return F.when(text.rlike(RFC3339), F.try_to_timestamp(F.replace(text, F.lit(","), F.lit("."))))


def _micros(x: Column) -> Column:
    return F.timestamp_micros(x.try_cast("bigint"))


def unix_seconds(x: Column) -> Column:
    """Seconds with an optional fraction."""
    return _micros(F.floor(x) * F.lit(1e6) + F.floor((x - F.floor(x)) * F.lit(1e6)))


def unix_nanos(x: Column) -> Column:
    return _micros(F.floor(x / 1000))


def by_magnitude(x: Column) -> Column:
    """Nanoseconds, microseconds, milliseconds or seconds, told apart by size."""
    size = F.abs(x)
    return (F.when(size > 1e18, unix_nanos(x))
            .when(size > 1e15, _micros(F.floor(x)))
            .when(size > 1e12, _micros(F.floor(x) * 1000))
            .otherwise(unix_seconds(x)))


def detect(value: Column) -> Column:
    """RFC 3339 text, or a number (also as text) of any usual unit; NULL otherwise."""
    return let(value, lambda v: F.coalesce(
        rfc3339(as_text(v)), let(F.coalesce(as_number(v), parse_float(as_text(v))), by_magnitude)))


def from_variant(value: Column, style: str) -> Column:
    if style == "rfc3339":
        return rfc3339(as_text(value))
    if style == "unix":
        return let(number_or_numeric_text(value), unix_seconds)
    if style == "unixnano":
        return let(number_or_numeric_text(value), unix_nanos)
    return detect(value)


def nanos_text(text: Column) -> Column:
    """64-bit nanoseconds held as text; NULL for missing or non-positive values."""
    n = text.try_cast("bigint")
    return F.when(n > 0, F.timestamp_micros(F.call_function("div", n, F.lit(1000))))
