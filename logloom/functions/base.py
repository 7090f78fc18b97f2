"""Small expression helpers shared by the other modules."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.schema import TIMESTAMP_PATTERN


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body refers to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def let_sql(value: str, name: str, body: str) -> str:
    """SQL text of ``let``: ``body`` refers to the value as ``name``."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def apply_sql(value: Column, name: str, body: str) -> Column:
    """``let`` with a body in SQL text: a large expression reaches the JVM in one call."""
    return F.get(F.call_function("transform", F.array(value), F.expr(f"{name} -> {body}")), F.lit(0))


def lower_hex_sql(value: str) -> str:
    """``hex`` with small letters; ``lower`` would look up every text's locale, which costs more than parsing a short message."""
    return f"translate(hex({value}), 'ABCDEF', 'abcdef')"


def ts_lit(moment: datetime | str | Column, like: T.DataType | None = None) -> Column:
    """A timestamp literal of type ``like``, so that comparisons need no cast on the column side.

    The text form is read in the session time zone (UTC), never in the zone of the driver's machine.
    """
    if isinstance(moment, Column):
        return moment.cast(like) if like is not None else moment
    text = moment if isinstance(moment, str) else moment.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(text).cast(like or T.TimestampType())


def type_of(df: DataFrame, column: str) -> T.DataType:
    return df.schema[column].dataType


def show_ts(column: Column) -> Column:
    return F.date_format(column, TIMESTAMP_PATTERN)


def percent(part: Column, whole: Column, digits: int) -> Column:
    """``part * 100 / whole`` rounded, 0 when there is no base."""
    ratio = part * F.lit(100.0).cast("double") / whole
    return F.when(whole > 0, F.round(ratio, digits)).otherwise(F.lit(0.0).cast("double"))


def text_or_empty(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def nonempty(column: Column) -> Column:
    return F.nullif(column, F.lit(""))
