"""Row filters of the search: time, equality, text and dynamic JSON properties."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.base import ts_lit, type_of
from logloom.functions.props import column_text, prop_exists, prop_nested, prop_number, prop_text
from logloom.operators.timerange import TimeRange, resolve, resolve_live_preset

# --- fixed values -------------------------------------------------------------------------------
OPERATORS = [">=", "<=", "!=", ">", "<"]
EARLIEST, LATEST = "2000-01-01 00:00:00", "2100-01-01 00:00:00"
SCOPES = {"admin": ["admin", "write", "read", "ingest"], "write": ["write", "read", "ingest"],
          "read": ["read", "ingest"], "ingest": ["ingest"]}
# ------------------------------------------------------------------------------------------------
_NUMBER = re.compile(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$")


@dataclass(frozen=True)
class PropertyFilter:
    key: str
    value: str
    operator: str = "="


@dataclass(frozen=True)
class LogQuery:
    """All search criteria; empty members do not restrict."""

    source: str = ""
    level: str = ""
    search: str = ""
    properties: tuple[PropertyFilter, ...] = field(default=())

    @property
    def empty(self) -> bool:
        return not (self.source or self.level or self.search or self.properties)


def parse_op(text: str) -> tuple[str, str]:
    """``">=5"`` to ``(">=", "5")``; without a prefix the operator is ``=``."""
    for op in OPERATORS:
        if text.startswith(op):
            return op, text[len(op):]
    return "=", text


def parse_property_params(params: dict[str, str]) -> tuple[PropertyFilter, ...]:
    """``prop.<path>`` parameters to filters; an old-style trailing ``!`` of the name means not-equal."""
    out = []
    for name, value in params.items():
        if not name.startswith("prop.") or not value:
            continue
        if name.endswith("!"):
            out.append(PropertyFilter(name[5:-1], value, "!="))
        else:
            op, rest = parse_op(value)
            out.append(PropertyFilter(name[5:], rest, op))
    return tuple(out)


def is_numeric(text: str) -> bool:
    return bool(_NUMBER.match(text))


# --- time ---------------------------------------------------------------------------------------

def _bounded(df: DataFrame, column: str, low: datetime | None, high: datetime | None, low_inclusive: bool) -> DataFrame:
    """Range filter with literals of the column's own type, plus the day partition where there is one."""
    kind = type_of(df, column)
    if low is not None:
        edge = ts_lit(low, kind)
        df = df.filter(F.col(column) >= edge if low_inclusive else F.col(column) > edge)
    if high is not None:
        df = df.filter(F.col(column) <= ts_lit(high, kind))
    if "dt" in df.columns:
        if low is not None:
            df = df.filter(F.col("dt") >= F.lit(low.date()))
        if high is not None:
            df = df.filter(F.col("dt") <= F.lit(high.date()))
    return df


def time_between(df: DataFrame, start: datetime | None, end: datetime | None, as_of: datetime) -> DataFrame:
    """Inclusive bounds cut to seconds; without any bound, the 24 hours before ``as_of`` (exclusive)."""
    if start is None and end is None:
        return last_interval(df, timedelta(hours=24), as_of)
    cut = [None if t is None else t.replace(microsecond=0) for t in (start, end)]
    return _bounded(df, "timestamp", cut[0], cut[1], low_inclusive=True)


def in_range(df: DataFrame, rng: TimeRange, as_of: datetime, compat: bool = False) -> DataFrame:
    """A named or absolute range. The preset ``all`` means no filter; under ``compat``, the default day."""
    start, end = resolve(rng, as_of)
    if start is None and end is None and not compat:
        return df
    return time_between(df, start, end, as_of)


def last_interval(df: DataFrame, length: timedelta, as_of: datetime) -> DataFrame:
    return _bounded(df, "timestamp", as_of - length, None, low_inclusive=False)


def live_range(df: DataFrame, preset: str | None, as_of: datetime) -> DataFrame:
    return _bounded(df, "timestamp", resolve_live_preset(preset, as_of), None, low_inclusive=False)


def newer_than(df: DataFrame, since: datetime) -> DataFrame:
    return _bounded(df, "timestamp", since, None, low_inclusive=False)


def is_plausible(kind) -> Column:
    return (F.col("timestamp") > ts_lit(EARLIEST, kind)) & (F.col("timestamp") < ts_lit(LATEST, kind))


def plausible_ts(df: DataFrame) -> DataFrame:
    return df.filter(is_plausible(type_of(df, "timestamp")))


# --- equality and text ------------------------------------------------------------------------------

def message_like(term: str) -> Column:
    """Case-sensitive substring; ``%`` and ``_`` in the term act as wildcards unless a backslash precedes them."""
    return F.col("message").like(like_pattern(term))


def message_contains(term: str) -> Column:
    """Strict variant: no wildcards."""
    return F.contains(F.col("message"), F.lit(term))


def message_ilike(term: str) -> Column:
    return F.col("message").ilike(like_pattern(term))


def like_pattern(term: str) -> str:
    """Any other backslash stands for itself."""
    return "%" + re.sub(r"\\(?![%_])", r"\\\\", term) + "%"


# --- properties ------------------------------------------------------------------------------------

def prop_filter(flt: PropertyFilter) -> Column:
    """Numbers compare with all six operators, text only with equal and not-equal.

    A missing key counts as 0 or empty text, so ``x < 5`` and ``k != v`` keep rows without the key.
    """
    column = F.col("properties")
    if not is_numeric(flt.value):
        found = prop_text(column, flt.key)
        return found != flt.value if flt.operator == "!=" else found == flt.value
    found, wanted = prop_number(column, flt.key), F.lit(float(flt.value)).cast("double")
    return {"=": found == wanted, "!=": found != wanted, ">": found > wanted, ">=": found >= wanted,
            "<": found < wanted, "<=": found <= wanted}[flt.operator]


def has_props() -> Column:
    return (F.col("properties") != "") & (F.col("properties") != "{}")


def has_key(path: str) -> Column:
    return prop_exists(F.col("properties"), path)


def with_property_columns(df: DataFrame, paths: list[str]) -> DataFrame:
    """Dotted paths as text columns named like the paths."""
    return df.select("*", *[column_text(prop_nested(F.col("properties"), p)).alias(p) for p in paths])


# --- combined --------------------------------------------------------------------------------------

def predicates(query: LogQuery) -> list[Column]:
    """Cheap and pushable conditions first, JSON access last."""
    out = []
    if query.source:
        out.append(F.col("source") == query.source)
    if query.level:
        out.append(F.col("level") == query.level)
    if query.search:
        out.append(message_like(query.search))
    return out + [prop_filter(flt) for flt in query.properties]


def where(df: DataFrame, query: LogQuery) -> DataFrame:
    for condition in predicates(query):
        df = df.filter(condition)
    return df


def matches(query: LogQuery) -> Column:
    """All conditions as one never-NULL Boolean."""
    out = F.lit(True)
    for condition in predicates(query):
        out = out & condition
    return F.coalesce(out, F.lit(False))


def require_filter(query: LogQuery, action: str) -> None:
    if query.empty:
        raise ValueError(f"At least one filter is required to {action} logs")


def from_saved_query(row: dict) -> LogQuery:
    """A saved-query row to search criteria; unreadable filters are dropped."""
    try:
        items = json.loads(row.get("property_filters") or "[]")
    except ValueError:
        items = []
    if isinstance(items, dict):
        items = [{"key": k, "value": v} for k, v in items.items()]
    filters = tuple(PropertyFilter(i["key"], str(i.get("value", "")), i.get("operator") or "=") for i in items)
    return LogQuery(row.get("source") or "", row.get("level") or "", row.get("search") or "", filters)


def scope_list(csv: Column) -> Column:
    """Comma list of scopes; nothing at all means ``ingest``."""
    parts = F.filter(F.transform(F.split(csv, ","), F.trim), lambda s: s != "")
    return F.when(F.coalesce(csv, F.lit("")) == "", F.array(F.lit("ingest"))).otherwise(parts)


def with_scope(keys: DataFrame, scope: str) -> DataFrame:
    """Enabled keys that hold the scope or a wider one."""
    holders = [F.lit(held) for held, implied in SCOPES.items() if scope in implied]
    return keys.filter((F.col("enabled") == 1) & F.arrays_overlap(scope_list(F.col("scopes")), F.array(*holders)))
