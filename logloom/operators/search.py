"""Searching, paging and ordering."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.functions.base import show_ts
from logloom.operators.filters import LogQuery, live_range, newer_than, time_between, where
from logloom.schema import EVENT_COLUMNS, LIVE_COLUMNS

# --- fixed values -------------------------------------------------------------------------------
DEFAULT_LIMIT = 100
LIVE_PAGE, LIVE_KEEP = 100, 500  # sizes a live view may ask for
ROW_CAP = 10000  # what a web route may ask for
# ------------------------------------------------------------------------------------------------


def project_events(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Event columns with the time as text."""
    return df.select(*[show_ts(F.col(c)).alias(c) if c == "timestamp" else F.col(c) for c in columns or EVENT_COLUMNS])


def newest_first(df: DataFrame, n: int = DEFAULT_LIMIT) -> DataFrame:
    """The newest ``n`` rows (each task keeps only its own top ``n``); equal times are ordered by id."""
    return df.orderBy(F.col("timestamp").desc(), F.col("id").asc()).limit(max(0, n))


def search_logs(df: DataFrame, query: LogQuery, as_of: datetime, start: datetime | None = None,
                end: datetime | None = None, limit: int = DEFAULT_LIMIT) -> DataFrame:
    return project_events(newest_first(where(time_between(df, start, end, as_of), query), limit))


def search_live(df: DataFrame, query: LogQuery, as_of: datetime, preset: str | None = None,
                since: datetime | None = None, start: datetime | None = None, end: datetime | None = None,
                limit: int = LIVE_PAGE) -> DataFrame:
    df = time_between(df, start, end, as_of) if (start or end) else live_range(df, preset, as_of)
    if since is not None:
        df = newer_than(df, since)
    return project_events(newest_first(where(df, query), limit), LIVE_COLUMNS)


def tail_page(shown: DataFrame, arrived: DataFrame, page: int | None = None, keep: int | None = None) -> DataFrame:
    """The arrivals in front of the shown rows, newest first, each id once.

    All arrivals are shown and all rows kept, unless the caller gives the size of a page or of the view.
    """
    fresh = unseen(arrived, shown)
    both = (fresh if page is None else newest_first(fresh, page)).unionByName(shown)
    return both.orderBy(F.col("timestamp").desc(), F.col("id").asc()) if keep is None else newest_first(both, keep)


def unseen(arrived: DataFrame, shown: DataFrame) -> DataFrame:
    return arrived.join(shown.select("id"), "id", "left_anti").select(*arrived.columns)


def prepend_event(page: DataFrame, event: DataFrame) -> DataFrame:
    """The looked-up event in front of a page that does not hold it already."""
    return event.join(page.select("id"), "id", "left_anti").select(*page.columns).unionByName(page)


def union_formats(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def lookup_by(df: DataFrame, column: str, value: object) -> DataFrame:
    return df.filter(F.col(column) == F.lit(value)).limit(1)


def status_rank(status: Column) -> Column:
    return F.when(status == "firing", 1).when(status == "recent", 2).otherwise(3)


def order_by_status(df: DataFrame) -> DataFrame:
    """Firing first, then by time, newest first; equal times by id where there is one."""
    ties = [F.col("id")] if "id" in df.columns else []
    return df.orderBy(status_rank(F.col("status")), F.col("triggered_at").desc(), *ties)


def table_sort(df: DataFrame, column: str | None, descending: bool = True, collation: str = "UNICODE") -> DataFrame:
    """Numbers by value, anything else by its text in the order of a collation; missing values last either way."""
    if not column:
        return df
    numeric = isinstance(df.schema[column].dataType, T.NumericType)
    key = F.col(column) if numeric else F.collate(F.col(column).cast("string"), collation)
    return df.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last())


def cap_rows(df: DataFrame, n: int) -> DataFrame:
    return df.limit(n)
