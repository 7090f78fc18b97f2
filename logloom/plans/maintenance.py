"""Deleting, retention, renaming and policy upkeep on a stored event table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.base import ts_lit
from logloom.operators.aggregates import count_rows, retention_policies
from logloom.operators.filters import LogQuery, matches, require_filter
from logloom.operators.joins import expired
from logloom.sources.event_table import compact, drop_days, file_list, mark_deleted, mark_rows, marked_shares, read_events, rewrite_days
from logloom.session import scratch


def _days(hits: DataFrame) -> dict:
    """Affected days with their counts; the list is as long as the table has days, not rows."""
    return {r["dt"]: r["n"] for r in hits.groupBy("dt").agg(count_rows().alias("n")).collect()}


def delete_where(spark: SparkSession, path: str, query: LogQuery) -> int:
    """Delete matching rows by marking them; returns how many there were. No day is rewritten."""
    require_filter(query, "delete")
    return mark_deleted(spark, path, matches(query)).count()


def apply_retention(spark: SparkSession, path: str, policies: DataFrame, as_of: datetime) -> DataFrame:
    """Trim every source by its policy in one pass; returns (source, removed).

    Days of which nothing remains lose their folder, without a row being read or written again; in the others the
    expired rows are marked. The counts are a written table: their number grows with the sources.
    """
    listed = _files(spark, path)
    table = read_events(spark, path)
    late = expired(table, policies, as_of)
    saved = scratch(spark, "expired")
    late.groupBy("dt", "source").agg(count_rows().alias("n")).write.parquet(saved)
    counts = spark.read.parquet(saved)
    gone = counts.groupBy("dt").agg(F.sum("n").alias("n"))
    rows = table.groupBy("dt").agg(count_rows().alias("rows"))
    days = {r["dt"]: r["n"] == r["rows"] for r in gone.join(rows, "dt").collect()}
    now = _files(spark, path)  # a day that got a file meanwhile keeps its folder
    whole = [d for d, empty in days.items() if empty and listed.get(d) == now.get(d)]
    partial = [d for d in days if d not in set(whole)]
    if partial:
        mark_rows(spark, path, expired(table.filter(F.col("dt").isin(partial)), policies, as_of))
    drop_days(spark, path, whole)
    return counts.groupBy("source").agg(F.sum("n").alias("removed"))


def _files(spark: SparkSession, path: str) -> dict:
    return {r["dt"]: r["n"] for r in file_list(spark, path).groupBy("dt").agg(count_rows().alias("n")).collect()}


def fold_marks(spark: SparkSession, path: str, share: float = 0.1) -> list:
    """Compact the days of which at least ``share`` of the rows is marked; returns these days."""
    days = [r["dt"] for r in marked_shares(spark, path).filter(F.col("marked") >= share * F.col("rows")).select("dt").collect()]
    if days:
        compact(spark, path, days)
    return sorted(days)


def unmatched_policies(events: DataFrame, policies: DataFrame) -> DataFrame:
    """Policies whose source never occurs (a source may be renamed by the payload itself)."""
    return policies.join(events.select("source").distinct(), "source", "left_anti").select(*policies.columns)


def rename_source(spark: SparkSession, path: str, old: str, new: str) -> int:
    """Give all rows of one source another name; checks the count before replacing anything."""
    table = read_events(spark, path)
    hit = F.col("source") == old
    days = _days(table.filter(hit))
    if not days:
        return 0
    touched = table.filter(F.col("dt").isin(list(days)))
    renamed = touched.withColumn("source", F.when(hit, F.lit(new)).otherwise(F.col("source")))
    already = touched.filter(F.col("source") == new).count()
    if renamed.filter(F.col("source") == new).count() != already + sum(days.values()):
        raise RuntimeError("row counts differ, nothing was changed")
    rewrite_days(spark, path, days, renamed)
    return sum(days.values())


def sync_policies(keys: DataFrame, as_of: datetime) -> DataFrame:
    """The policy table that follows from the key registry; written as a whole, so stale rows vanish with it."""
    return retention_policies(keys).withColumn("updated_at", ts_lit(as_of))


def trimmed_counts(events: DataFrame, policies: DataFrame, as_of: datetime) -> DataFrame:
    """What a retention pass would remove, per policy: (source, retention_days, expired)."""
    gone = expired(events, policies, as_of).groupBy("source").agg(count_rows().alias("expired"))
    return (policies.join(gone, "source", "left")
            .select("source", "retention_days", F.coalesce("expired", F.lit(0)).alias("expired")))
