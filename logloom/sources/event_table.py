"""The event table: Parquet, one folder per day, sorted by source, hour and level inside each file.

A delete marks rows by day, file and row number in a small table beside the files; readers leave marked rows out, and
``compact`` folds the marks into rewritten days. A delete shows as a whole: its marks count from the moment their
commit file exists. Appends may run at any time, but not into a day that is being rewritten or compacted, since its files
are replaced; deletes, rewrites and compaction want one maintenance job at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.functions.base import text_or_empty
from logloom.schema import EVENT, EVENT_COLUMNS
from logloom.session import scratch
from logloom.sources.storage import children, exists, remove, touch

MARKS, COMMIT = "_deleted", "_COMMITTED"  # underscores hide both from Spark's own listing
MARK = "dt date, file string, row bigint"
TABLE = T.StructType([*EVENT.fields, T.StructField("dt", T.DateType())])


def shaped(events: DataFrame) -> DataFrame:
    """Contract columns: milliseconds, empty text instead of NULL, derived day, an id where it is missing."""
    columns = []
    for name in EVENT_COLUMNS:
        if name == "timestamp":
            columns.append(F.date_trunc("MILLISECOND", F.col("timestamp").cast("timestamp")).alias(name))
        elif name == "id":
            columns.append((F.coalesce("id", F.uuid()) if "id" in events.columns else F.uuid()).alias(name))
        elif name == "properties":
            columns.append(F.coalesce(name, F.lit("{}")).alias(name))
        else:
            columns.append(text_or_empty(F.col(name)).alias(name))
    return events.select(*columns).withColumn("dt", F.to_date("timestamp"))


def arranged(rows: DataFrame, *partition: str) -> DataFrame:
    """Rows spread so that each output folder gets few files of even size (a hot day is split, small days
    share a task), sorted for min/max skipping."""
    hour = F.date_trunc("HOUR", F.col("timestamp"))
    return rows.hint("rebalance", *partition).sortWithinPartitions(*partition, "source", hour, "level")


def write_events(events: DataFrame, path: str, mode: str = "append") -> None:
    arranged(shaped(events), "dt").write.mode(mode).partitionBy("dt").parquet(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """All rows that are not marked as deleted; without marks this is the plain scan.

    Filters pass below the anti-join, so only rows a query asks for are looked up. Small marks are broadcast by their
    measured size; many marks make it a shuffle join, which is the time for ``compact``.
    """
    rows = spark.read.schema(TABLE).parquet(path)
    marks = read_marks(spark, path)
    if marks is None:
        return rows
    place = rows.metadataColumn("_metadata")
    marks = marks.select(F.col("dt").alias("_dt"), F.col("file").alias("_file"), F.col("row").alias("_row"))
    same = (rows["dt"] == marks["_dt"]) & (place["file_name"] == marks["_file"]) & (place["row_index"] == marks["_row"])
    return rows.join(marks, same, "left_anti")


# --- marks of deleted rows -----------------------------------------------------------------------------

def _commits(spark: SparkSession, path: str) -> list[str]:
    return [f for f in children(spark, f"{path}/{MARKS}") if exists(spark, f"{f}/{COMMIT}")]


def read_marks(spark: SparkSession, path: str) -> DataFrame | None:
    """Committed marks (dt, file, row), or None where nothing is marked."""
    commits = _commits(spark, path)
    return spark.read.schema(MARK).parquet(*commits) if commits else None


def _commit(spark: SparkSession, path: str, marks: DataFrame) -> str:
    folder = f"{path}/{MARKS}/{uuid.uuid4().hex}"
    marks.write.parquet(folder)
    touch(spark, f"{folder}/{COMMIT}")
    return folder


def mark_deleted(spark: SparkSession, path: str, condition: Column) -> DataFrame:
    """Mark the rows that meet ``condition``; returns the new marks. No event row is written.

    Rows marked before are not met again. Interrupted before the commit, nothing has changed.
    """
    return mark_rows(spark, path, read_events(spark, path).filter(condition))


def mark_rows(spark: SparkSession, path: str, hits: DataFrame) -> DataFrame:
    """Mark ``hits``, rows of ``read_events`` after filters, semi or inner joins."""
    marks = hits.select("dt", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    return spark.read.schema(MARK).parquet(_commit(spark, path, marks))


def marked_shares(spark: SparkSession, path: str) -> DataFrame:
    """(dt, marked, rows) of the days that hold marks: what compaction would gain. Row counts come from file footers."""
    marks = read_marks(spark, path)
    if marks is None:
        return spark.createDataFrame([], "dt date, marked bigint, rows bigint")
    stored = spark.read.schema(TABLE).parquet(path).groupBy("dt").agg(F.count(F.lit(1)).alias("rows"))
    return marks.distinct().groupBy("dt").agg(F.count(F.lit(1)).alias("marked")).join(stored, "dt")


def _forget_marks(spark: SparkSession, path: str, days: list[date]) -> None:
    """Drop the marks of days whose files are gone. The others are committed anew first; a mark met twice does no harm."""
    old = _commits(spark, path)
    if not old:
        return
    left = spark.read.schema(MARK).parquet(*old).filter(~F.col("dt").isin(days))
    if not left.isEmpty():
        _commit(spark, path, left)
    for folder in old:
        remove(spark, folder)


def file_list(spark: SparkSession, path: str) -> DataFrame:
    """(dt, file, bytes, modified, marked) of every file, from the listing and the marks; no event row is read."""
    listed = (spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet")
              .schema("path string, modificationTime timestamp, length bigint, content binary, dt date").load(path)
              .select("dt", F.substring_index("path", "/", -1).alias("file"), F.col("length").alias("bytes"),
                      F.col("modificationTime").alias("modified")))
    marks = read_marks(spark, path)
    if marks is None:
        return listed.withColumn("marked", F.lit(0).cast("bigint"))
    counted = marks.distinct().groupBy("dt", "file").agg(F.count(F.lit(1)).alias("marked"))
    return listed.join(counted, ["dt", "file"], "left").fillna({"marked": 0})


def append_event(spark: SparkSession, level: str, message: str, source: str, as_of: datetime,
                 message_template: str = "", exception: str = "", event_type: str = "",
                 properties: dict | None = None) -> DataFrame:
    """One structured event with its defaults; the type stays empty unless given."""
    row = (as_of, level, message_template or message, message, exception, event_type, source,
           json.dumps(properties) if properties else "{}")
    schema = T.StructType([f for f in EVENT.fields if f.name != "id"])
    return shaped(spark.createDataFrame([row], schema))


def rewrite_days(spark: SparkSession, path: str, days: Iterable[date], survivors: DataFrame) -> None:
    """Replace whole day folders by ``survivors`` (which may read the same table).

    The survivors are written to the shared folder first; only then are the table's folders overwritten, one
    job for all of them, and folders left without rows removed. Interrupted before that job, nothing has
    changed; interrupted later, running the same operation again completes it.
    """
    days = sorted(set(days))
    if not days:
        return
    staging = scratch(spark, "rewrite")
    try:
        arranged(survivors.select(*TABLE.fieldNames()), "dt").write.partitionBy("dt").parquet(staging)
        staged = spark.read.schema(TABLE).parquet(staging)
        kept = {r["dt"] for r in staged.select("dt").distinct().collect()}
        (staged.sortWithinPartitions("dt", "source", F.date_trunc("HOUR", F.col("timestamp")), "level")
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt").parquet(path))
        drop_days(spark, path, [day for day in days if day not in kept])
        _forget_marks(spark, path, days)
    finally:
        if exists(spark, staging):
            remove(spark, staging)


def drop_days(spark: SparkSession, path: str, days: Iterable[date]) -> None:
    """Remove whole day folders: no row is read or written."""
    for day in days:
        remove(spark, f"{path}/dt={day.isoformat()}")
    spark.catalog.refreshByPath(path)


def compact(spark: SparkSession, path: str, days: Iterable[date]) -> None:
    """Merge the small files that micro-batches leave in the given days, and fold in the marks of deleted rows."""
    days = list(days)
    rewrite_days(spark, path, days, read_events(spark, path).filter(F.col("dt").isin(days)))
