"""Full and incremental snapshots of the event table.

A snapshot keeps its table's file list and a fingerprint per day. An incremental one reads only the days whose files
(or marks of deleted rows) differ from its base's and stores only those whose fingerprint differs, too: where the base's rows are all still there it stores the new rows alone, otherwise the whole day.
Restoring therefore reproduces deletions and changes too, not only additions.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.base import ts_lit
from logloom.functions.text import readable_size, snapshot_kind
from logloom.operators.aggregates import count_rows
from logloom.operators.joins import delta
from logloom.operators.windows import newest, snapshot_stamp
from logloom.sources.event_table import TABLE, arranged, file_list, read_events
from logloom.sources.storage import exists, remove

# --- fixed values -------------------------------------------------------------------------------
NO_BASE = "none"
STAMP = "%Y-%m-%d-%H%M%S"
CREATED = "BACKUP_CREATED"
# ------------------------------------------------------------------------------------------------
MANIFEST = "name string, type string, base string, timestamp timestamp, status string, rows bigint, size_bytes bigint"


def row_hash() -> "F.Column":
    return F.xxhash64(*[F.col(c) for c in TABLE.fieldNames()])


def fingerprints(events: DataFrame) -> DataFrame:
    """Count and two order-free digests of every day's rows."""
    hashed = events.select("dt", row_hash().alias("h"))
    return hashed.groupBy("dt").agg(count_rows().alias("rows"), F.bit_xor("h").alias("x"),
                                    F.sum(F.shiftrightunsigned("h", 33)).alias("s"))


def touched_days(files: DataFrame, base: DataFrame) -> DataFrame:
    """Days of ``files`` whose list of files differs from ``base``'s: their fingerprint has to be taken anew.

    A file is the same with equal name, size, time and number of marked rows. A day that lost a file is touched, one
    without any file left is not listed.
    """
    key = ["dt", "file", "bytes", "modified", "marked"]
    fresh = files.join(base, key, "left_anti").select("dt")
    lost = base.join(files, key, "left_anti").select("dt").join(files.select("dt").distinct(), "dt", "left_semi")
    return fresh.union(lost).distinct()


def _fingerprint(spark: SparkSession, events: DataFrame, files: DataFrame, base: str) -> DataFrame:
    """Fingerprints of all days; those of days with unchanged files are the base's."""
    touched = touched_days(files, spark.read.parquet(f"{base}/files"))
    days = [r["dt"] for r in touched.collect()]
    kept = (spark.read.parquet(f"{base}/fingerprints").filter(~F.col("dt").isin(days))
            .join(files.select("dt").distinct(), "dt", "left_semi"))
    return fingerprints(events.filter(F.col("dt").isin(days))).unionByName(kept)


def snapshot_type(names: list[str], as_of: datetime, full_weekday: int) -> str:
    """``full`` without any full snapshot, or on the given weekday (0 = Sunday) unless done that day."""
    latest = latest_full(names)
    if latest is None:
        return "full"
    if as_of.isoweekday() % 7 != full_weekday:
        return "incremental"
    return "incremental" if f"logs-full-{as_of:%Y-%m-%d}" in latest else "full"


def latest_full(names: list[str]) -> str | None:
    fulls = sorted(n for n in names if n.startswith("logs-full-"))
    legacy = sorted(n for n in names if n.startswith("logs-") and n[5:6].isdigit())
    return (fulls or legacy or [None])[-1]


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    path = f"{root}/_manifest"
    return spark.read.schema(MANIFEST).parquet(path) if exists(spark, path) else spark.createDataFrame([], MANIFEST)


def _names(spark: SparkSession, root: str) -> list[str]:
    return [r["name"] for r in read_manifest(spark, root).select("name").collect()]


def changed_days(current: DataFrame, base: DataFrame) -> DataFrame:
    """Days of ``current`` with ``changed`` telling whether the base holds the same rows."""
    b = base.select("dt", F.col("rows").alias("b_rows"), F.col("x").alias("b_x"), F.col("s").alias("b_s"))
    same = (F.col("rows") == F.col("b_rows")) & (F.col("x") == F.col("b_x")) & (F.col("s") == F.col("b_s"))
    return current.join(b, "dt", "left").select("dt", "rows", "x", "s", (~F.coalesce(same, F.lit(False))).alias("changed"))


def take_snapshot(spark: SparkSession, table_path: str, root: str, as_of: datetime, full_weekday: int = 0) -> str:
    names = _names(spark, root)
    kind = snapshot_type(names, as_of, full_weekday)
    base = latest_full(names) if kind == "incremental" else None
    name = f"logs-{'full' if kind == 'full' else 'incr'}-{as_of.strftime(STAMP)}"
    home = f"{root}/{name}"
    file_list(spark, table_path).write.parquet(f"{home}/files")  # before the rows: a later file shows as a change next time
    files = spark.read.parquet(f"{home}/files")
    events = read_events(spark, table_path)
    known = base is not None and exists(spark, f"{root}/{base}/files")
    taken = _fingerprint(spark, events, files, f"{root}/{base}") if known else fingerprints(events)
    taken.write.parquet(f"{home}/fingerprints")
    current = spark.read.parquet(f"{home}/fingerprints")
    if base is None:
        _store(events, f"{home}/events")
        current.select("dt", F.lit("full").alias("mode")).write.parquet(f"{home}/days")
    else:
        _store_increment(spark, events, current, f"{root}/{base}", home)
    files = (read_events(spark, f"{home}/events").groupBy(F.col("_metadata.file_path"))
             .agg(count_rows().alias("n"), F.max("_metadata.file_size").alias("size")))
    entry = files.agg(
        F.lit(name).alias("name"), F.lit(kind).alias("type"), F.lit(base or NO_BASE).alias("base"),
        ts_lit(as_of).alias("timestamp"), F.lit(CREATED).alias("status"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum("size"), F.lit(0)).alias("size_bytes"))
    entry.coalesce(1).write.mode("append").parquet(f"{root}/_manifest")
    return name


def _store(rows: DataFrame, path: str) -> None:
    arranged(rows.select(*TABLE.fieldNames()), "dt").write.partitionBy("dt").parquet(path)


def _store_increment(spark: SparkSession, events: DataFrame, current: DataFrame, base: str, home: str) -> None:
    compared = changed_days(current, spark.read.parquet(f"{base}/fingerprints"))
    days = [r["dt"] for r in compared.filter("changed").select("dt").collect()]
    now = events.filter(F.col("dt").isin(days)).withColumn("_h", row_hash())
    before = read_events(spark, f"{base}/events").filter(F.col("dt").isin(days)).withColumn("_h", row_hash())
    keys = ["dt", "id", "_h"]
    lost = {r["dt"] for r in delta(before, now, keys).select("dt").distinct().collect()}
    lost |= _repeated(spark, delta(now, before, keys), compared.filter("changed"), base)
    appended = [d for d in days if d not in lost]
    added = delta(now.filter(F.col("dt").isin(appended)), before.filter(F.col("dt").isin(appended)), keys)
    whole = now.filter(F.col("dt").isin(list(lost)))
    _store(added.unionByName(whole), f"{home}/events")
    mode = F.when(F.col("dt").isin(list(lost)), "replace").when(F.col("changed"), "delta").otherwise("same")
    compared.select("dt", mode.alias("mode")).write.parquet(f"{home}/days")


def _repeated(spark: SparkSession, added: DataFrame, changed: DataFrame, base: str) -> set:
    """Days whose new rows do not account for the growth: some repeat a row that is there already, so the day is stored whole."""
    grown = changed.join(spark.read.parquet(f"{base}/fingerprints").select("dt", F.col("rows").alias("b_rows")), "dt")
    counted = grown.join(added.groupBy("dt").agg(count_rows().alias("n")), "dt", "left")
    return {r["dt"] for r in counted.filter(F.col("rows") - F.col("b_rows") != F.coalesce("n", F.lit(0))).select("dt").collect()}


def restored_rows(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Rows of a snapshot: the base's unchanged and extended days, then the increment."""
    entry = read_manifest(spark, root).filter(F.col("name") == name).first()
    if entry is None:
        raise ValueError(f"Snapshot not found: {name}")
    own = read_events(spark, f"{root}/{name}/events")
    if entry["base"] == NO_BASE:
        return own
    days = spark.read.parquet(f"{root}/{name}/days").filter(F.col("mode") != "replace")
    kept = [r["dt"] for r in days.select("dt").collect()]
    return restore_union(read_events(spark, f"{root}/{entry['base']}/events").filter(F.col("dt").isin(kept)), own)


def restore_union(base: DataFrame, increment: DataFrame) -> DataFrame:
    return base.unionByName(increment)


def restore(spark: SparkSession, root: str, name: str, target: str) -> int:
    """Write a snapshot to a new path and return its row count."""
    if exists(spark, target):
        raise ValueError("restore into a new path")
    _store(restored_rows(spark, root, name), target)
    return read_events(spark, target).count()


def list_snapshots(manifest: DataFrame) -> DataFrame:
    """Completed snapshots, newest first."""
    return (manifest.filter(F.col("status") == CREATED).orderBy(F.desc("timestamp"), "name")
            .select("name", "timestamp", "size_bytes", readable_size(F.col("size_bytes")).alias("size_formatted"),
                    snapshot_kind(F.col("name")).alias("type")))


def prunable(manifest: DataFrame, keep: int) -> DataFrame:
    """Names beyond the newest ``keep`` that no incremental snapshot is based on."""
    kept = newest(manifest, keep).select("name")
    bases = manifest.filter(snapshot_kind(F.col("name")) == "incremental").select(F.col("base").alias("name")).filter(F.col("name") != NO_BASE)
    return manifest.join(kept, "name", "left_anti").join(bases, "name", "left_anti").select("name").orderBy(snapshot_stamp(F.col("name")))


def prune_snapshots(spark: SparkSession, root: str, keep: int) -> list[str]:
    from logloom.sources.config_tables import write_config

    manifest = read_manifest(spark, root)
    names = [r["name"] for r in prunable(manifest, keep).collect()]
    if names:
        write_config(manifest.filter(~F.col("name").isin(names)), f"{root}/_manifest")
        for name in names:
            remove(spark, f"{root}/{name}")
    return names
