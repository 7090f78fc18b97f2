"""Helpers the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.session import scratch
from logloom.sources.storage import remove

#: White space of the query contracts; ``\S+`` of this class is a word.
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
BLANK_CHARS = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Exactly these columns, by position, so that extra columns may clash in any way (even in letter case)."""
    at = {c: i for i, c in reversed(list(enumerate(df.columns)))}
    missing = [n for n in names if n not in at]
    if missing:
        raise ValueError(f"missing column(s): {', '.join(missing)}")
    plain = df.toDF(*(f"_{i}" for i in range(len(df.columns))))
    return plain.select(*(F.col(f"_{at[n]}").alias(n) for n in names))


def ascii_lower(column: str | Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(column, _UPPER, _UPPER.lower())


def words_of(column: str | Column) -> Column:
    """The words of a text in order; an empty array for a text without words or null."""
    trimmed = F.btrim(F.coalesce(column, F.lit("")), F.lit(BLANK_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{BLANK}+"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row."""
    return F.transform(F.array(value), body)[0]


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage, survives lost executors.

    The folder goes when the session's JVM ends, or earlier by ``dropped``.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    gone_at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def gone_at_exit(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)


def bucketed(df: DataFrame, key: str, label: str) -> DataFrame:
    """As ``stored``, bucketed by ``key``: a ``looked_up`` join on it shuffles none of these rows.

    A task writes a file per bucket it meets, so rows of a key should be rows of one task. The table is named in the catalog
    only until its relation is read.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    name = f"spark_catalog.default.{path.rsplit('/', 1)[-1].replace('-', '_')}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").bucketBy(n, key).option("compression", "zstd").option("path", path).saveAsTable(name)
    gone_at_exit(spark, path)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # an external table: its files stay
    return out


def looked_up(rows: DataFrame, found: DataFrame, on: str | Column, how: str) -> DataFrame:
    """Join of a ``bucketed`` table with a smaller one, which alone is shuffled: ``rows`` stream past it, unsorted."""
    return rows.join(found.hint("shuffle_hash"), on, how)


#: Rows of a block of ``numbered``: 2 ** BLOCK at most.
BLOCK = 13


def numbered(df: DataFrame, label: str) -> DataFrame:
    """``df`` stored with a number of each row (``row``) and its ``block`` of numbers, bucketed by block."""
    rows = df.withColumn("row", F.monotonically_increasing_id())
    return bucketed(rows.withColumn("block", F.shiftright("row", BLOCK)), "block", label)


def chosen(rows: DataFrame, which: DataFrame, how: str = "left_semi") -> DataFrame:
    """The ``numbered`` rows whose ``row`` is in ``which`` (``left_anti``: is not). Only numbers are shuffled."""
    lists = which.groupBy(F.shiftright("row", BLOCK).alias("_block")).agg(F.collect_set("row").alias("_rows"))
    return looked_up(rows, lists, (F.col("block") == F.col("_block")) & F.array_contains("_rows", F.col("row")), how)


def dropped(df: DataFrame) -> None:
    """Remove a table of ``stored`` that nothing reads any more."""
    remove(df.sparkSession, df._stored_at)


def running_total(df: DataFrame, order: list[Column], value: Column, out: str, label: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over all rows before this one in ``order`` (which should have no ties).

    A range partitioning sorts, each partition sums alone, and only one subtotal per partition (their number is the
    session's shuffle setting, not the data's) meets in one place.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = {f"_k{i}": c for i, c in enumerate(order)}
    ranged = df.withColumns(keys | {"_v": value.cast("bigint")})
    dealt = ranged.repartitionByRange(n, *(F.col(k).asc_nulls_last() for k in keys)).withColumn("_part", F.spark_partition_id())
    kept = stored(dealt, label)
    totals = {r["_part"]: r["s"] for r in kept.groupBy("_part").agg(F.sum("_v").alias("s")).collect()}
    before, base = 0, []
    for part in sorted(totals):
        base.append((part, before))
        before += totals[part]
    offsets = spark.createDataFrame(base, "_part int, _base bigint")
    within = Window.partitionBy("_part").orderBy(*(F.col(k).asc_nulls_last() for k in keys)).rowsBetween(Window.unboundedPreceding, -1)
    summed = kept.withColumn("_before", F.coalesce(F.sum("_v").over(within), F.lit(0)))
    return (summed.join(F.broadcast(offsets), "_part", "left")  # one row per shuffle partition
            .withColumn(out, F.col("_before") + F.col("_base")).drop("_part", "_base", "_before", "_v", *keys))


def filled(column: pa.Array) -> pa.Array:
    """Texts of a batch with null as empty text."""
    return pc.fill_null(column.cast(pa.large_string()), "")


def lowered(texts: pa.Array) -> pa.Array:
    """Lower-case A-Z only, on the UTF-8 bytes."""
    out = texts.cast(pa.large_string())
    data = np.frombuffer(out.buffers()[2] or b"", np.uint8)
    if not len(data):
        return out
    changed = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    return pa.Array.from_buffers(pa.large_string(), len(out), [out.buffers()[0], out.buffers()[1], pa.py_buffer(changed)], offset=out.offset)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of a batch in one flat array, and where each text's words start (one more entry than texts)."""
    lists = pc.ascii_split_whitespace(texts)
    flat, starts = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    starts = starts - starts[0]
    full = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if full.all():
        return flat, starts
    before = np.concatenate([[0], np.cumsum(full)])
    return flat.filter(pa.array(full)), before[starts]


def batches_of(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches, cut to at most ``rows`` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def binaries(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """``data[starts[i]:starts[i+1]]`` as binary values, without a copy per value."""
    raw = np.ascontiguousarray(data)
    return pa.Array.from_buffers(pa.large_binary(), len(starts) - 1,
                                 [None, pa.py_buffer((starts * raw.itemsize).astype(np.int64)), pa.py_buffer(raw)]).cast(pa.binary())
