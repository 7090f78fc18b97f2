"""File-system operations on table folders (through Hadoop, so that any store Spark reads will do)."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def touch(spark: SparkSession, path: str) -> None:
    """An empty file: the mark that what lies beside it is whole."""
    fs, p = _fs(spark, path)
    fs.create(p, True).close()


def children(spark: SparkSession, path: str) -> list[str]:
    """Folders directly below ``path``, in order of their names; none if it does not exist."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    return sorted(s.getPath().toString() for s in fs.listStatus(p) if s.isDirectory())


def rename(spark: SparkSession, old: str, new: str) -> None:
    fs, source = _fs(spark, old)
    _, target = _fs(spark, new)
    if not fs.rename(source, target):
        raise OSError(f"cannot rename {old} to {new}")

