"""Small configuration tables: keys, rules, destinations, saved queries, endpoints, dashboards."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.base import text_or_empty
from logloom.sources.storage import exists, remove, rename


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """All rows, newest first."""
    return newest_config(spark.read.parquet(path))


def newest_config(df: DataFrame) -> DataFrame:
    tie = [c for c in ("name", "id") if c in df.columns]
    return df.orderBy(F.desc("created_at"), *tie)


def write_config(df: DataFrame, path: str) -> None:
    """Replace a table as a whole: write beside it, then swap the folders."""
    spark = df.sparkSession
    fresh, old = (f"{path}._{tag}-{uuid.uuid4().hex}" for tag in ("new", "old"))
    df.write.parquet(fresh)
    had = exists(spark, path)
    if had:
        rename(spark, path, old)
    rename(spark, fresh, path)
    if had:
        remove(spark, old)
    spark.catalog.refreshByPath(path)


def upsert_rows(current: DataFrame, changes: DataFrame, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``changes`` replace those with the same key; ``keep`` columns hold their stored values."""
    untouched = current.join(changes.select(key), key, "left_anti").select(*current.columns)
    if keep:
        stored = current.select(key, *[F.col(c).alias(f"_{c}") for c in keep])
        changes = changes.join(stored, key, "left").select(
            *[F.coalesce(f"_{c}", c).alias(c) if c in keep else F.col(c) for c in current.columns])
    return untouched.unionByName(changes.select(*current.columns))


def update_where(df: DataFrame, condition: Column, changes: dict[str, object]) -> DataFrame:
    """Set columns on matching rows; no changes, no effect."""
    hit = F.coalesce(condition, F.lit(False))
    return df.select(*[F.when(hit, value if isinstance(value, Column) else F.lit(value)).otherwise(F.col(c))
                       .cast(df.schema[c].dataType).alias(c)
                       if (value := changes.get(c)) is not None else F.col(c) for c in df.columns])


def delete_rows(df: DataFrame, column: str, value: object) -> DataFrame:
    return df.filter(~F.col(column).eqNullSafe(F.lit(value)))


def endpoint_errors(endpoints: DataFrame) -> DataFrame:
    """Endpoint definitions with the list of their faults."""
    name, sql = text_or_empty(F.col("name")), text_or_empty(F.col("sql_query"))
    checks = F.array(
        F.when(name == "", "name: must not be empty")
         .when(~name.rlike("^[a-zA-Z0-9_-]+$"), "name: may hold only letters, digits, - and _"),
        F.when(sql == "", "sql_query: must not be empty")
         .when(~F.lower(F.trim(sql)).startswith("select"), "sql_query: has to begin with SELECT"),
        F.when(F.col("cache_ttl_seconds") < 0, "cache_ttl_seconds: below zero"))
    return endpoints.select("*", F.array_compact(checks).alias("errors"))
