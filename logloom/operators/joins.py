"""Combinations of events with keys, policies, destinations and other tables.

No join carries a broadcast hint: Catalyst and adaptive execution broadcast a side when its measured size is
below ``spark.sql.autoBroadcastJoinThreshold`` and otherwise shuffle, splitting skewed partitions of the
event side.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.base import nonempty, ts_lit, type_of
from logloom.operators.windows import latest_by


def resolve_source(payloads: DataFrame, keys: DataFrame) -> DataFrame:
    """Payloads with a known, enabled key; their source is the key's name."""
    live = keys.filter(F.col("enabled") == 1).select("api_key", F.col("name").alias("source"))
    return payloads.drop("source").join(live, "api_key", "inner")


def rejected_payloads(payloads: DataFrame, keys: DataFrame) -> DataFrame:
    """Payloads without such a key, and why."""
    known = keys.select("api_key", "enabled")
    joined = payloads.join(known, "api_key", "left")
    return (joined.filter(F.coalesce(F.col("enabled"), F.lit(0)) != 1)
            .withColumn("reason", F.when(F.col("enabled").isNull(), "Invalid API key").otherwise("API key is disabled"))
            .drop("enabled"))


def current_policies(policies: DataFrame) -> DataFrame:
    """Latest row per source; days of 0 keep forever."""
    return latest_by(policies, "source", "updated_at").filter(F.col("retention_days") > 0)


def cutoffs(policies: DataFrame, as_of: datetime, like) -> DataFrame:
    moment = ts_lit(as_of, like) - F.make_dt_interval(F.col("retention_days").cast("int"))
    return policies.select(F.col("source").alias("_source"), moment.cast(like).alias("_cutoff"))


def _too_old(events: DataFrame, cut: DataFrame) -> Column:
    return (events["source"] == cut["_source"]) & (events["timestamp"] < cut["_cutoff"])


def expired(events: DataFrame, policies: DataFrame, as_of: datetime) -> DataFrame:
    """Rows older than their source's retention; only rows before the latest cutoff are read."""
    cut = cutoffs(policies, as_of, type_of(events, "timestamp"))
    latest = cut.agg(F.max("_cutoff"))
    events = events.filter(F.col("timestamp") < latest.scalar())
    if "dt" in events.columns:
        events = events.filter(F.col("dt") <= F.to_date(latest.scalar()))
    return events.join(cut, _too_old(events, cut), "left_semi")


def retained(events: DataFrame, policies: DataFrame, as_of: datetime) -> DataFrame:
    cut = cutoffs(policies, as_of, type_of(events, "timestamp"))
    return events.join(cut, _too_old(events, cut), "left_anti")


def targets(rules: DataFrame, destinations: DataFrame) -> DataFrame:
    """One row per rule and enabled destination, or per recipient where the rule lists no destinations.

    ``rules`` carries ``destination_ids`` and ``recipients`` as arrays.
    """
    has_ids = F.size("destination_ids") > 0
    dest = destinations.filter(F.col("enabled") == 1).select(
        F.col("id").alias("destination_id"), F.col("name").alias("destination_name"),
        F.col("type").alias("channel"), "config")
    by_id = (rules.filter(has_ids).withColumn("destination_id", F.explode(F.array_distinct("destination_ids")))
             .join(dest, "destination_id", "inner"))
    by_mail = (rules.filter(~has_ids).withColumn("_to", F.explode("recipients"))
               .withColumns({"destination_id": F.lit(""), "destination_name": F.lit(""), "channel": F.lit("email"),
                             "config": F.to_json(F.struct(F.col("_to").alias("email")))}).drop("_to"))
    return by_id.select(*by_mail.columns).unionByName(by_mail)


def bind_endpoints(widgets: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Widgets with the SQL they run and what is wrong with their data source, if anything."""
    ends = endpoints.select(F.col("name").alias("endpoint_name"), F.col("sql_query").alias("_sql"),
                            F.col("enabled").alias("_enabled"))
    joined = widgets.join(ends, "endpoint_name", "left")
    by_name = F.col("source_type") == "endpoint"
    problem = (F.when(by_name & F.coalesce(nonempty(F.col("endpoint_name")), F.lit("")).eqNullSafe(""), "Endpoint name is required")
               .when(by_name & F.col("_enabled").isNull(), "Endpoint not found")
               .when(by_name & (F.col("_enabled") != 1), "Endpoint is disabled")
               .when(~by_name & (F.col("source_type") != "inline"), "Unknown data source type")
               .when(~by_name & F.coalesce(F.col("sql"), F.lit("")).eqNullSafe(""), "SQL is required"))
    return (joined.withColumn("error", F.coalesce(problem, F.lit("")))
            .withColumn("sql", F.when(F.col("error") == "", F.when(by_name, F.col("_sql")).otherwise(F.col("sql"))).otherwise(""))
            .drop("_sql", "_enabled"))


def with_scalar(df: DataFrame, value: DataFrame, name: str) -> DataFrame:
    """Add the single value of a one-row, one-column query to every row."""
    return df.select("*", value.scalar().alias(name))


def merge_registry(known: DataFrame, rows: DataFrame) -> DataFrame:
    """Key registry from two sources, joined on the key.

    ``known`` (key, name, enabled) decides which keys live and their name, except that a generated
    ``discovered-*`` name yields to the other table's; ``rows`` gives ids, scopes, retention and age.
    """
    k = known.select(F.col("key").alias("api_key"), F.col("name").alias("k_name"), F.col("enabled").alias("k_enabled"),
                     F.lit(True).alias("in_known"))
    r = rows.select("api_key", "key_id", F.col("name").alias("r_name"), F.col("enabled").alias("r_enabled"),
                    "scopes", "retention_days", "created_at")
    both = k.join(r, "api_key", "full_outer")
    in_known = F.coalesce(F.col("in_known"), F.lit(False))
    generated = F.col("k_name").startswith("discovered-")
    return both.select(
        "api_key",
        # a key without an id gets one that depends on the key alone, so that reruns agree
        F.coalesce("key_id", F.md5("api_key")).alias("key_id"),
        F.when(~in_known, F.col("r_name")).when(generated, F.coalesce("r_name", "k_name")).otherwise(F.col("k_name")).alias("name"),
        F.when(in_known, F.when(F.col("k_enabled").eqNullSafe(False), 0).otherwise(1))
         .otherwise(F.when(F.col("r_enabled") == 0, 0).otherwise(1)).alias("enabled"),
        F.coalesce(nonempty(F.col("scopes")), F.lit("ingest")).alias("scopes"),
        F.coalesce("retention_days", F.lit(0)).cast("bigint").alias("retention_days"),
        F.coalesce("created_at", F.lit("1970-01-01T00:00:00.000Z")).alias("created_at"))


def stale(current: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in the new set."""
    return current.join(new.select(key), key, "left_anti").select(*current.columns)


def delta(table: DataFrame, base: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``table`` that the base does not hold."""
    return table.join(base.select(*keys), keys, "left_anti").select(*table.columns)
