"""Registry and the log model over the shared test tables.

The test tables have no log schema. Each view below is defined twice, in Spark and as a common table
expression for the oracle, with the same columns and values.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

AS_OF = datetime(2024, 1, 31)
NOW = "TIMESTAMP '2024-01-31 00:00:00'"
TEXT_TIME = "'%Y-%m-%d %H:%M:%S'"
MICROS = "yyyy-MM-dd HH:mm:ss.SSSSSS"
TEXT_MICROS = "'%Y-%m-%d %H:%M:%S.%f'"


def query(name: str, oracle: str | None = None, ctes: str | list[str] = ()):
    """Register ``fn(spark, sf_dir)``; ``ctes`` names the views its oracle SQL reads."""
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)

        QUERIES[name] = run
        if oracle is not None:
            names = [ctes] if isinstance(ctes, str) else list(ctes)
            head = ",\n".join(f"{n} AS ({CTES[n]})" for n in names)
            ORACLES[name] = f"WITH {head}\n{oracle}" if head else oracle
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("string")


def as_of(like: str = "timestamp_ntz") -> Column:
    return F.lit("2024-01-31 00:00:00").cast(like)


# --- views -------------------------------------------------------------------------------------------

CTES: dict[str, str] = {}

CTES["log_events"] = """
SELECT CAST(e.event_id AS VARCHAR) AS id, e.ts AS timestamp,
       CASE WHEN e.event_type = 'error' AND e.user_id % 10 = 0 THEN 'Fatal' WHEN e.event_type = 'error' THEN 'Error'
            WHEN e.event_type = 'signup' THEN 'Warning' WHEN e.event_type = 'view' THEN 'Debug' ELSE 'Information' END AS level,
       'User {user_id} did {event_type}' AS message_template,
       concat('User ', e.user_id, ' did ', e.event_type) AS message,
       '' AS exception, '' AS event_type, concat('svc-', e.user_id % 12) AS source, e.props AS properties
FROM events e"""


def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    user, kind = F.col("user_id"), F.col("event_type")
    level = (F.when((kind == "error") & (user % 10 == 0), "Fatal").when(kind == "error", "Error")
             .when(kind == "signup", "Warning").when(kind == "view", "Debug").otherwise("Information"))
    return table(spark, sf_dir, "events").select(
        text("event_id").alias("id"), F.col("ts").alias("timestamp"), level.alias("level"),
        F.lit("User {user_id} did {event_type}").alias("message_template"),
        F.concat(F.lit("User "), text("user_id"), F.lit(" did "), kind).alias("message"),
        F.lit("").alias("exception"), F.lit("").alias("event_type"),
        F.concat(F.lit("svc-"), text(user % 12)).alias("source"), F.col("props").alias("properties"))


CTES["doc_events"] = """
SELECT CAST(d.doc_id AS VARCHAR) AS id, TIMESTAMP '2024-01-30 00:00:00' + INTERVAL 1 SECOND * (d.doc_id % 86400) AS timestamp,
       'Information' AS level, '' AS message_template, d.text AS message, '' AS exception, '' AS event_type,
       d.source AS source, '{"lang":"' || d.lang || '","n":{"chars":' || d.n_chars || '}}' AS properties
FROM documents d"""


def doc_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long free texts as log messages, with nested properties."""
    seconds = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("doc_id") % 86400)
    props = F.concat(F.lit('{"lang":"'), F.col("lang"), F.lit('","n":{"chars":'), text("n_chars"), F.lit("}}"))
    return table(spark, sf_dir, "documents").select(
        text("doc_id").alias("id"), (F.lit("2024-01-30 00:00:00").cast("timestamp_ntz") + seconds).alias("timestamp"),
        F.lit("Information").alias("level"), F.lit("").alias("message_template"), F.col("text").alias("message"),
        F.lit("").alias("exception"), F.lit("").alias("event_type"), "source", props.alias("properties"))


CTES["api_keys"] = """
SELECT concat('key-', s_suppkey) AS api_key, concat('id-', s_suppkey) AS key_id, concat('svc-', s_suppkey % 15) AS name,
       CASE WHEN s_suppkey % 7 = 0 THEN 0 ELSE 1 END AS enabled,
       CASE s_suppkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'ingest' WHEN 2 THEN 'read, ingest' WHEN 3 THEN 'write' ELSE 'admin' END AS scopes,
       CAST((s_suppkey % 4) * 7 AS BIGINT) AS retention_days, concat('2024-01-01T00:00:', s_suppkey) AS created_at
FROM supplier"""


def api_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    scopes = (F.when(k % 5 == 0, "").when(k % 5 == 1, "ingest").when(k % 5 == 2, "read, ingest")
              .when(k % 5 == 3, "write").otherwise("admin"))
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("key-"), text(k)).alias("api_key"), F.concat(F.lit("id-"), text(k)).alias("key_id"),
        F.concat(F.lit("svc-"), text(k % 15)).alias("name"), F.when(k % 7 == 0, 0).otherwise(1).alias("enabled"),
        scopes.alias("scopes"), ((k % 4) * 7).cast("bigint").alias("retention_days"),
        F.concat(F.lit("2024-01-01T00:00:"), text(k)).alias("created_at"))


CTES["policy_log"] = """
SELECT concat('svc-', c_custkey % 14) AS source, CAST(c_nationkey AS BIGINT) AS retention_days,
       TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 SECOND * c_custkey AS updated_at
FROM customer"""

CTES["policies"] = """
SELECT source, retention_days FROM (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY updated_at DESC) AS rn FROM policy_log)
WHERE rn = 1 AND retention_days > 0"""


def policy_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every policy ever written; the latest per source counts."""
    k = F.col("c_custkey")
    seconds = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), k)
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("svc-"), text(k % 14)).alias("source"), F.col("c_nationkey").cast("bigint").alias("retention_days"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + seconds).alias("updated_at"))


CTES["alerts"] = f"""
SELECT concat('alert-', p_partkey) AS id,
       concat(p_name, CASE p_partkey % 4 WHEN 0 THEN ' - Failures' WHEN 1 THEN ' Errors' WHEN 2 THEN ' alert' ELSE '' END) AS name,
       p_type AS description,
       CASE WHEN p_partkey % 8 = 7 THEN 'DELETE FROM events' WHEN p_partkey % 8 = 6 THEN '' ELSE 'SELECT count(*) AS cnt FROM events' END AS query,
       CASE WHEN p_partkey % 9 = 8 THEN '' ELSE concat('cnt > ', p_size) END AS condition,
       CAST(p_size * 2 AS BIGINT) AS interval_seconds, CAST(300 + (p_partkey % 1000) * 60 AS BIGINT) AS cooldown_seconds,
       CASE WHEN p_partkey % 3 = 0 THEN '[]' ELSE concat('["ops@example.com","', p_brand, '@example.com"]') END AS recipients,
       CASE p_partkey % 3 WHEN 0 THEN concat('["dest-', p_partkey % 100, '","dest-', (p_partkey + 1) % 100, '"]')
            WHEN 1 THEN '[]' ELSE 'not json' END AS destination_ids,
       CASE WHEN p_partkey % 11 = 10 THEN '' ELSE concat('[ALERT] ', p_name) END AS subject,
       CASE WHEN p_partkey % 10 = 9 THEN 0 ELSE 1 END AS enabled,
       {NOW} - INTERVAL 1 HOUR * p_partkey AS created_at,
       CASE WHEN p_partkey % 5 = 0 THEN TIMESTAMP '1970-01-01 00:00:00' ELSE {NOW} - INTERVAL 1 MINUTE * p_partkey END AS last_triggered_at
FROM part"""


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    ending = F.when(k % 4 == 0, " - Failures").when(k % 4 == 1, " Errors").when(k % 4 == 2, " alert").otherwise("")
    sql = F.when(k % 8 == 7, "DELETE FROM events").when(k % 8 == 6, "").otherwise("SELECT count(*) AS cnt FROM events")
    ids = (F.when(k % 3 == 0, F.concat(F.lit('["dest-'), text(k % 100), F.lit('","dest-'), text((k + 1) % 100), F.lit('"]')))
           .when(k % 3 == 1, "[]").otherwise("not json"))
    mails = F.when(k % 3 == 0, "[]").otherwise(
        F.concat(F.lit('["ops@example.com","'), F.col("p_brand"), F.lit('@example.com"]')))
    minutes = F.make_dt_interval(F.lit(0), F.lit(0), k.cast("int"))
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("alert-"), text(k)).alias("id"), F.concat("p_name", ending).alias("name"),
        F.col("p_type").alias("description"), sql.alias("query"),
        F.when(k % 9 == 8, "").otherwise(F.concat(F.lit("cnt > "), text("p_size"))).alias("condition"),
        (F.col("p_size") * 2).cast("bigint").alias("interval_seconds"),
        (F.lit(300) + (k % 1000) * 60).cast("bigint").alias("cooldown_seconds"),
        mails.alias("recipients"), ids.alias("destination_ids"),
        F.when(k % 11 == 10, "").otherwise(F.concat(F.lit("[ALERT] "), "p_name")).alias("subject"),
        F.when(k % 10 == 9, 0).otherwise(1).alias("enabled"),
        (as_of() - F.make_dt_interval(F.lit(0), k.cast("int"))).alias("created_at"),
        F.when(k % 5 == 0, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")).otherwise(as_of() - minutes).alias("last_triggered_at"))


CTES["destinations"] = """
SELECT concat('dest-', s_suppkey) AS id, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'email' ELSE 'webhook' END AS type,
       CASE WHEN s_suppkey % 2 = 0 THEN concat('{"email":"box', s_suppkey, '@example.com"}')
            ELSE concat('{"url":"https://hooks.example.com/', s_suppkey, '","timeout_seconds":', (s_suppkey % 3) * 5, '}') END AS config,
       CASE WHEN s_suppkey % 6 = 0 THEN 0 ELSE 1 END AS enabled
FROM supplier"""


def destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    config = F.when(k % 2 == 0, F.concat(F.lit('{"email":"box'), text(k), F.lit('@example.com"}'))).otherwise(
        F.concat(F.lit('{"url":"https://hooks.example.com/'), text(k), F.lit('","timeout_seconds":'), text((k % 3) * 5), F.lit("}")))
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("dest-"), text(k)).alias("id"), F.col("s_name").alias("name"),
        F.when(k % 2 == 0, "email").otherwise("webhook").alias("type"), config.alias("config"),
        F.when(k % 6 == 0, 0).otherwise(1).alias("enabled"))


CTES["endpoints"] = f"""
SELECT concat('ep-', n_nationkey) AS name, n_name AS description,
       concat('SELECT source, count(*) AS n FROM events WHERE level = @level AND message LIKE @like', n_regionkey, ' GROUP BY source') AS sql_query,
       CAST(n_regionkey * 10 AS BIGINT) AS cache_ttl_seconds, CASE WHEN n_nationkey % 4 = 3 THEN 0 ELSE 1 END AS enabled,
       {NOW} - INTERVAL 1 DAY * n_nationkey AS created_at
FROM nation"""


def endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    sql = F.concat(F.lit("SELECT source, count(*) AS n FROM events WHERE level = @level AND message LIKE @like"),
                   text("n_regionkey"), F.lit(" GROUP BY source"))
    return table(spark, sf_dir, "nation").select(
        F.concat(F.lit("ep-"), text(k)).alias("name"), F.col("n_name").alias("description"), sql.alias("sql_query"),
        (F.col("n_regionkey") * 10).cast("bigint").alias("cache_ttl_seconds"), F.when(k % 4 == 3, 0).otherwise(1).alias("enabled"),
        (as_of() - F.make_dt_interval(k.cast("int"))).alias("created_at"))


CTES["dashboards"] = """
SELECT CASE WHEN c_custkey % 6 = 5 THEN concat('bad name ', c_custkey) ELSE concat('board-', c_custkey) END AS name,
       CASE WHEN c_custkey % 10 = 9 THEN ''
            WHEN c_custkey % 10 = 8 THEN '{"layout":"free","widgets":[]}'
            ELSE concat('{"layout":"auto","widgets":[{"id":"a","type":"stat","title":"A","dataSource":{"type":"endpoint","endpointName":"',
                        CASE WHEN c_custkey % 7 = 6 THEN '' ELSE concat('ep-', c_nationkey + c_custkey % 3) END,
                        '"}},{"id":"b","type":"', CASE WHEN c_custkey % 5 = 4 THEN 'pie_chart' ELSE 'table' END,
                        '","title":"B","dataSource":{"type":"inline","sql":"',
                        CASE WHEN c_custkey % 4 = 3 THEN 'drop table x' ELSE 'select 1 as value' END, '"}}]}') END AS config
FROM customer"""


def dashboards(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    config = (F.when(k % 10 == 9, "").when(k % 10 == 8, '{"layout":"free","widgets":[]}').otherwise(F.concat(
        F.lit('{"layout":"auto","widgets":[{"id":"a","type":"stat","title":"A","dataSource":{"type":"endpoint","endpointName":"'),
        F.when(k % 7 == 6, "").otherwise(F.concat(F.lit("ep-"), text(F.col("c_nationkey") + k % 3))),
        F.lit('"}},{"id":"b","type":"'), F.when(k % 5 == 4, "pie_chart").otherwise("table"),
        F.lit('","title":"B","dataSource":{"type":"inline","sql":"'),
        F.when(k % 4 == 3, "drop table x").otherwise("select 1 as value"), F.lit('"}}]}'))))
    return table(spark, sf_dir, "customer").select(
        F.when(k % 6 == 5, F.concat(F.lit("bad name "), text(k))).otherwise(F.concat(F.lit("board-"), text(k))).alias("name"),
        config.alias("config"))


_STAMP = "strftime(TIMESTAMP '2020-01-01 00:00:00' + INTERVAL 1 HOUR * {k}, '%Y-%m-%d-%H%M%S')"
CTES["snapshots"] = f"""
SELECT concat(CASE WHEN o_orderkey % 3 > 0 THEN 'logs-incr-' WHEN o_orderkey % 30 = 0 THEN 'logs-' ELSE 'logs-full-' END,
              {_STAMP.format(k='o_orderkey')}) AS name,
       CASE WHEN o_orderkey % 3 = 0 THEN 'full' ELSE 'incremental' END AS type,
       CASE WHEN o_orderkey % 3 = 0 THEN 'none'
            ELSE concat(CASE WHEN (o_orderkey - o_orderkey % 3) % 30 = 0 THEN 'logs-' ELSE 'logs-full-' END,
                        {_STAMP.format(k='(o_orderkey - o_orderkey % 3)')}) END AS base,
       TIMESTAMP '2020-01-01 00:00:00' + INTERVAL 1 HOUR * o_orderkey AS timestamp,
       CASE WHEN o_orderstatus = 'P' THEN 'BACKUP_FAILED' ELSE 'BACKUP_CREATED' END AS status,
       CAST(o_custkey AS BIGINT) AS rows, CAST(floor(o_totalprice * 1000) AS BIGINT) AS size_bytes
FROM orders"""


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    first = k - k % 3

    def moment(n: Column) -> Column:
        return F.lit("2020-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), n.cast("int"))

    def stamp(n: Column) -> Column:
        return F.date_format(moment(n), "yyyy-MM-dd-HHmmss")

    return table(spark, sf_dir, "orders").select(
        F.concat(F.when(k % 3 > 0, "logs-incr-").when(k % 30 == 0, "logs-").otherwise("logs-full-"), stamp(k)).alias("name"),
        F.when(k % 3 == 0, "full").otherwise("incremental").alias("type"),
        F.when(k % 3 == 0, "none").otherwise(
            F.concat(F.when(first % 30 == 0, "logs-").otherwise("logs-full-"), stamp(first))).alias("base"),
        moment(k).alias("timestamp"),
        F.when(F.col("o_orderstatus") == "P", "BACKUP_FAILED").otherwise("BACKUP_CREATED").alias("status"),
        F.col("o_custkey").cast("bigint").alias("rows"), F.floor(F.col("o_totalprice") * 1000).cast("bigint").alias("size_bytes"))
