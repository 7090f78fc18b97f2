"""Ingest of values whose JSON text is written in another way than it came: nested typed values, odd numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from logloom.plans.ingest import events_of, parse_messages
from logloom.suite.base import AS_OF, query, table, text
from logloom.suite.function_queries import murmur_ctes
from logloom.suite.ingest_queries import LINES_PER_MESSAGE, grouped_lines, message

_LEVELS = 6


def _typed(leaf: str) -> str:
    """SQL text of a typed value with ``_LEVELS`` levels, lists and key-value lists in turn around ``leaf``."""
    for level in range(_LEVELS):
        leaf = (f"concat('{{\"arrayValue\":{{\"values\":[', {leaf}, ',{{\"stringValue\":\"]}}}}{{\"}},{{}}]}}}}')" if level % 2 else
                f"concat('{{\"kvlistValue\":{{\"values\":[{{\"value\":{{\"doubleValue\":1e21}},\"key\":\"m{level}\"}},{{\"key\":\"k\",\"value\":', {leaf}, "
                f"'}},{{\"key\":\"m{level}\",\"value\":{{\"bytesValue\":\"AQI=\"}}}}]}}}}')")
    return leaf


def _plain(leaf: str) -> str:
    for level in range(_LEVELS):
        leaf = (f"concat('[', {leaf}, ',\"]}}}}{{\",null]')" if level % 2 else f"concat('{{\"k\":', {leaf}, ',\"m{level}\":\"0102\"}}')")
    return leaf


@query("ingest_otlp_nested", f"""
SELECT event_id AS no, concat('{{"deep":', {_plain("CAST(event_id AS VARCHAR)")}, ',"half":', CASE WHEN event_id % 2 = 0 THEN CAST(event_id // 2 AS VARCHAR)
  ELSE concat(event_id // 2, '.5') END, ',"long":9007199254740993}}') AS properties, {_plain("CAST(-event_id AS VARCHAR)")} AS message FROM events""")
def _(spark, sf):
    """Attribute values and bodies of six levels; keys repeat inside key-value lists, the last value wins; 64-bit integers stay."""
    deep, body = (_typed(f"concat('{{\"intValue\":{sign}', string(k), '{end}}}')") for sign, end in (('"', '"'), ("-", "")))
    record = (f"concat('{{\"timeUnixNano\":\"', string(k + 1), '000\",\"body\":', {body}, ',\"attributes\":[{{\"key\":\"long\",\"value\":{{\"intValue\":\"9007199254740993\"}}}},"
              f"{{\"key\":\"half\",\"value\":{{\"stringValue\":\"first\"}}}},{{\"key\":\"half\",\"value\":{{\"doubleValue\":', string(k / 2), "
              f"'}}}},{{\"key\":\"deep\",\"value\":', {deep}, '}}]}}')")
    # only keys are shuffled, records are written where they are grouped; a fixed number of parts, as few bytes make much to parse
    keys = table(spark, sf, "events").select(F.floor(F.col("event_id") / LINES_PER_MESSAGE).alias("number"), "event_id")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    grouped = (keys.repartition(parts, "number").groupBy("number").agg(F.array_sort(F.collect_list("event_id")).alias("keys"))
               .select("number", F.array_join(F.call_function("transform", F.col("keys"), F.expr(f"k -> {record}")), "\n").alias("body")))
    request = F.concat(F.lit('{"resourceLogs":[{"scopeLogs":[{"logRecords":['), F.replace(F.col("body"), F.lit("\n"), F.lit(",")), F.lit("]}]}]}"))
    raw = grouped.select(text("number").alias("message_id"), message(request, "otlp-logs", "collector").alias("raw"))
    events = events_of(parse_messages(raw, AS_OF.isoformat(" ")))
    return events.select((F.unix_micros("timestamp") - 1).alias("no"), "properties", "message")


_NUMBERS = """concat('{"a":', event_id * 10 + 5, ',"b":1.5e-9,"c":', event_id % 9 + 1, 'e+21,"d":', event_id % 9 + 1,
  '00000000000000000000,"e":9007199254740992,"f":', CASE WHEN event_id % 2 = 0 THEN CAST(event_id // 2 AS VARCHAR) ELSE concat(event_id // 2, '.5') END,
  ',"g":[0.000001,1e-7,100],"no":', event_id, ',"t":"1e3 \\u003cb\\u003e \\u0026 \\\\ 2.0"}')"""


@query("ingest_webhook_numbers", murmur_ctes(f"(SELECT event_id AS id, {_NUMBERS} AS s FROM events)") +
       "SELECT id AS no, s AS message, s AS properties, code AS event_type FROM hashed", "log_events")
def _(spark, sf):
    """Numbers with exponents, long and tiny ones and whole doubles: message, properties and event type, all from the text."""
    ev = table(spark, sf, "events")
    k = F.col("event_id")
    digit = text(k % 9 + 1)
    line = F.concat(
        F.lit('{"t":"1e3 <b> & \\\\ 2.0","a":'), text(k), F.lit('.5e1,"b":0.0000000015,"c":'), digit, F.lit("0" * 21), F.lit(',"d":'), digit, F.lit("0" * 20),
        F.lit(',"e":9007199254740993,"f":'), text(k / 2), F.lit(',"g":[1e-6,0.0000001,1.00E2],"no":'), text(k), F.lit("}"))
    raw = grouped_lines(ev, F.floor(k / LINES_PER_MESSAGE), line, "event_id").select(
        text("number").alias("message_id"), message(F.col("body"), "webhook", "hook").alias("raw"))
    events = events_of(parse_messages(raw, AS_OF.isoformat(" ")))
    return events.select(F.get_json_object("properties", "$.no").cast("bigint").alias("no"), "message", "properties", "event_type")
