"""Scalar helpers over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from logloom.functions import text as t
from logloom.functions.hashing import event_type
from logloom.functions.json_text import (
    canonical, filled, missing_entries, object_members, parse_float, render_template, without_entries,
)
from logloom.functions.props import prop_number, prop_text
from logloom.functions.timeparse import by_magnitude, rfc3339
from logloom.plans.sqlapi import register
from logloom.suite.base import (
    MICROS, TEXT_MICROS, TEXT_TIME, alerts, doc_events, endpoints, log_events, query, snapshots, table, text,
)

# MurmurHash3 in plain SQL: fold the 4-byte blocks with list_reduce, then the remainder and the finishing step.
_M = "% 4294967296"


def _word(h: str, i: str, n: int) -> str:
    """Little-endian number from ``n`` bytes of hex text ``h`` at byte ``i``."""
    one = [f"(instr('123456789ABCDEF', substr({h}, CAST(2 * ({i}) + {2 * b} + 1 AS INT), 1)) * 16"
           f" + instr('123456789ABCDEF', substr({h}, CAST(2 * ({i}) + {2 * b} + 2 AS INT), 1))) * {256 ** b}" for b in range(n)]
    return "CAST(" + " + ".join(one) + " AS UBIGINT)"


def _block(k: str) -> str:
    r = f"(({k} * 3432918353::UBIGINT) {_M})"
    return f"((((({r} << 15) | ({r} >> 17)) & 4294967295::UBIGINT) * 461845907::UBIGINT) {_M})"


def _rot13(x: str) -> str:
    return f"(((({x} << 13) | ({x} >> 19)) & 4294967295::UBIGINT) * 5::UBIGINT + 3864292196::UBIGINT) {_M}"


def murmur_ctes(source: str) -> str:
    """CTE chain from ``source(id, s)`` to ``hashed(id, s, code)``."""
    return f"""
, m0 AS (SELECT id, s, hex(encode(s)) AS h, CAST(octet_length(encode(s)) AS BIGINT) AS n FROM {source})
, m1 AS (SELECT id, s, h, n, list_transform(regexp_extract_all(h, '[0-9A-F]{{8}}'), lambda w: {_block(_word('w', '0', 4))}) AS ks FROM m0)
, m2 AS (SELECT id, s, h, n, CASE WHEN len(ks) = 0 THEN 0::UBIGINT
           ELSE list_reduce(list_prepend(0::UBIGINT, ks), lambda a, k: {_rot13('xor(a, k)')}) END AS st FROM m1)
, m3 AS (SELECT id, s, xor(CASE n % 4 WHEN 0 THEN st
           WHEN 1 THEN xor(st, {_block(_word('h', '(n // 4) * 4', 1))})
           WHEN 2 THEN xor(st, {_block(_word('h', '(n // 4) * 4', 2))})
           ELSE xor(st, {_block(_word('h', '(n // 4) * 4', 3))}) END, CAST(n AS UBIGINT)) AS x FROM m2)
, m4 AS (SELECT id, s, (xor(x, x >> 16) * 2246822507::UBIGINT) {_M} AS x FROM m3)
, m5 AS (SELECT id, s, (xor(x, x >> 13) * 3266489909::UBIGINT) {_M} AS x FROM m4)
, hashed AS (SELECT id, s, CASE WHEN s = '' THEN '' ELSE '0x' || lpad(lower(hex(xor(x, x >> 16))), 8, '0') END AS code FROM m5)
"""


@query("event_type_of_documents", murmur_ctes("(SELECT id, message AS s FROM doc_events)") + "SELECT id, code FROM hashed", "doc_events")
def _(spark, sf):
    return doc_events(spark, sf).select("id", event_type(F.lit(""), F.col("message")).alias("code"))


@query("event_type_of_messages", murmur_ctes("(SELECT DISTINCT '' AS id, message AS s FROM log_events)")
       + "SELECT e.id, hashed.code FROM log_events e JOIN hashed ON e.message = hashed.s", "log_events")
def _(spark, sf):
    return log_events(spark, sf).select("id", event_type(F.lit(""), F.col("message")).alias("code"))


@query("rendered_templates", "SELECT id, concat(message, ' {missing} ', properties->>'k') AS message FROM log_events", "log_events")
def _(spark, sf):
    """Templates filled from each row's own properties."""
    ev = table(spark, sf, "events")
    members = object_members(F.to_json(F.struct("user_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))))
    return ev.select(text("event_id").alias("id"), render_template(
        F.lit("User {user_id} did {event_type} {missing} {k}"), members).alias("message"))


@query("canonical_properties", """
SELECT l_orderkey || '-' || l_linenumber AS id,
  '{"a":' || l_partkey || ',"flag":"' || l_returnflag || '","q":' || CAST(l_quantity AS BIGINT) || ',"z":null}' AS props FROM lineitem""")
def _(spark, sf):
    """Members in ascending key order whatever order they came in."""
    li = table(spark, sf, "lineitem")
    raw = F.concat(F.lit('{"z":null, "q":'), text(F.col("l_quantity").cast("bigint")), F.lit(', "flag":"'), "l_returnflag",
                   F.lit('", "a":'), text("l_partkey"), F.lit("}"))
    return li.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), canonical(object_members(raw)).alias("props"))


@query("enriched_properties", """
SELECT CAST(event_id AS VARCHAR) AS id, '{"city":' || CASE WHEN user_id % 3 = 0 THEN '"Rome"' ELSE '"Lima"' END ||
  ',"k":' || CAST(props->>'k' AS BIGINT) || ',"zone":"z' || CAST(user_id % 5 AS VARCHAR) || '"}' AS props FROM events""")
def _(spark, sf):
    """Fill-in of absent, null and empty members; present ones stay."""
    ev = table(spark, sf, "events")
    own = F.when(F.col("user_id") % 3 == 0, F.lit('"city":"Rome"')).when(F.col("user_id") % 3 == 1, F.lit('"city":null')).otherwise('"city":""')
    raw = F.concat(F.lit("{"), own, F.lit(',"k":'), text(F.get_json_object("props", "$.k").cast("bigint")), F.lit("}"))
    extra = F.create_map(F.lit("city"), F.lit("Lima"), F.lit("zone"), F.concat(F.lit("z"), text(F.col("user_id") % 5)), F.lit("none"), F.lit(""))
    staged = ev.select(text("event_id").alias("id"), object_members(raw).alias("m"), extra.alias("extra"))
    staged = staged.withColumn("needed", missing_entries(F.col("m"), F.col("extra")))
    return staged.select("id", filled(without_entries(F.col("m"), F.col("needed")), F.to_json("needed")).alias("props"))


@query("timestamps_by_magnitude", f"""
SELECT CAST(event_id AS VARCHAR) AS id, strftime(to_timestamp(CAST(epoch(ts) AS BIGINT))::TIMESTAMP, {TEXT_MICROS}) AS seen FROM
(SELECT event_id, date_trunc('second', ts) AS ts FROM events)""")
def _(spark, sf):
    """The same moment as seconds, milliseconds, microseconds or nanoseconds."""
    seconds = F.unix_seconds(F.col("ts").cast("timestamp")).cast("double")
    scale = F.element_at(F.array(F.lit(1.0), F.lit(1e3), F.lit(1e6), F.lit(1e9)), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf, "events").select(
        text("event_id").alias("id"), F.date_format(by_magnitude(seconds * scale), MICROS).alias("seen"))


@query("timestamps_rfc3339", f"""
SELECT CAST(event_id AS VARCHAR) AS id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE strftime(ts, {TEXT_MICROS}) END AS seen FROM events""")
def _(spark, sf):
    """Strict form: a missing zone is refused, an offset is applied."""
    ts, k = F.col("ts"), F.col("event_id") % 3
    shifted = F.date_format(ts + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+02:00'")
    form = (F.when(k == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).when(k == 1, shifted)
            .otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm:ss")))
    return table(spark, sf, "events").select(text("event_id").alias("id"), F.date_format(rfc3339(form), MICROS).alias("seen"))


@query("property_functions", """
SELECT id, CAST(properties->'n'->>'chars' AS DOUBLE) AS chars, properties->>'lang' AS lang, CAST(0 AS DOUBLE) AS text_as_number,
       '' AS number_as_text FROM doc_events""", "doc_events")
def _(spark, sf):
    p = F.col("properties")
    return doc_events(spark, sf).select("id", prop_number(p, "n.chars").alias("chars"), prop_text(p, "lang").alias("lang"),
                                        prop_number(p, "lang").alias("text_as_number"), prop_text(p, "n.chars").alias("number_as_text"))


@query("sql_helper_functions", f"""
SELECT strftime(date_trunc('hour', timestamp), {TEXT_TIME}) AS hour, count(*) AS n,
       CAST(sum(CAST(properties->>'k' AS BIGINT)) AS DOUBLE) AS k, count(*) FILTER (WHERE json_exists(properties, '$.k')) AS has_k
FROM log_events GROUP BY 1""", "log_events")
def _(spark, sf):
    """User SQL with the helper names of stored queries."""
    register(spark, {"helper_events": log_events(spark, sf).withColumn("timestamp", F.col("timestamp").cast("timestamp"))})
    return spark.sql("""
        SELECT formatDateTime(toStartOfHour(timestamp), '%Y-%m-%d %H:%i:%S') AS hour, count(*) AS n,
               sum(JSONExtractFloat(properties, 'k')) AS k, count_if(JSONHas(properties, 'k')) AS has_k
        FROM helper_events GROUP BY 1""")


@query("sql_time_helpers", f"""
SELECT event_id, CAST(strftime(ts, '%Y%m%d') AS INTEGER) AS day, strftime(date_trunc('minute', ts), {TEXT_MICROS}) AS minute, strftime(date_trunc('day', ts), {TEXT_MICROS}) AS midnight,
       strftime(date_trunc('second', ts), {TEXT_MICROS}) AS parsed, strftime(date_trunc('millisecond', ts), {TEXT_MICROS}) AS parsed64,
       strftime(date_trunc('second', ts) + INTERVAL 90 SECOND, {TEXT_MICROS}) AS later, CAST(user_id AS VARCHAR) AS user_text FROM events""")
def _(spark, sf):
    """The time and text helpers of stored queries; a text that is no time gives NULL."""
    written = F.date_format("ts", MICROS)
    rows = table(spark, sf, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), written.alias("whole"), F.left(written, F.lit(19)).alias("short"))
    register(spark, {"time_helper_events": rows})
    return spark.sql("""
        SELECT event_id, toYYYYMMDD(ts) AS day, date_format(toStartOfMinute(ts), '%s') AS minute, date_format(toStartOfDay(ts), '%s') AS midnight,
               date_format(toDateTime(short), '%s') AS parsed, date_format(toDateTime64(whole, 3), '%s') AS parsed64,
               date_format(toDateTime(short) + toIntervalSecond(90), '%s') AS later, toString(user_id) AS user_text
        FROM time_helper_events""" % ((MICROS,) * 5))


@query("formatted_sizes", """
SELECT name, CASE WHEN b < 1048576 THEN printf('%.2f KiB', b / 1024.0) WHEN b < 1073741824 THEN printf('%.2f MiB', b / 1048576.0)
       ELSE printf('%.2f GiB', b / 1073741824.0) END AS readable FROM (SELECT name, CAST(size_bytes AS DOUBLE) AS b FROM snapshots)""", "snapshots")
def _(spark, sf):
    return snapshots(spark, sf).select("name", t.readable_size(F.col("size_bytes")).alias("readable"))


# printf rounds exact ties (.25) to the even digit, the display form rounds them up
@query("formatted_numbers", """
SELECT o_orderkey AS id,
  CASE WHEN v >= 1000000 THEN printf('%.1fM', v / 1000000.0 + if(v % 1000000 = 250000, 0.01, 0))
       WHEN v >= 1000 THEN printf('%.1fK', v / 1000.0 + if(v % 1000 = 250, 0.01, 0))
       ELSE CAST(CAST(v AS BIGINT) AS VARCHAR) END AS short,
  CASE WHEN v < 1000 THEN printf('%.0fms', v)
       WHEN v < 60000 THEN printf('%.1fs', v / 1000.0 + if(v % 1000 = 250, 0.01, 0)) ELSE printf('%.1fm', v / 60000.0 + if(v % 60000 = 15000, 0.01, 0)) END AS duration
FROM (SELECT o_orderkey, CAST(o_custkey * (CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 4096 END) AS DOUBLE) AS v FROM orders)""")
def _(spark, sf):
    v = (F.col("o_custkey") * F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(4096)).cast("double")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), t.format_count(v).alias("short"), t.format_stat(v, "duration").alias("duration"))


@query("relative_ages", """
SELECT id, CASE WHEN m IS NULL THEN 'Never triggered' WHEN m < 1 THEN 'Just now' WHEN m < 60 THEN m || 'm ago'
  WHEN m < 1440 THEN (m // 60) || 'h ago' ELSE (m // 1440) || 'd ago' END AS age
FROM (SELECT p_partkey AS id, CASE WHEN p_partkey % 50 = 49 THEN NULL ELSE p_partkey END AS m FROM part)""")
def _(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(k.alias("id"), t.relative_age(F.when(k % 50 != 49, k)).alias("age"))


@query("service_slugs", """
SELECT id, regexp_replace(trim(CASE WHEN instr(n, ' - ') > 1 THEN split_part(n, ' - ', 1) WHEN instr(n, ' errors') > 1 THEN split_part(n, ' errors', 1)
  WHEN instr(n, ' alert') > 1 THEN split_part(n, ' alert', 1) WHEN instr(n, ' warning') > 1 THEN split_part(n, ' warning', 1) ELSE n END),
  '[^a-z0-9-]', '', 'g') AS slug FROM (SELECT id, lower(name) AS n FROM alerts)""", "alerts")
def _(spark, sf):
    return alerts(spark, sf).select("id", t.service_slug(F.col("name")).alias("slug"))


@query("escaped_pages", """
SELECT page_id, length(e) AS n, md5(e) AS digest FROM (SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'),
  '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS e FROM pages)""")
def _(spark, sf):
    safe = t.escape_html(F.col("html"))
    return table(spark, sf, "pages").select("page_id", F.length(safe).cast("bigint").alias("n"), F.md5(safe).alias("digest"))


@query("detected_urls", """
SELECT page_id, regexp_matches(url, '^https?://') AS is_url, regexp_matches(html, '^https?://') AS text_is_url FROM pages""")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", t.is_url(F.col("url")).alias("is_url"),
                                            t.is_url(F.col("html")).alias("text_is_url"))


@query("endpoint_parameters", "SELECT name, 'level,like' || substr(sql_query, instr(sql_query, '@like') + 5, 1) AS params FROM endpoints", "endpoints")
def _(spark, sf):
    return endpoints(spark, sf).select("name", F.array_join(t.parameter_names(F.col("sql_query")), ",").alias("params"))


@query("events_as_text", f"""
SELECT id, '[' || strftime(timestamp, {TEXT_TIME}) || '] ' || upper(level) || ' - ' || message || chr(10) || chr(10) ||
  'k: ' || (properties->>'k') || CASE WHEN level = 'Fatal' THEN chr(10) || chr(10) || 'Exception:' || chr(10) || 'boom' ELSE '' END AS body FROM log_events""", "log_events")
def _(spark, sf):
    ev = log_events(spark, sf)
    boom = F.when(F.col("level") == "Fatal", "boom").otherwise("")
    return ev.select("id", t.event_as_text(F.col("timestamp"), F.col("level"), F.col("message"), F.col("properties"), boom).alias("body"))


@query("numbers_in_text", """
SELECT conv_id, turn, CASE WHEN regexp_full_match(text, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)') THEN CAST(text AS DOUBLE) END AS n FROM conversations""")
def _(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", parse_float(F.col("text")).alias("n"))
