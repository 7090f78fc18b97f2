"""Ingest: messages are built by Spark from the test tables, parsed, and compared with the original columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.operators.search import union_formats
from logloom.plans.ingest import dead_letters_of, events_of, parse_messages
from logloom.session import scratch
from logloom.sources.event_table import read_events, write_events
from logloom.sources.config_tables import endpoint_errors, newest_config
from logloom.sources.messages import read_messages, unwrap
from logloom.suite.base import AS_OF, MICROS, NOW, TEXT_MICROS, TEXT_TIME, endpoints, log_events, query, table, text

LINES_PER_MESSAGE = 50
ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def grouped_lines(rows: DataFrame, number: Column, line: Column, order: str) -> DataFrame:
    """(number, body): the lines of every message in order, at most ``LINES_PER_MESSAGE`` each."""
    lines = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line"))))
    return rows.groupBy(number.alias("number")).agg(lines.alias("l")).select(
        "number", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("body"))


def message(body: Column, form: str, source: Column | str = "svc", preset: str | None = None,
            enrich: Column | None = None) -> Column:
    fields = [F.lit(form).alias("format"), (F.lit(source) if isinstance(source, str) else source).alias("source"),
              F.base64(body.cast("binary")).alias("body"), F.lit("application/json").alias("contentType")]
    if preset:
        fields.append(F.lit(preset).alias("preset"))
    if enrich is not None:
        fields.append(enrich.alias("enrich"))
    return F.to_json(F.struct(*fields))


def clef_messages(spark, sf: str) -> DataFrame:
    """Structured log lines; every tenth message is encoded once more as a JSON text."""
    ev = log_events(spark, sf).withColumn("n", F.col("id").cast("bigint"))
    line = F.to_json(F.struct(
        F.date_format("timestamp", ISO).alias("@t"), F.col("level").alias("@l"), F.col("message_template").alias("@mt"),
        F.regexp_extract("message", "User (\\d+)", 1).cast("bigint").alias("user_id"),
        F.regexp_extract("message", "did (.*)$", 1).alias("event_type"), F.col("n").alias("no"),
        F.get_json_object("properties", "$.k").cast("bigint").alias("k")))
    grouped = grouped_lines(ev, F.floor(F.col("n") / LINES_PER_MESSAGE).cast("bigint"), line, "n")
    raw = message(F.col("body"), "clef", F.concat(F.lit("app-"), text(F.col("number") % 3)),
                  enrich=F.create_map(F.lit("geo_country"), F.lit("US"), F.lit("geo_city"), F.lit("")))
    double = F.to_json(F.array(F.col("raw")))
    return (grouped.select(text("number").alias("message_id"), raw.alias("raw"))
            .withColumn("raw", F.when(F.col("message_id").cast("bigint") % 10 == 0,
                                      F.substring(double, F.lit(2), F.length(double) - 2)).otherwise(F.col("raw"))))


UUID = "regexp_replace(md5({0}), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5')"
_N = "CAST(id AS BIGINT)"
_ID = UUID.format(f"concat(CAST({_N} // {LINES_PER_MESSAGE} AS VARCHAR), '#', CAST({_N} % {LINES_PER_MESSAGE} + 1 AS VARCHAR))")


@query("ingest_clef", f"""
SELECT {_ID} AS id, strftime(timestamp, {TEXT_MICROS}) AS timestamp, level, message_template, message, exception,
  concat('app-', ({_N} // {LINES_PER_MESSAGE}) % 3) AS source,
  '{{"event_type":"' || split_part(message, 'did ', 2) || '","geo_country":"US","k":' || (properties->>'k') || ',"no":' || id ||
  ',"user_id":' || regexp_extract(message, 'User ([0-9]+)', 1) || '}}' AS properties FROM log_events""", "log_events")
def _(spark, sf):
    """Envelope, Base64, lines, fields, rendered message, enrichment, canonical properties and stable ids."""
    events = events_of(parse_messages(clef_messages(spark, sf), AS_OF.isoformat(" ")))
    return events.withColumn("timestamp", F.date_format("timestamp", MICROS)).drop("event_type")


@query("ingest_clef_event_types", "SELECT '0x' AS prefix, CAST(10 AS BIGINT) AS width, CAST(1 AS BIGINT) AS kinds, count(*) AS n FROM events")
def _(spark, sf):
    """All lines share one template, hence one fingerprint."""
    events = events_of(parse_messages(clef_messages(spark, sf), AS_OF.isoformat(" ")))
    per = events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.left(F.min("event_type"), F.lit(2)).alias("prefix"), F.max(F.length("event_type")).cast("bigint").alias("width"),
                   F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("n"))


@query("ingest_clef_bad_lines", """
SELECT 'event' AS kind, '' AS reason, count(*) AS n FROM events WHERE event_id % 3 != 0 AND event_id // 5 % 7 != 0
UNION ALL SELECT 'dead', 'all lines failed', count(DISTINCT event_id // 5) FROM events WHERE event_id // 5 % 7 = 0""")
def _(spark, sf):
    """Broken lines are skipped, a message without any good line is rejected as a whole."""
    ev = table(spark, sf, "events")
    k = F.col("event_id")
    good = F.concat(F.lit('{"@t":"'), F.date_format("ts", ISO), F.lit('","@m":"m"}'))
    bad = F.when(k % 2 == 0, F.lit("not json")).otherwise('{"@m":"no time"}')
    line = F.when((F.floor(k / 5) % 7 == 0) | (k % 3 == 0), bad).otherwise(good)
    raw = grouped_lines(ev, F.floor(k / 5), line, "event_id").select(
        text("number").alias("message_id"), message(F.col("body"), "clef").alias("raw"))
    parsed = parse_messages(raw, AS_OF.isoformat(" "))
    return (parsed.groupBy(F.when(F.col("reason").isNull(), "event").otherwise("dead").alias("kind"),
                           F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count(F.lit(1)).alias("n")))


@query("ingest_future_clamp", """
SELECT strftime(least(ts, TIMESTAMP '2024-01-15 00:00:00'), '%Y-%m-%d %H:%M:%S.%f') AS timestamp, count(*) AS n FROM events GROUP BY 1""")
def _(spark, sf):
    """Times after the processing time are set to it."""
    parsed = parse_messages(clef_messages(spark, sf), "2024-01-15 00:00:00")
    return events_of(parsed).groupBy(F.date_format("timestamp", MICROS).alias("timestamp")).agg(F.count(F.lit(1)).alias("n"))


_WEBHOOK_LEVEL = """CASE event_id % 4 WHEN 0 THEN 'Warning' WHEN 1 THEN 'Fatal' ELSE 'Information' END"""


@query("ingest_webhook", f"""
SELECT event_id AS no, CASE WHEN event_id % 5 = 4 THEN strftime({NOW}, {TEXT_TIME}) ELSE strftime(date_trunc('second', ts), {TEXT_TIME}) END AS at,
  {_WEBHOOK_LEVEL} AS level, 'hook' AS source, '' AS message_template FROM events""")
def _(spark, sf):
    """Default preset: the time and level are found under any of their usual names and units."""
    ev = table(spark, sf, "events")
    k, sec = F.col("event_id"), F.unix_seconds(F.col("ts").cast("timestamp"))
    when = (F.when(k % 5 == 0, F.concat(F.lit('"timestamp":'), text(sec)))
            .when(k % 5 == 1, F.concat(F.lit('"time":"'), text(sec), F.lit('"')))
            .when(k % 5 == 2, F.concat(F.lit('"ts":'), text(sec), F.lit("000")))
            .when(k % 5 == 3, F.concat(F.lit('"created_at":"'), F.date_format(F.date_trunc("SECOND", "ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('"')))
            .otherwise('"date":"yesterday"'))
    level = F.when(k % 4 == 0, '"severity":"Warning"').when(k % 4 == 1, '"level":"","log_level":"Fatal"').otherwise('"x":1')
    line = F.concat(F.lit("{"), when, F.lit(","), level, F.lit(',"no":'), text(k), F.lit("}"))
    raw = grouped_lines(ev, F.floor(k / LINES_PER_MESSAGE), line, "event_id").select(
        text("number").alias("message_id"), message(F.col("body"), "webhook", "hook").alias("raw"))
    events = events_of(parse_messages(raw, AS_OF.isoformat(" ")))
    return events.select(F.get_json_object("properties", "$.no").cast("bigint").alias("no"),
                         F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("at"), "level", "source", "message_template")


@query("ingest_webhook_preset", f"""
SELECT strftime(o_orderdate, {TEXT_TIME}) AS at,
  CASE WHEN o_orderkey % 3 = 2 THEN 'Error' WHEN o_orderkey % 3 = 1 THEN 'Warning' ELSE 'Information' END AS level,
  concat('h', o_custkey, '.example.com') AS source,
  concat('GET h', o_custkey, '.example.com/o/', o_orderkey, ' → ', CASE o_orderkey % 3 WHEN 2 THEN 503 WHEN 1 THEN 404 ELSE 200 END) AS message,
  '{{"ClientRequestMethod":"GET","ClientRequestURI":"/o/' || o_orderkey || '"}}' AS properties FROM orders""")
def _(spark, sf):
    """Edge log preset: nanoseconds, level from the HTTP status, source from the host, mapped members dropped."""
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    line = F.to_json(F.struct(
        (F.unix_seconds(F.col("o_orderdate").cast("timestamp")) * F.lit(1000000000).cast("bigint")).alias("EdgeStartTimestamp"),
        F.when(k % 3 == 2, 503).when(k % 3 == 1, 404).otherwise(200).alias("EdgeResponseStatus"),
        F.lit("GET").alias("ClientRequestMethod"), F.concat(F.lit("h"), text("o_custkey"), F.lit(".example.com")).alias("ClientRequestHost"),
        F.concat(F.lit("/o/"), text(k)).alias("ClientRequestURI")))
    raw = grouped_lines(o, F.floor(k / LINES_PER_MESSAGE), line, "o_orderkey").select(
        text("number").alias("message_id"), message(F.col("body"), "webhook", "hook", preset="CloudFlare").alias("raw"))
    events = events_of(parse_messages(raw, AS_OF.isoformat(" ")))
    return events.select(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("at"), "level", "source", "message", "properties")


def otlp_log_messages(spark, sf: str) -> DataFrame:
    ev = table(spark, sf, "events").withColumn("k", F.col("event_id"))
    nanos = F.concat(text(F.unix_micros(F.col("ts").cast("timestamp"))), F.lit("000"))
    record = F.to_json(F.struct(
        F.when(F.col("k") % 4 != 3, nanos).alias("timeUnixNano"), nanos.alias("observedTimeUnixNano"),
        F.when(F.col("k") % 2 == 0, F.element_at(F.array(*[F.lit(x) for x in ("trace2", "Info", "WARNING", "error", "odd")]),
                                                (F.col("user_id") % 5 + 1).cast("int"))).alias("severityText"),
        (F.col("k") % 25).cast("int").alias("severityNumber"),
        F.struct(F.col("event_type").alias("stringValue")).alias("body"),
        F.from_json(F.concat(
            F.lit('[{"key":"user","value":{"intValue":"'), text("user_id"), F.lit('"}},{"key":"half","value":{"doubleValue":'),
            text(F.col("k") / 2), F.lit('}},{"key":"list","value":{"arrayValue":{"values":[{"boolValue":true},{"intValue":"'), text("k"),
            F.lit('"}]}}},{"key":"user","value":{"stringValue":"u'), text("user_id"), F.lit('"}}]')), "array<struct<key:string,value:variant>>").alias("attributes")))
    grouped = grouped_lines(ev, F.floor(F.col("k") / LINES_PER_MESSAGE), record, "event_id")
    service = F.when(F.col("number") % 2 == 0, F.concat(F.lit('{"attributes":[{"key":"service.name","value":{"stringValue":"shop'),
                                                        text("number"), F.lit('"}}]}'))).otherwise("{}")
    body = F.concat(F.lit('{"resourceLogs":[{"resource":'), service, F.lit(',"scopeLogs":[{"logRecords":['),
                    F.replace(F.col("body"), F.lit("\n"), F.lit(",")), F.lit("]}]}]}"))
    return grouped.select(text("number").alias("message_id"), message(body, "otlp-logs", "collector").alias("raw"))


_SEV_TEXT = "CASE user_id % 5 WHEN 0 THEN 'Debug' WHEN 1 THEN 'Information' WHEN 2 THEN 'Warning' WHEN 3 THEN 'Error' END"
_SEV_NUMBER = """CASE WHEN event_id % 25 = 0 THEN 'Information' WHEN event_id % 25 <= 4 THEN 'Verbose' WHEN event_id % 25 <= 8 THEN 'Debug'
  WHEN event_id % 25 <= 12 THEN 'Information' WHEN event_id % 25 <= 16 THEN 'Warning' WHEN event_id % 25 <= 20 THEN 'Error' ELSE 'Fatal' END"""


@query("ingest_otlp_logs", f"""
SELECT strftime(ts, {TEXT_MICROS}) AS at, coalesce(CASE WHEN event_id % 2 = 0 THEN {_SEV_TEXT} END, {_SEV_NUMBER}) AS level,
  event_type AS message, CASE WHEN (event_id // {LINES_PER_MESSAGE}) % 2 = 0 THEN concat('shop', event_id // {LINES_PER_MESSAGE}) ELSE 'collector' END AS source,
  '{{"half":' || CASE WHEN event_id % 2 = 0 THEN CAST(event_id // 2 AS VARCHAR) ELSE concat(event_id // 2, '.5') END ||
  ',"list":[true,' || event_id || '],"user":"u' || user_id || '"}}' AS properties FROM events""")
def _(spark, sf):
    """Resource, scope and record levels; severities by text and number; nested attribute values, last key wins."""
    events = events_of(parse_messages(otlp_log_messages(spark, sf), AS_OF.isoformat(" ")))
    return events.select(F.date_format("timestamp", MICROS).alias("at"), "level", "message", "source", "properties")


@query("ingest_otlp_traces", f"""
SELECT strftime(o_orderdate, {TEXT_TIME}) AS at, CASE WHEN o_orderkey % 4 = 2 THEN 'Error' ELSE 'Information' END AS level,
  concat('GET /o/', o_orderkey, ' [', CASE o_orderkey % 6 WHEN 1 THEN 'INTERNAL' WHEN 2 THEN 'SERVER' WHEN 3 THEN 'CLIENT' WHEN 4 THEN 'PRODUCER'
    WHEN 5 THEN 'CONSUMER' ELSE 'UNSPECIFIED' END, '] ', CASE o_orderkey % 4 WHEN 0 THEN 'UNSET' WHEN 1 THEN 'OK' WHEN 2 THEN 'ERROR: boom' ELSE 'OK' END) AS message,
  '{{"durationMs":' || (o_orderkey % 100 + 1) || ',' || CASE WHEN o_orderkey % 2 = 0 THEN '"parentSpanId":"' || lower(hex(encode(concat('p', o_custkey)))) || '",' ELSE '' END ||
  '"priority":"' || o_orderpriority || '","spanId":"' || lower(hex(encode(concat('s', o_orderkey)))) || '","traceId":"' || lower(hex(encode(concat('trace', o_custkey)))) || '"}}' AS properties
FROM orders""")
def _(spark, sf):
    """Spans as events: kind and status in the message, ids as hex, duration in milliseconds."""
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    start = F.unix_micros(F.col("o_orderdate").cast("timestamp"))

    def b64(c: Column) -> Column:
        return F.base64(c.cast("binary"))

    status = (F.when(k % 4 == 0, F.lit('"status":{},')).when(k % 4 == 1, F.lit('"status":{"code":1},'))
              .when(k % 4 == 2, F.lit('"status":{"code":"STATUS_CODE_ERROR","message":"boom"},')).otherwise(""))
    span = F.concat(
        F.lit('{"name":"GET /o/'), text(k), F.lit('","kind":'), text(k % 6), F.lit(","), status,
        F.lit('"traceId":"'), b64(F.concat(F.lit("trace"), text("o_custkey"))), F.lit('","spanId":"'), b64(F.concat(F.lit("s"), text(k))), F.lit('",'),
        F.when(k % 2 == 0, F.concat(F.lit('"parentSpanId":"'), b64(F.concat(F.lit("p"), text("o_custkey"))), F.lit('",'))).otherwise(""),
        F.lit('"startTimeUnixNano":"'), text(start), F.lit('000","endTimeUnixNano":"'), text(start + (k % 100 + 1) * 1000), F.lit('000",'),
        F.lit('"attributes":[{"key":"priority","value":{"stringValue":"'), F.col("o_orderpriority"), F.lit('"}}]}'))
    grouped = grouped_lines(o, F.floor(k / LINES_PER_MESSAGE), span, "o_orderkey")
    body = F.concat(F.lit('{"resourceSpans":[{"scopeSpans":[{"spans":['), F.replace(F.col("body"), F.lit("\n"), F.lit(",")), F.lit("]}]}]}"))
    raw = grouped.select(text("number").alias("message_id"), message(body, "otlp-traces", "collector").alias("raw"))
    events = events_of(parse_messages(raw, AS_OF.isoformat(" ")))
    return events.select(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("at"), "level", "message", "properties")


@query("ingest_documents", """
SELECT CAST(doc_id AS VARCHAR) AS doc, md5(text) AS digest, CAST(length(text) AS BIGINT) AS chars, lang FROM documents WHERE trim(text, chr(10)||' ') != ''""")
def _(spark, sf):
    """Whole documents, one per message, through Base64 and JSON and back."""
    d = table(spark, sf, "documents")
    line = F.to_json(F.struct(F.lit("2024-01-01T00:00:00Z").alias("@t"), F.col("text").alias("@m"), F.col("lang"), text("doc_id").alias("doc")))
    raw = d.filter(F.btrim("text", F.lit("\n ")) != "").select(text("doc_id").alias("message_id"), message(line, "clef", F.col("source")).alias("raw"))
    events = events_of(parse_messages(raw, AS_OF.isoformat(" ")))
    return events.select(F.get_json_object("properties", "$.doc").alias("doc"), F.md5("message").alias("digest"),
                         F.length("message").cast("bigint").alias("chars"), F.get_json_object("properties", "$.lang").alias("lang"))


def mixed_messages(spark, sf: str) -> DataFrame:
    """One message per order: the four formats, and every way to fail."""
    k = F.col("o_orderkey")
    clef = message(F.lit('{"@t":"2024-01-01T00:00:00Z","@m":"a"}\n\n{"@t":"2024-01-01T00:00:01Z","@m":"b"}'), "clef")
    hook = message(F.lit('{"a":1}\nbad\n[1]'), "webhook")
    logs = message(F.lit('{"resourceLogs":[{"scopeLogs":[{"logRecords":[{"body":{"stringValue":"x"}}]}]}]}'), "otlp-logs")
    spans = message(F.lit('{"resourceSpans":[{"scopeSpans":[{"spans":[{"name":"n"},{"name":"m"},{"name":"o"}]}]}]}'), "otlp-traces")
    raw = (F.when(k % 10 == 0, clef).when(k % 10 == 1, hook).when(k % 10 == 2, logs).when(k % 10 == 3, spans)
           .when(k % 10 == 4, F.lit("no json")).when(k % 10 == 5, F.lit('{"format":"clef","source":"s","body":"%%%"}'))
           .when(k % 10 == 6, message(F.lit("x"), "syslog")).when(k % 10 == 7, message(F.lit("bad\nworse"), "clef"))
           .when(k % 10 == 8, message(F.lit("\n\n"), "clef")).otherwise(message(F.lit("{bad"), "otlp-logs")))
    return table(spark, sf, "orders").select(text(k).alias("message_id"), raw.alias("raw"))


_FORMAT_EVENTS = """
SELECT o_orderkey % 10 AS c, count(*) AS n FROM orders GROUP BY 1"""


@query("ingest_routed_formats", f"""
SELECT CASE c WHEN 0 THEN 'clef' WHEN 1 THEN 'webhook' WHEN 2 THEN 'otlp-logs' ELSE 'otlp-traces' END AS format,
       CAST(n * CASE c WHEN 0 THEN 2 WHEN 3 THEN 3 ELSE 1 END AS BIGINT) AS events FROM ({_FORMAT_EVENTS}) WHERE c < 4""")
def _(spark, sf):
    parsed = parse_messages(mixed_messages(spark, sf), AS_OF.isoformat(" "))
    return parsed.filter(F.col("reason").isNull()).groupBy("format").agg(F.count(F.lit(1)).alias("events"))


@query("ingest_dead_letters", """
SELECT CAST(o_orderkey AS VARCHAR) AS message_id, CASE o_orderkey % 10 WHEN 4 THEN 'bad message' WHEN 5 THEN 'bad base64'
  WHEN 6 THEN 'unknown format: syslog' WHEN 7 THEN 'all lines failed' ELSE 'bad request json' END AS reason
FROM orders WHERE o_orderkey % 10 IN (4, 5, 6, 7, 9)""")
def _(spark, sf):
    return dead_letters_of(parse_messages(mixed_messages(spark, sf), AS_OF.isoformat(" "))).select("message_id", "reason")


@query("unwrapped_messages", """
SELECT CAST(o_orderkey AS VARCHAR) AS message_id, CASE o_orderkey % 10 WHEN 0 THEN 'clef' WHEN 1 THEN 'webhook' WHEN 2 THEN 'otlp-logs'
  WHEN 3 THEN 'otlp-traces' WHEN 4 THEN '' WHEN 6 THEN 'syslog' WHEN 9 THEN 'otlp-logs' ELSE 'clef' END AS format,
  CASE o_orderkey % 10 WHEN 4 THEN 'bad message' WHEN 5 THEN 'bad base64' ELSE '' END AS reason FROM orders""")
def _(spark, sf):
    return unwrap(mixed_messages(spark, sf)).select("message_id", "format", F.coalesce("reason", F.lit("")).alias("reason"))


@query("ingest_message_files", f"SELECT format, count(*) AS events FROM (SELECT 'clef' AS format FROM events) GROUP BY format")
def _(spark, sf):
    """Messages written as JSON files and read back through the file source."""
    path = scratch(spark, "messages")
    clef_messages(spark, sf).select(F.col("message_id").alias("id"), F.col("raw").alias("body")).write.json(path)
    parsed = parse_messages(read_messages(spark, path, stream=False), AS_OF.isoformat(" "))
    return parsed.filter(F.col("reason").isNull()).groupBy("format").agg(F.count(F.lit(1)).alias("events"))


@query("stored_events", f"""
SELECT id, strftime(date_trunc('millisecond', timestamp), {TEXT_MICROS}) AS timestamp, level, source, properties,
       strftime(timestamp, '%Y-%m-%d') AS day FROM log_events""", "log_events")
def _(spark, sf):
    """Write by day, read back: milliseconds, empty texts, derived day."""
    path = scratch(spark, "events")
    write_events(log_events(spark, sf), path)
    return read_events(spark, path).select("id", F.date_format("timestamp", MICROS).alias("timestamp"), "level", "source",
                                           "properties", F.date_format("dt", "yyyy-MM-dd").alias("day"))


@query("config_newest_first", f"""
SELECT name, strftime(created_at, {TEXT_TIME}) AS created_at, cache_ttl_seconds, enabled FROM endpoints""", "endpoints")
def _(spark, sf):
    return newest_config(endpoints(spark, sf)).select("name", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
                                                      "cache_ttl_seconds", "enabled")


@query("endpoint_checks", "SELECT name, CASE WHEN enabled = 0 THEN 'name: may hold only letters, digits, - and _' ELSE '' END AS errors FROM endpoints", "endpoints")
def _(spark, sf):
    e = endpoints(spark, sf)
    spoiled = e.withColumn("shown", F.col("name")).withColumn("name", F.when(F.col("enabled") == 0, F.concat("name", F.lit("?"))).otherwise(F.col("name")))
    return endpoint_errors(spoiled).select(F.col("shown").alias("name"), F.array_join("errors", "; ").alias("errors"))


@query("union_of_formats", f"""
SELECT source, count(*) AS n FROM (
  SELECT source FROM log_events UNION ALL SELECT source FROM doc_events) GROUP BY source""", ["log_events", "doc_events"])
def _(spark, sf):
    from logloom.suite.base import doc_events

    both = union_formats(log_events(spark, sf), doc_events(spark, sf))
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
