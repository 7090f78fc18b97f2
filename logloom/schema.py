"""Schemas and vocabularies of the log model."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values -------------------------------------------------------------------------------
LEVELS = ["Verbose", "Debug", "Information", "Warning", "Error", "Fatal"]
ERROR_LEVELS = ["Error", "Fatal"]
PROBLEM_LEVELS = ["Error", "Fatal", "Warning"]
FORMATS = ["clef", "webhook", "otlp-logs", "otlp-traces"]
TIMESTAMP_PATTERN = "yyyy-MM-dd HH:mm:ss"
# ------------------------------------------------------------------------------------------------

EVENT_COLUMNS = [
    "id", "timestamp", "level", "message_template", "message",
    "exception", "event_type", "source", "properties",
]
LIVE_COLUMNS = ["id", "timestamp", "level", "message", "source", "exception", "properties"]


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


EVENT = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    *_strings("level", "message_template", "message", "exception", "event_type", "source", "properties"),
])

PAYLOAD = T.StructType([
    *_strings("format", "source", "body", "contentType", "preset"),
    T.StructField("enrich", T.MapType(T.StringType(), T.StringType())),
])

ENVELOPE = T.StructType([T.StructField("message_id", T.StringType()), *PAYLOAD.fields])

RAW_MESSAGE = T.StructType(_strings("message_id", "raw"))

DEAD_LETTER = T.StructType(_strings("message_id", "format", "source", "reason", "raw"))

API_KEY = T.StructType([
    *_strings("api_key", "key_id", "name"),
    T.StructField("enabled", T.IntegerType()),
    *_strings("scopes"),
    T.StructField("retention_days", T.LongType()),
    *_strings("created_at"),
])

ALERT = T.StructType([
    *_strings("id", "name", "description", "query", "condition"),
    T.StructField("interval_seconds", T.LongType()),
    T.StructField("cooldown_seconds", T.LongType()),
    *_strings("recipients", "destination_ids", "subject"),
    T.StructField("enabled", T.IntegerType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("last_triggered_at", T.TimestampType()),
])

PROPERTY_FILTERS = T.ArrayType(T.StructType(_strings("key", "value", "operator")))

_WIDGET = T.StructType([
    *_strings("id", "type", "title"),
    T.StructField("dataSource", T.StructType([
        *_strings("type", "endpointName", "sql"),
        T.StructField("params", T.MapType(T.StringType(), T.StringType())),
        T.StructField("refreshInterval", T.DoubleType()),
    ])),
    T.StructField("visualization", T.StructType([
        *_strings("valueField", "format", "xField", "yField", "xAxisFormat", "seriesField", "sortBy"),
        T.StructField("columns", T.ArrayType(T.StringType())),
        T.StructField("colors", T.ArrayType(T.StringType())),
    ])),
])
DASHBOARD_CONFIG = T.StructType([
    T.StructField("layout", T.StringType()),
    T.StructField("widgets", T.ArrayType(_WIDGET)),
])

_ATTRIBUTE = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.VariantType())])
_ATTRIBUTES = T.ArrayType(_ATTRIBUTE)
_RESOURCE = T.StructType([T.StructField("attributes", _ATTRIBUTES)])

# 64-bit integers may be JSON strings or numbers, enums may be names or numbers: all are read as text.
LOG_RECORD = T.StructType([
    *_strings("timeUnixNano", "observedTimeUnixNano", "severityText", "severityNumber"),
    T.StructField("body", T.VariantType()),
    T.StructField("attributes", _ATTRIBUTES),
])
SPAN = T.StructType([
    *_strings("name", "kind", "traceId", "spanId", "parentSpanId", "startTimeUnixNano", "endTimeUnixNano"),
    T.StructField("status", T.StructType(_strings("code", "message"))),
    T.StructField("attributes", _ATTRIBUTES),
])

OTLP_LOGS = T.StructType([
    T.StructField("resourceLogs", T.ArrayType(T.StructType([
        T.StructField("resource", _RESOURCE),
        T.StructField("scopeLogs", T.ArrayType(T.StructType([
            T.StructField("logRecords", T.ArrayType(LOG_RECORD)),
        ]))),
    ]))),
])

OTLP_TRACES = T.StructType([
    T.StructField("resourceSpans", T.ArrayType(T.StructType([
        T.StructField("resource", _RESOURCE),
        T.StructField("scopeSpans", T.ArrayType(T.StructType([
            T.StructField("spans", T.ArrayType(SPAN)),
        ]))),
    ]))),
])
