"""OpenTelemetry log and trace export requests in their JSON form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.functions.base import apply_sql, let, let_sql, lower_hex_sql, nonempty, text_or_empty
from logloom.functions.json_text import general_sql, wire_form, wire_sql
from logloom.functions.timeparse import nanos_text
from logloom.schema import OTLP_LOGS, OTLP_TRACES

# --- fixed values -------------------------------------------------------------------------------
LEVEL_BY_TEXT = [("TRACE", "Debug"), ("DEBUG", "Debug"), ("INFO", "Information"),
                 ("WARN", "Warning"), ("ERROR", "Error"), ("FATAL", "Fatal")]
LEVEL_BY_NUMBER = [(4, "Verbose"), (8, "Debug"), (12, "Information"), (16, "Warning"), (20, "Error")]
SPAN_KINDS = ["UNSPECIFIED", "INTERNAL", "SERVER", "CLIENT", "PRODUCER", "CONSUMER"]
SPAN_TEMPLATE = "{Name} [{Kind}] {Status}"
SEVERITY_GROUPS = ["TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL"]
# ------------------------------------------------------------------------------------------------

def _hex_sql(text: str) -> str:
    """Bytes fields are Base64 in the JSON form (either alphabet, padding optional)."""
    std = f"rtrim('=', translate({text}, '-_', '+/'))"
    return lower_hex_sql(f"try_to_binary(concat({std}, repeat('=', pmod(-length({std}), 4))), 'base64')")


def _hex_bytes(text: Column) -> Column:
    return apply_sql(text, "t", _hex_sql("t"))


def _get(v: str, path: str, kind: str) -> str:
    return f"try_variant_get({v}, '$.{path}', '{kind}')"


# --- typed values to ordinary JSON, as one pass over the JSON text ---------------------------------
_STRING = r'"(?:[^"\\]++|\\.)*+"'
#: A bytes value with its name, a string that holds a bracket, or a run of all else.
_PIECE = rf'"bytesValue":{_STRING}|(?:[^"]++|(?!"bytesValue":")"(?:[^"\\{{}}\[\]]++|\\.)*+")++|{_STRING}'
#: The inside of a string; a run that begins and ends with strings has a quote between them.
_BRACKETED = r'(?:[^"\\]++|\\.)*+'
#: Rewriting steps in order. In the text, brackets inside strings are escaped, so all brackets are structure. The marks are
#: control characters, which JSON text never holds: 1 the end of a list (of values or of entries), 2 an empty object,
#: 3 and 4 the opening and closing bracket of an object.
_SCALARS = [
    (rf'\{{"(?:(?:stringValue|bytesValue)":({_STRING})|boolValue":(true|false)|intValue":"?(-?[0-9]++)"?'
     r'|doubleValue":"?(-?[0-9.]++[eE][-+]?[0-9]++)"?)\}', "$1$2$3$4"),
    (r'\{"doubleValue":"?(-?[0-9.]++)"?\}', "$1e0"),
    (r'\{(?:"[a-z]+Value":null)?\}', "null"),
    (r'\{"arrayValue":(?:null|\{"values":\[\]\})\}', "[]"),
    (r'\{"kvlistValue":(?:null|\{"values":\[\]\})\}', "\u0002"),
    (rf'\{{"key":({_STRING})\}}', '{"key":$1,"value":null}'),
]
#: Texts, replaced as they are.
_BRACKETS = [
    ('{"value":', '{"key":"","value":'),
    ('{"arrayValue":{"values":[', "["),
    ('{"kvlistValue":{"values":[', "\u0003"),
    # what is left of closing brackets: those of lists, three at a time, and those of entries
    ("]}}", "\u0001"),
    ("}\u0001", "\u0004"),
    ("\u0001", "]"),
]
_ENTRY = (rf'\{{"key":({_STRING}),"value":', "$1:")
_MARKS = [("},", ","), ("\u0002", "{}"), ("\u0003", "{"), ("\u0004", "}")]


def _listed_sql(v: str) -> str:
    """A typed list or key-value list of any depth as ordinary JSON; a value of another shape stays as it is."""
    escaped = "t"
    for char in "{}[]":
        escaped = f"replace({escaped}, '{char}', r'\\u{ord(char):04x}')"
    # a text that is not Base64 leaves nothing behind its name, which no step below makes JSON of
    base64 = "concat('\"bytesValue\":', coalesce(concat('\"', " + _hex_sql("substring(t, 15, length(t) - 15)") + ", '\"'), ''))"
    pieces = f"transform(all, t -> CASE WHEN t LIKE '\"bytesValue\":\"%' THEN {base64} WHEN t RLIKE r'^\"{_BRACKETED}\"$' THEN {escaped} ELSE t END)"
    text = let_sql(f"regexp_extract_all(to_json({v}), r'{_PIECE}', 0)", "all", f"array_join({pieces}, '')")
    for pattern, written in _SCALARS:
        text = f"regexp_replace({text}, r'{pattern}', '{written}')"
    for part, written in _BRACKETS:
        text = f"replace({text}, '{part}', '{written}')"
    text = f"regexp_replace({text}, r'{_ENTRY[0]}', '{_ENTRY[1]}')"
    for part, written in _MARKS:
        text = f"replace({text}, '{part}', '{written}')"
    return f"coalesce(try_parse_json({text}), {v})"


def _plain_sql(v: str) -> str:
    """A typed value as ordinary JSON (SQL text)."""
    kinds = [("stringValue", "string"), ("intValue", "bigint"), ("doubleValue", "double"), ("boolValue", "boolean")]
    scalars = ", ".join(f"cast({_get(v, path, kind)} AS variant)" for path, kind in kinds)
    listed = (f"CASE WHEN {_get(v, 'arrayValue', 'variant')} IS NOT NULL OR {_get(v, 'kvlistValue', 'variant')} IS NOT NULL "
              f"THEN {_listed_sql(v)} ELSE {v} END")
    return f"coalesce({scalars}, cast({_hex_sql(_get(v, 'bytesValue', 'string'))} AS variant), {listed})"


def plain_value(value: Column) -> Column:
    """A typed attribute value as ordinary JSON; lists and key-value lists at every depth."""
    return apply_sql(value, "v", _plain_sql("v"))


def plain_text(value: Column) -> Column:
    """A typed value as message text: scalars as they are, others as JSON, a missing value as ''."""
    number = let_sql(_get("v", "doubleValue", "double"), "n", general_sql("n"))
    json = let_sql(f"to_json(coalesce({_plain_sql('v')}, parse_json('null')))", "j", wire_sql("j", True))
    return apply_sql(value, "v", f"if(v IS NULL, '', coalesce({_get('v', 'stringValue', 'string')},"
                     f" string({_get('v', 'intValue', 'bigint')}), {number}, {_get('v', 'boolValue', 'string')},"
                     f" {_hex_sql(_get('v', 'bytesValue', 'string'))}, {json}))")


def properties_text(pairs: Column) -> Column:
    """Key-value structs as canonical JSON text, keys ascending; the last value of a repeated key wins (by the session's
    ``spark.sql.mapKeyDedupPolicy``, see ``RUNTIME_CONF``)."""
    whole = F.to_json(F.to_variant_object(F.map_from_entries(pairs)))
    return F.when(F.size(pairs) > 0, wire_form(whole, exact=True)).otherwise("{}")


def attribute_pairs(attributes: Column) -> Column:
    plain = F.transform(attributes, lambda a: F.struct(
        text_or_empty(a["key"]).alias("key"), F.coalesce(plain_value(a["value"]), F.parse_json(F.lit("null"))).alias("value")))
    return F.coalesce(plain, F.array().cast("array<struct<key:string,value:variant>>"))


def service_name(attributes: Column) -> Column:
    """Text of the first ``service.name`` resource attribute."""
    first = F.get(F.filter(attributes, lambda a: a["key"] == "service.name"), F.lit(0))
    return F.when(first.isNotNull(), nonempty(plain_text(first["value"])))


def severity_level(text: Column, number: Column) -> Column:
    upper = F.upper(text)
    out = F.when(upper.startswith(LEVEL_BY_TEXT[0][0]), LEVEL_BY_TEXT[0][1])
    for prefix, level in LEVEL_BY_TEXT[1:]:
        out = out.when(upper.startswith(prefix), level)
    out = out.when(F.coalesce(number, F.lit(0)) <= 0, "Information")
    for top, level in LEVEL_BY_NUMBER:
        out = out.when(number <= top, level)
    return out.otherwise("Fatal")


def _severity_number(text: Column) -> Column:
    """Severity as a number or as its enum name (``SEVERITY_NUMBER_WARN2``)."""
    name = F.regexp_extract(text, r"^SEVERITY_NUMBER_([A-Z]+)", 1)
    step = F.coalesce(nonempty(F.regexp_extract(text, r"(\d)$", 1)).cast("int"), F.lit(1))
    group = F.array_position(F.array(*[F.lit(g) for g in SEVERITY_GROUPS]), name)
    return F.coalesce(text.try_cast("int"), F.when(group > 0, ((group - 1) * 4).cast("int") + step))


def span_kind(text: Column) -> Column:
    number = text.try_cast("int")
    by_number = F.get(F.array(*[F.lit(k) for k in SPAN_KINDS]), number)
    by_name = F.regexp_extract(text, r"^SPAN_KIND_([A-Z]+)$", 1)
    known = F.when(by_name.isin(*SPAN_KINDS), by_name)
    return F.coalesce(by_number, known, F.lit(SPAN_KINDS[0]))


def _status(status: Column) -> Column:
    code = F.coalesce(status["code"], F.lit("0"))
    name = F.when(code.isin("2", "STATUS_CODE_ERROR"), "ERROR").when(code.isin("1", "STATUS_CODE_OK"), "OK").otherwise("UNSET")
    note = F.when(text_or_empty(status["message"]) != "", F.concat(F.lit(": "), status["message"])).otherwise("")
    return F.when(status.isNull(), "OK").otherwise(F.concat(name, note))


def _records(groups: Column, scopes: str, records: str) -> Column:
    """All records of a request, each with its resource's service name, which is found once per resource."""
    def of_resource(resource: Column) -> Column:
        return let(service_name(resource["resource"]["attributes"]), lambda name: F.flatten(F.transform(
            _scopes(resource[scopes]), lambda s: F.transform(F.coalesce(s[records], F.array()), lambda rec: F.struct(
                name.alias("service"), rec.alias("item"))))))
    return F.flatten(F.transform(groups, of_resource))


def _groups(parsed: Column, schema: T.StructType) -> Column:
    """The resources of a request that ``strict_json`` has parsed."""
    return F.try_variant_get(parsed, f"$[0].{schema[0].name}", schema[0].dataType.simpleString())


def flatten_logs(parsed: Column) -> Column:
    """All log records of a parsed request, each with its resource's service name."""
    return let(_groups(parsed, OTLP_LOGS), lambda groups: _records(groups, "scopeLogs", "logRecords"))


def flatten_spans(parsed: Column) -> Column:
    return let(_groups(parsed, OTLP_TRACES), lambda groups: _records(groups, "scopeSpans", "spans"))


def _scopes(scopes: Column) -> Column:
    return F.coalesce(scopes, F.array())


def log_fields(record: Column, source: Column) -> dict[str, Column]:
    item = record["item"]
    message = plain_text(item["body"])
    return {
        "timestamp": F.coalesce(nanos_text(item["timeUnixNano"]), nanos_text(item["observedTimeUnixNano"])),
        "level": severity_level(text_or_empty(item["severityText"]), _severity_number(item["severityNumber"])),
        "message_template": F.lit(""),
        "message": message,
        "exception": F.lit(""),
        "given_type": F.lit(""),
        "source": F.coalesce(record["service"], source),
        "properties": properties_text(attribute_pairs(item["attributes"])),
    }


def _pair(key: str, value: Column) -> Column:
    return F.struct(F.lit(key).alias("key"), value.cast("variant").alias("value"))


def span_fields(record: Column, source: Column) -> dict[str, Column]:
    item = record["item"]
    start, end = item["startTimeUnixNano"].try_cast("bigint"), item["endTimeUnixNano"].try_cast("bigint")
    parent = text_or_empty(_hex_bytes(item["parentSpanId"]))
    none = F.array().cast("array<struct<key:string,value:variant>>")
    pairs = F.concat(
        attribute_pairs(item["attributes"]),
        F.array(_pair("traceId", text_or_empty(_hex_bytes(item["traceId"]))),
                _pair("spanId", text_or_empty(_hex_bytes(item["spanId"])))),
        F.when(parent != "", F.array(_pair("parentSpanId", parent))).otherwise(none),
        F.when((start > 0) & (end > 0), F.array(F.struct(
            F.lit("durationMs").alias("key"), ((end - start).cast("double") / F.lit(1e6)).cast("variant").alias("value")))).otherwise(none))
    return {
        "timestamp": nanos_text(item["startTimeUnixNano"]),
        "level": F.when(item["status"]["code"].isin("2", "STATUS_CODE_ERROR"), "Error").otherwise("Information"),
        "message_template": F.lit(SPAN_TEMPLATE),
        "message": F.concat(text_or_empty(item["name"]), F.lit(" ["), span_kind(item["kind"]), F.lit("] "), _status(item["status"])),
        "exception": F.lit(""),
        "given_type": F.lit(""),
        "source": F.coalesce(record["service"], source),
        "properties": properties_text(pairs),
    }
