"""Payload parsing on hand-made messages."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from logloom.plans.ingest import dead_letters_of, events_of, parse_messages

NOW = "2026-02-01 00:00:00"
ADDED = {"rack": "r-17", "zone": "north", "canary": "no", "build": "2.4.1"}


def envelope(form, body, **extra):
    text = body if isinstance(body, str) else json.dumps(body)
    return json.dumps({"format": form, "source": "svc", "body": base64.b64encode(text.encode()).decode(), "contentType": "x", **extra})


@pytest.fixture
def parse(spark):
    def run(*raws, as_of=NOW):
        rows = [(str(i), raw) for i, raw in enumerate(raws)]
        return parse_messages(spark.createDataFrame(rows, "message_id string, raw string"), as_of)
    return run


def events(parsed):
    return [r.asDict() for r in events_of(parsed).orderBy("timestamp", "message").collect()]


def clef(*lines, **extra):
    return envelope("clef", "\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines), **extra)


def line(**fields):
    return {"@t": "2026-01-01T00:00:00Z", "@mt": "m", **fields}


def test_enrichment_fills_only_what_is_missing(parse):
    def at(second, **members):
        return {"@t": f"2026-03-04T05:06:{second:02d}Z", "@mt": "step", **members}

    rows = events(parse(
        clef(at(1), enrich=ADDED), clef(at(2, zone="south", canary=False), enrich=ADDED), clef(at(3, rack="", build=None, zone=0), enrich=ADDED),
        clef(at(4, lone=[1])), clef(at(5, a="b"), enrich={"zone": "", "rack": None})))
    assert [json.loads(r["properties"]) for r in rows] == [
        ADDED, {**ADDED, "zone": "south", "canary": False}, {**ADDED, "zone": 0}, {"lone": [1]}, {"a": "b"}]


def test_unreadable_lines_cost_only_themselves(parse):
    rows = events(parse(clef("{", {"@t": "2026-03-04T00:00:00Z", "@mt": "kept"}, "[]", "", {"@t": "soon", "@mt": "lost"}, "7")))
    assert [r["message_template"] for r in rows] == ["kept"]


def test_payload_without_a_usable_line(parse):
    parsed = parse(clef("[1]", {"@mt": "no time"}, "}{"), clef(" ", "\t", ""))
    assert events(parsed) == []
    assert [(r.message_id, r.reason) for r in dead_letters_of(parsed).collect()] == [("0", "all lines failed")]


def test_fields_and_template(parse):
    rows = events(parse(
        clef({"@t": "2026-01-25T10:30:00.123Z", "@l": "Information", "@mt": "Request {Method} {Path}", "Method": "GET", "Path": "/api/users"}),
        clef({"@t": "2026-01-25T10:31:00Z", "@mt": "hello", "@x": "Error: boom", "Ms": 5000}),
        clef({"@t": "2026-01-25T10:32:00Z", "@m": "given", "@mt": "t {a}", "@i": "abc", "@l": 5}),
        clef({"@t": "2099-01-01T00:00:00Z", "@mt": "{i} {f} {b} {n} {o} {x:000}", "i": 3.0, "f": 1234567.5, "b": True, "n": None, "o": {"z": [1]}, "x": 1})))
    assert rows[0]["message"] == "Request GET /api/users" and str(rows[0]["timestamp"]) == "2026-01-25 10:30:00.123000"
    assert rows[1]["event_type"] == "0x248bfa47" and rows[1]["exception"] == "Error: boom" and rows[1]["properties"] == '{"Ms":5000}'
    assert (rows[2]["message"], rows[2]["event_type"], rows[2]["level"]) == ("given", "abc", "Information")
    assert str(rows[3]["timestamp"]) == "2026-02-01 00:00:00"
    assert rows[3]["message"] == '3 1.2345675e+06 true null {"z":[1]} {x:000}'


def test_rejected_timestamps(parse):
    parsed = parse(clef(line(**{"@t": 5})), clef(line(**{"@t": "2026-01-25"})), clef(line(**{"@t": "2026-13-25T10:30:00Z"})), clef('{"@t":"2026-01-25T10:30:00Z"} tail'))
    assert dead_letters_of(parsed).filter(F.col("reason") == "all lines failed").count() == 4


def test_duplicate_member_last_wins(parse):
    rows = events(parse(clef('{"@t":"2026-01-01T00:00:00Z","@m":"m","a":1,"a":2}')))
    assert rows[0]["properties"] == '{"a":2}'


def test_a_long_line_costs_nothing(parse):
    parsed = parse(clef(line(), line(big="x" * 3_000_000), "{"), envelope("webhook", '{"a":"' + "\\n<" * 500_000 + '"}'))
    assert dead_letters_of(parsed).count() == 0
    assert sorted(len(r["properties"]) for r in events(parsed)) == [2, 3_000_010, 8 + 8 * 500_000]


@pytest.mark.parametrize("given,written,shown", [
    ("1.5e10", "15000000000", "15000000000"), ("1e21", "1e+21", "1e+21"), ("1e-7", "1e-7", "1e-07"), ("1e7", "10000000", "10000000"),
    ("123456789012345678901", "123456789012345680000", "1.2345678901234568e+20"), ("12345678901234567", "12345678901234568", "12345678901234568"),
    ("1.50", "1.5", "1.5"), ("0.000001", "0.000001", "1e-06"), ("0.00000012345", "1.2345e-7", "1.2345e-07"), ("2e23", "2e+23", "2e+23"),
    ("-12.5E+2", "-1250", "-1250"), ("0.30000000000000004", "0.30000000000000004", "0.30000000000000004"), ("100", "100", "100"),
    ("1234567.5", "1234567.5", "1.2345675e+06"), ("9007199254740993", "9007199254740992", "9007199254740992")])
def test_number_text(parse, given, written, shown):
    rows = events(parse(envelope("webhook", '{"n":[%s,"%s"]}' % (given, given)),
                        clef('{"@t":"2026-01-01T00:00:00Z","@mt":"{n} {o}","n":%s,"o":[%s]}' % (given, given), enrich={"rack": "<r>"})))
    texts = {r["message_template"]: r for r in rows}
    assert texts[""]["properties"] == texts[""]["message"] == '{"n":[%s,"%s"]}' % (written, given)
    assert texts["{n} {o}"]["message"] == f"{shown} [{written}]"
    assert texts["{n} {o}"]["properties"] == '{"n":%s,"o":[%s],"rack":"\\u003cr\\u003e"}' % (written, written)


def test_webhook_times(parse):
    seen = 1706486400
    body = "\n".join(json.dumps(x) for x in [
        {"timestamp": seen}, {"time": str(seen)}, {"ts": seen * 1000}, {"date": seen * 10**6}, {"datetime": seen * 10**9},
        {"created_at": "2024-01-29T00:00:00Z"}, {"@timestamp": "2024-01-29T02:00:00+02:00"}, {"timestamp": None, "time": seen}, {"x": 1}])
    times = [str(r["timestamp"]) for r in events(parse(envelope("webhook", body)))]
    assert times == ["2024-01-29 00:00:00"] * 7 + [NOW] * 2  # a present but unusable field does not fall through


def test_webhook_levels_and_preset(parse):
    body = {"EdgeStartTimestamp": 1706486400123456789, "EdgeResponseStatus": 404, "ClientRequestMethod": "GET", "ClientRequestHost": "h.com", "ClientRequestURI": "/p"}
    rows = events(parse(envelope("webhook", body, preset="CloudFlare"), envelope("webhook", {"level": "", "severity": "Error", "@l": "Debug", "ts": 1706486401}),
                        envelope("webhook", {"ts": 1706486402}, preset="unknown")))
    assert (rows[0]["level"], rows[0]["source"], rows[0]["message"]) == ("Warning", "h.com", "GET h.com/p → 404")
    assert rows[0]["properties"] == '{"ClientRequestMethod":"GET","ClientRequestURI":"/p"}'
    assert (rows[1]["level"], rows[1]["source"]) == ("Error", "svc") and rows[2]["message"] == '{"ts":1706486402}'


def test_otlp_values(parse):
    def attr(key, **value):
        return {"key": key, "value": value}

    deep = {"arrayValue": {"values": [{"kvlistValue": {"values": [attr("q", arrayValue={"values": [{"intValue": "9"}]})]}}]}}
    record = {"observedTimeUnixNano": "1706486400000000000", "severityNumber": "SEVERITY_NUMBER_WARN2", "body": {"doubleValue": 0.25},
              "attributes": [attr("s", stringValue="x"), attr("i", intValue=5), attr("d", doubleValue=2.0), attr("b", boolValue=False),
                             attr("y", bytesValue="AQI="), {"key": "deep", "value": deep}, {"key": "none"}, attr("s", stringValue="last"),
                             attr("e", arrayValue={}), attr("m", kvlistValue={})]}
    body = {"resourceLogs": [{"resource": {"attributes": [attr("service.name", stringValue="")]}, "scopeLogs": [{"logRecords": [record, {}]}, {}]}, {}]}
    rows = events(parse(envelope("otlp-logs", body)))
    assert (rows[0]["level"], rows[0]["message"], rows[0]["source"]) == ("Warning", "0.25", "svc")
    assert json.loads(rows[0]["properties"]) == {"s": "last", "i": 5, "d": 2, "b": False, "y": "0102", "deep": [{"q": [9]}], "none": None, "e": [], "m": {}}
    assert (rows[1]["level"], rows[1]["message"], rows[1]["event_type"], str(rows[1]["timestamp"])) == ("Information", "", "", NOW)


def test_otlp_values_of_any_depth(parse):
    def plain(value):
        kind, held = next(iter(value.items()), (None, None))
        if kind == "arrayValue":
            return [plain(v) for v in held.get("values", [])]
        if kind == "kvlistValue":
            return {e.get("key", ""): plain(e.get("value", {})) for e in held.get("values", [])}
        return {"AQI=": "0102"}.get(held, int(held) if kind == "intValue" else held)

    deep = {"stringValue": "]}}{\"key\":\u2028 &"}
    for level in range(12):
        deep = {"arrayValue": {"values": [deep, {}, {"kvlistValue": {"values": [
            {"key": "a}", "value": deep if level < 6 else {"boolValue": True}}, {"key": "gone"}, {"value": {"intValue": "9223372036854775807"}},
            {"key": "twice", "value": {"intValue": 1}}, {"key": "twice", "value": {"doubleValue": 2.5}}, {"key": "b", "value": {"bytesValue": "AQI="}},
            {"key": "bytesValue", "value": {"stringValue": "bytesValue"}}, {"key": "e", "value": {"kvlistValue": {}}}]}}, {"arrayValue": {}}]}}
    odd = {"arrayValue": {"values": [{"unheardOf": 1}]}}
    record = {"body": deep, "attributes": [{"key": "deep", "value": deep}, {"key": "odd", "value": odd}, {"key": "huge", "value": {"doubleValue": 1e22}}]}
    row, = events(parse(envelope("otlp-logs", {"resourceLogs": [{"scopeLogs": [{"logRecords": [record]}]}]})))
    assert json.loads(row["properties"]) == {"deep": plain(deep), "odd": odd, "huge": 1e22}
    assert json.loads(row["message"]) == plain(deep) and '"huge":1e+22' in row["properties"] and "\\u0026" in row["message"]


@pytest.mark.parametrize("number,level", [(0, "Information"), (1, "Verbose"), (4, "Verbose"), (5, "Debug"), (8, "Debug"), (9, "Information"),
                                          (12, "Information"), (13, "Warning"), (16, "Warning"), (17, "Error"), (20, "Error"), (21, "Fatal")])
def test_severity_numbers(spark, number, level):
    from logloom.operators.otlp import severity_level

    assert spark.range(1).select(severity_level(F.lit(""), F.lit(number))).first()[0] == level


def test_otlp_spans(parse):
    spans = [{"name": "a", "kind": 2, "traceId": "AQI=", "spanId": "Aw==", "parentSpanId": "BA==", "startTimeUnixNano": "1706486400000000000",
              "endTimeUnixNano": "1706486400001500000", "status": {"code": 2, "message": "boom"}},
             {"name": "b", "kind": "SPAN_KIND_CLIENT", "startTimeUnixNano": "1706486401000000000", "status": {}},
             {"name": "c", "startTimeUnixNano": "1706486402000000000"}]
    rows = events(parse(envelope("otlp-traces", {"resourceSpans": [{"scopeSpans": [{"spans": spans}]}]})))
    assert [r["message"] for r in rows] == ["a [SERVER] ERROR: boom", "b [CLIENT] UNSET", "c [UNSPECIFIED] OK"]
    assert [r["level"] for r in rows] == ["Error", "Information", "Information"]
    assert json.loads(rows[0]["properties"]) == {"traceId": "0102", "spanId": "03", "parentSpanId": "04", "durationMs": 1.5}


def test_envelope_faults(parse):
    parsed = parse("no json", '{"format":"clef","body":"%%"}', envelope("syslog", "x"), envelope("otlp-logs", "{bad"), json.dumps(clef(line())), "5")
    assert {r.message_id: r.reason for r in dead_letters_of(parsed).collect()} == {
        "0": "bad message", "1": "bad base64", "2": "unknown format: syslog", "3": "bad request json", "5": "bad message"}
    assert len(events(parsed)) == 1


def test_parsing_needs_no_shuffle_and_no_python(parse):
    plan = parse(clef(line()))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan.replace("PythonRDD", "") and plan.count("Generate ") == 2


def test_filter_is_not_copied_into_the_parser(parse):
    parsed = parse(clef(line())).filter(F.col("event_type") == "0x00000000").filter(F.col("reason").isNull())
    plan = parsed._jdf.queryExecution().optimizedPlan().toString()
    base = parse(clef(line()))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("try_parse_json") <= base.count("try_parse_json") and len(plan) < 1.2 * len(base)
