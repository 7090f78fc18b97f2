"""Column functions against plain Python."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logloom.functions.hashing import event_type, murmur3_32, with_murmur3
from logloom.functions.json_text import general_number
from logloom.functions.props import column_text, prop_exists, prop_nested, prop_number, prop_text
from logloom.functions.text import fixed, format_bytes, format_count, format_stat, readable_size, relative_age, service_slug
from logloom.functions.timeparse import by_magnitude, rfc3339
from logloom.operators.filters import PropertyFilter, is_numeric, parse_op, parse_property_params, prop_filter


def murmur(data: bytes) -> int:
    """Textbook form of the 32-bit hash, as the independent check."""
    mask, h, whole = 0xFFFFFFFF, 0, len(data) // 4 * 4

    def scramble(k):
        k = k * 0xCC9E2D51 & mask
        return ((k << 15 | k >> 17) & mask) * 0x1B873593 & mask

    for i in range(0, whole, 4):
        h ^= scramble(int.from_bytes(data[i:i + 4], "little"))
        h = ((h << 13 | h >> 19) & mask) * 5 + 0xE6546B64 & mask
    if data[whole:]:
        h ^= scramble(int.from_bytes(data[whole:], "little"))
    h ^= len(data)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> shift) * factor & mask
    return h ^ h >> 16


def test_hash_matches_textbook(spark):
    rng = random.Random(7)
    words = ["hello", "abcd", "a", "é", "日本語xx"] + ["".join(rng.choice("abcdeéß☃ {}\n") for _ in range(rng.randint(0, 90))) for _ in range(400)]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    rows = with_murmur3(df.withColumn("one", murmur3_32(F.col("w"))), F.col("w"), "chain").collect()
    assert all(r.one == r.chain == murmur(r.w.encode()) for r in rows)
    shown = df.select(event_type(F.col("w"), F.lit("")).alias("e")).head(2)
    assert [r.e for r in shown] == ["0x248bfa47", "0x43ed676a"]
    assert df.select(event_type(F.lit(""), F.lit(""))).first()[0] == ""


def test_general_number(spark):
    values = {5.0: "5", 0.5: "0.5", 1234567.5: "1.2345675e+06", 0.00015: "0.00015", 0.0000123: "1.23e-05", 1e21: "1e+21", -2500000.0: "-2.5e+06",
              999999.5: "999999.5", 0.0: "0", -0.00025: "-0.00025", 1e100: "1e+100"}
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert {r.v: r.g for r in df.select("v", general_number(F.col("v")).alias("g")).collect()} == values


def test_fixed_rounds_by_binary_value(spark):
    from decimal import ROUND_HALF_UP, Decimal

    values = [1.15, 1.25, 1.75, 2.675, 0.045, 1e9 + 0.05, 0.05, 123.449999] + [i / 1000 for i in range(0, 3000, 7)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (0, 1, 2):
        got = [r[0] for r in df.select(fixed(F.col("v"), digits)).collect()]
        assert got == [str(Decimal(v).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) for v in values]


def test_display(spark):
    row = spark.range(1).select(
        format_bytes(F.lit(0)).alias("a"), format_bytes(F.lit(1536)).alias("b"), readable_size(F.lit(1234567)).alias("c"), format_count(F.lit(1234)).alias("d"),
        format_stat(F.lit(1234.567)).alias("e"), format_stat(F.lit(12.34), "percent").alias("f"), relative_age(F.lit(None).cast("int")).alias("g"),
        relative_age(F.lit(1500)).alias("h"), service_slug(F.lit("MyApp - Database Failures")).alias("i"), service_slug(F.lit("AcmeCorp Errors")).alias("j")).first()
    assert list(row) == ["0 B", "1.5 KB", "1.18 MiB", "1.2K", "1,234.57", "12.3%", "Never triggered", "1d ago", "myapp", "acmecorp"]


PROPS = ["{}", '{"k":0}', '{"k":7}', '{"k":"7"}', '{"k":true}', '{"k":null}', '{"o":{"p":3}}', '{"o":"{\\"p\\":3}"}', "", "bad"]


def test_property_access(spark):
    p = F.col("properties")
    df = spark.createDataFrame([(x,) for x in PROPS], "properties string")
    rows = df.select(prop_number(p, "k"), prop_text(p, "k"), prop_number(p, "o.p"), prop_exists(p, "k"), column_text(prop_nested(p, "o.p"))).collect()
    assert [r[0] for r in rows] == [0, 0, 7, 0, 0, 0, 0, 0, 0, 0]
    assert [r[1] for r in rows] == ["", "", "", "7", "", "", "", "", "", ""]
    assert [r[2] for r in rows] == [0, 0, 0, 0, 0, 0, 3, 3, 0, 0]
    assert [r[3] for r in rows] == [False, True, True, True, True, True, False, False, False, False]
    assert [r[4] for r in rows] == [None] * 6 + ["3", "3", None, None]


def test_property_filters(spark):
    df = spark.createDataFrame([(x,) for x in PROPS], "properties string")

    def count(key, text):
        op, value = parse_op(text)
        return df.filter(prop_filter(PropertyFilter(key, value, op))).count()

    assert [count("k", "0"), count("k", "<5"), count("k", ">5"), count("k", "!=x"), count("o.p", "3"), count("o.p", ">=3")] == [9, 9, 1, 10, 2, 2]
    assert count("k", ">x") == 0  # text compares by equality only


@given(st.sampled_from([">=", "<=", "!=", ">", "<", ""]), st.text(alphabet="0123456789abc.-", min_size=1))
@settings(max_examples=60, deadline=None)
def test_parse_op(op, value):
    assert parse_op(op + value) == (op or "=", value)


def test_property_params():
    params = {"prop.a": ">=5", "prop.b!": "x", "prop.c": "", "level": "Error"}
    assert parse_property_params(params) == (PropertyFilter("a", "5", ">="), PropertyFilter("b", "x", "!="))
    assert [is_numeric(x) for x in ("5", " 5 ", "1e3", "", "x", "5x")] == [True, True, True, False, False, False]


def test_times(spark):
    df = spark.createDataFrame([(1706486400.25, "2026-01-25T10:30:00Z"), (1.706486400e12, "2026-01-25T10:30:00"), (1.7064864e15, "2026-01-25 10:30:00Z"),
                                (1.7064864e18, "2026-01-25T10:30:00.5+01:00")], "n double, t string")
    rows = df.select(by_magnitude(F.col("n")).cast("string"), rfc3339(F.col("t")).cast("string")).collect()
    assert [r[0] for r in rows] == ["2024-01-29 00:00:00.25"] + ["2024-01-29 00:00:00"] * 3
    assert [r[1] for r in rows] == ["2026-01-25 10:30:00", None, None, "2026-01-25 09:30:00.5"]
