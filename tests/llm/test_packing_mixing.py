"""Packing and mixing against brute force, with nulls, ties, clashing columns and empty tables."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from logloom.llm import mixing, packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    texts = ["", None, "Hello, WORLD! it's 42", "naïve café́ Σας x y", " \t\n", "word " * 3000, "</s> <|x|> \x1c\x85", "dup", "dup"]
    rows = [(i, t, "a" if i % 2 else None, 5, "x", i) for i, t in enumerate(texts)] + [(None, "no id", "b", 1, "y", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, sequence_id int, size string, Text long")


def test_packing_matches_the_tokenizer(docs):
    tokenizer = Tokenizer.from_file(PATH)
    rows = packing.pack_documents(docs, PATH, 64).collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    assert all(r["offset"] == 0 and r["length"] & (r["length"] - 1) == 0 and r["bucket"] == r["length"].bit_length() - 1 for r in rows)
    found = {}
    for r in sorted(rows, key=lambda r: r["start"]):
        found.setdefault(r["doc_id"], []).append(r)
    for row in docs.collect():
        want = tokenizer.encode(row[1] or "", add_special_tokens=False).ids + [1]
        pieces = found[row[0]]
        got = np.frombuffer(b"".join(p["ids"] for p in pieces), "<u4").tolist()
        assert got == want
        assert [p["length"] for p in pieces] == packing.cut(len(want), 64)
        assert all(p["doc_tokens"] == len(want) for p in pieces)
        assert [p["start"] for p in pieces] == np.cumsum([0, *(p["length"] for p in pieces)])[:-1].tolist()


def test_digest_of_ids(docs):
    piece = packing.pack_documents(docs, PATH).filter("doc_id = 2").select("ids", F.crc32("ids").alias("c")).first()
    assert piece["c"] == zlib.crc32(piece["ids"])


@given(st.lists(st.integers(1, 5000), max_size=20), st.sampled_from([1, 2, 64, 2048]))
@settings(max_examples=50, deadline=None)
def test_cuts(lengths, longest):
    docs_, sizes = packing.pieces_of(np.array(lengths, np.int64), longest)
    for i, n in enumerate(lengths):
        assert sizes[docs_ == i].tolist() == packing.cut(n, longest)


def test_buckets_and_errors(docs, tmp_path):
    packing.write_buckets(packing.pack_documents(docs, PATH, 64), str(tmp_path / "b"))
    assert docs.sparkSession.read.parquet(str(tmp_path / "b")).count() == packing.pack_documents(docs, PATH, 64).count()
    with pytest.raises(ValueError):
        packing.pack_documents(docs, PATH, 100)
    assert packing.pack_documents(docs.limit(0), PATH).count() == 0


def filled_by_hand(sizes, weights, most):
    """Targets by repeated resharing, one source at a time."""
    total, fixed = float(sum(sizes)), {}
    while True:
        free = [i for i in range(len(sizes)) if i not in fixed]
        left = total - sum(fixed.values())
        share = sum(weights[i] for i in free)
        targets = {i: left * weights[i] / share for i in free} if share else {}
        over = [i for i in free if targets[i] > most * sizes[i] * (1 + 1e-12)]
        if not over:
            return [fixed.get(i, targets.get(i)) for i in range(len(sizes))]
        fixed.update({i: most * sizes[i] for i in over})


@pytest.mark.parametrize("sizes", [[10, 1000, 1000, 5, 300, 7, 40], [1, 1, 100000], [5], [0, 0, 9]])
def test_targets(spark, sizes):
    rows = [(f"s{i:02d}", s, mixing.CYCLE[i % 3]) for i, s in enumerate(sizes)]
    frame = spark.createDataFrame(rows, "source string, source_size long, weight double")
    got = {r["source"]: r["target"] for r in mixing.with_targets(frame).collect()}
    want = filled_by_hand(sizes, [r[2] for r in rows], 3.0)
    assert [got[r[0]] for r in rows] == pytest.approx(want)
    assert sum(got.values()) == pytest.approx(sum(sizes))


def test_mix_plan(spark):
    rows = [(i, "w " * (1 + i % 7), ["b", "B", "é", None, "z"][i % 5] if i % 3 else "z", 1.0) for i in range(3000)]
    rows += [(None, None, "z", 2.0), (7, "w " * 8, "B", 2.0), (7, "w " * 8, "B", 2.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target double")
    plan = mixing.mix_plan(docs).collect()
    again = mixing.mix_plan(docs).collect()
    assert sorted(map(repr, plan)) == sorted(map(repr, again)) and len(plan) == len(rows)
    taken, target = {}, {}
    for r in plan:
        assert r["taken"] <= 3 * r["size"] and r["copies"] in (int(r["rate"]), int(r["rate"]) + 1)
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
    order = [*sorted((s for s in target if s is not None), key=lambda s: s.encode()), None]
    sizes = [next(r["source_size"] for r in plan if r["source"] == s) for s in order]
    assert [target[s] for s in order] == pytest.approx(filled_by_hand(sizes, [mixing.CYCLE[i % 3] for i in range(5)], 3.0))
    assert all(abs(taken[s] / target[s] - 1) < 0.15 for s in order)
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    count = {}
    for r in plan:
        count[r["doc_id"]] = count.get(r["doc_id"], 0) + r["copies"]
    got = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert got == {k: v for k, v in count.items() if v}


def test_mix_given_weights_and_empty(spark):
    docs = spark.createDataFrame([(i, "w", "ab"[i % 2]) for i in range(400)], "doc_id long, text string, source string")
    weights = spark.createDataFrame([("a", 3.0)], "source string, weight double")
    plan = {r["source"]: r["target"] for r in mixing.mix_plan(docs, weights=weights).collect()}
    assert plan == {"a": 400.0, "b": 0.0}
    assert mixing.mix_documents(docs, weights=weights).filter("source = 'b'").count() == 0
    assert mixing.mix_plan(docs.limit(0)).count() == 0 and mixing.mix_documents(docs.limit(0)).count() == 0


def test_mix_is_near_its_target_with_null_ids_and_equal_rows(spark):
    null_ids = [(None if i % 3 == 0 else i, "abc"[i % 7 % 3], f"w{i} " + "x " * (i % 40)) for i in range(9000)]
    one_row = [(5 if i % 3 == 0 else i, "abc"[i % 7 % 3], "same words here" if i % 3 == 0 else f"w{i} " + "x " * (i % 40)) for i in range(9000)]
    for rows in (null_ids, one_row):
        docs = spark.createDataFrame(rows, "doc_id int, source string, text string")
        plan = mixing.mix_plan(docs)
        per = plan.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("target"), F.count("*").alias("n")).collect()
        assert sum(r["n"] for r in per) == 9000
        assert all(abs(r["t"] / r["target"] - 1) < 0.05 for r in per), per
        assert plan.filter("taken > 3 * size").isEmpty()
        planned = plan.groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("n")).filter("n > 0")
        mixed = mixing.mix_documents(docs).select("doc_id", "source", mixing.word_count().alias("size"))
        assert sorted(map(repr, planned.collect())) == sorted(map(repr, mixed.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")).collect()))
        assert sorted(map(repr, plan.collect())) == sorted(map(repr, mixing.mix_plan(docs.repartition(5)).collect()))


def test_equal_rows_are_numbered_whole(spark):
    rows = spark.createDataFrame([("a",)] * 25 + [("b",)] * 10 + [(None,)] * 21 + [("c",)], "k string")
    got = sorted((r["k"] or "", r["nth"]) for r in mixing.numbered(rows, piece=10).collect())
    assert got == sorted((k, i) for k, n in (("a", 25), ("b", 10), ("", 21), ("c", 1)) for i in range(n))
    assert mixing.numbered(rows.limit(0)).isEmpty()
