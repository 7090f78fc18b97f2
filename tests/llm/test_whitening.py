"""Whitening against numpy."""

import math

import numpy as np
import pytest

from logloom.llm import whitening
from logloom.llm.queries import op12_whitening

SCHEMA = "vec_id long, embedding array<float>, Embedding int, n string"


def brute(vectors: dict, components: int = 4, scale: int = 256) -> dict:
    whole = {i: tuple(math.floor(scale * float(np.float32(c))) for c in v) for i, v in vectors.items()}
    fit = sorted(set(whole.values()))
    n, x = len(fit), np.array(fit, np.float64)
    sums = [sum(v[j] for v in fit) for j in range(len(fit[0]))]
    centred = x - np.array(sums) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    out = {}
    for i, v in whole.items():
        deviation = sum((n * a - s) ** 2 for a, s in zip(v, sums))
        for c in range(min(components, len(values))):
            out[i, c + 1] = (n, deviation, abs((np.array(v) - np.array(sums) / n) @ axes[:, c]) / math.sqrt(values[c]),
                             values[c] / values.sum())
    return out


def compare(rows, want):
    got = {(r["vec_id"], r["component"]): r for r in rows}
    assert len(got) == len(rows) and got.keys() == want.keys()
    for key, (n, deviation, white, explained) in want.items():
        r = got[key]
        assert (r["n"], r["deviation"]) == (n, deviation)
        assert abs(abs(r["whitened"]) - white) < 1e-7 and abs(r["explained"] - explained) < 1e-10
        assert r["identity_error"] < 1e-6


def test_against_numpy(spark):
    random = np.random.default_rng(3)
    vectors = {i: (random.normal(size=6) * [5, 3, 2, 1, .5, .1]).tolist() for i in range(200)}
    vectors |= {1000 + i: vectors[0] for i in range(120)}  # a third of all rows holds one vector
    odd = [(5000, None), (5001, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (5002, [float("nan")] * 6), (5003, [float("inf")] * 6), (5004, [1.0] * 3),
           (5005, [])]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in [*vectors.items(), *odd]], SCHEMA)
    rows = whitening.whiten(frame).collect()
    compare(rows, brute(vectors))
    signs = {}
    for r in rows:  # the same sign for all rows: equal vectors have equal values
        if r["vec_id"] == 0 or r["vec_id"] >= 1000:
            signs.setdefault(r["component"], set()).add(r["whitened"])
    assert all(len(s) == 1 for s in signs.values())
    assert whitening.whiten(frame.union(frame.limit(1))).count() == len(rows) + 4


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_BYTES", 8 * 5 * 7)
    monkeypatch.setattr(whitening, "BLOCKS_A_TASK", 2)
    monkeypatch.setattr(whitening, "COLUMNS_A_BLOCK", 2)
    random = np.random.default_rng(4)
    vectors = {i: random.normal(size=5).tolist() for i in range(150)}
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in vectors.items()], SCHEMA)
    compare(whitening.whiten(frame).collect(), brute(vectors))


def test_null_ids_and_no_variance(spark):
    frame = spark.createDataFrame([(None, [1.0, 2.0], 1, "x"), (None, [2.0, 1.0], 1, "x"), (3, [2.0, 1.0], 1, "x")], SCHEMA)
    rows = whitening.whiten(frame).collect()
    assert len(rows) == 3 and {r["component"] for r in rows} == {1} and {r["n"] for r in rows} == {2}  # one dimension varies
    same = spark.createDataFrame([(1, [1.0, 2.0], 1, "x"), (2, [1.0, 2.0], 1, "x")], SCHEMA)
    assert whitening.whiten(same).count() == 0
    assert whitening.whiten(same.limit(0)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [], 1, "x")], SCHEMA)).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query(spark, sf):
    path = f"/root/testdata/{sf}"
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()}
    compare(op12_whitening(spark, path).collect(), brute(vectors))
