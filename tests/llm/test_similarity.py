"""SimHash components and ball-tree search against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

import corpus_pipeline
from logloom.llm import ball_tree, simhash, similar


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, radius=4):
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(prints))]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    words = ["alpha", "Beta", "gamma", "delta", "É", "ß", "x"]
    texts = [None, "", "  \n", "one", "ONE", "one two three", "one two three four"]
    for _ in range(60):
        base = [rng.choice(words) + str(rng.randint(0, 99)) for _ in range(rng.randint(1, 300))]
        for _ in range(rng.randint(1, 4)):
            base = list(base)
            base[rng.randrange(len(base))] = "changed"
            texts.append("\t".join(base) if rng.random() < 0.2 else " ".join(base))
    rows = [(1000 - i, t, i, "f") for i, t in enumerate(texts)] + [(None, "one", 0, "f"), (7, "one", 0, "f"), (7, "one", 0, "f"), (3, "w " * 50_000, 0, "f")]
    return spark.createDataFrame(rows, "doc_id long, text string, component_id long, fp string")


def test_components_match_brute_force(docs):
    rows = docs.select("doc_id", "text").collect()
    prints = [fingerprint(r["text"]) for r in rows]
    roots = components(prints)
    least = {}
    for r, root in zip(rows, roots):
        if r["doc_id"] is not None:
            least[root] = min(least.get(root, r["doc_id"]), r["doc_id"])
    want = sorted((repr(r["doc_id"]), f"{p:016x}", least.get(root)) for r, p, root in zip(rows, prints, roots))
    got = simhash.simhash_groups(docs).withColumn("h", simhash.hexadecimal()).collect()
    assert sorted((repr(r["doc_id"]), r["h"], r["component_id"]) for r in got) == want
    few = simhash.simhash_groups(docs, shard_points=8).withColumn("h", simhash.hexadecimal()).collect()  # every shard is split
    assert sorted((repr(r["doc_id"]), r["h"], r["component_id"]) for r in few) == want


def test_dedupe_keeps_one_of_each_component(docs):
    prints = [fingerprint(r["text"]) for r in docs.collect()]
    kept = simhash.dedupe(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(components(prints)))
    assert 7 not in [r["doc_id"] for r in kept.filter("text = 'ONE'").collect()]
    assert kept.filter("text in ('one', 'ONE')").count() == 1


def test_dedupe_tells_components_apart_without_ids(spark):
    texts = {n: " ".join(f"{n}{i * i % 97}" for i in range(40)) for n in "abcd"}
    rows = [(None, texts["a"]), (None, texts["a"]), (None, texts["b"]), (5, texts["c"]), (5, texts["d"]), (6, texts["d"])]
    kept = simhash.dedupe(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["text"] for r in kept) == sorted(texts.values())
    assert sorted(repr(r["doc_id"]) for r in kept) == ["5", "5", "None", "None"]


def test_empty(docs):
    assert simhash.simhash_groups(docs.limit(0)).count() == 0 and simhash.dedupe(docs.limit(0)).count() == 0


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_similar_texts_match_brute_force(spark):
    rng = random.Random(12)
    texts = ["", None, "one two", "ONE two", "one three"]
    for _ in range(25):
        base = [f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(60, 400))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(1, 4)):
            copy = list(base)
            for _ in range(max(1, len(base) * rng.choice([3, 10, 18, 22, 30, 40]) // 1000)):
                copy[rng.randrange(len(copy))] = f"x{rng.randint(0, 9999)}"
            texts.append(" ".join(copy))
    sets = [shingles(t) for t in texts]
    near = [(i, j) for i in range(len(sets)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8]
    prints = [fingerprint(t) for t in texts]
    assert sum(0.8 <= jaccard(sets[i], sets[j]) < 0.95 and (prints[i] ^ prints[j]).bit_count() > 4 for i, j in near) > 10
    parent = list(range(len(sets)))
    for i, j in near * 8:
        parent[i] = parent[j] = min(parent[i], parent[j])
    docs = spark.createDataFrame([(None if i == 4 else i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, row int")
    want = sorted(repr(None if i == 4 else i) for i in set(parent))
    for band_docs in (similar.BAND_DOCS, 2):  # with chunks of about two every band is split
        kept = similar.dedupe(docs, band_docs)
        assert kept.columns == docs.columns and sorted(repr(r["doc_id"]) for r in kept.collect()) == want
    staged = [shingles(r["text"]) for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, "").collect()]
    assert not any(jaccard(staged[i], staged[j]) >= 0.8 for i in range(len(staged)) for j in range(i))
    assert similar.dedupe(docs.limit(0)).count() == 0


def shuffled_columns(plan):
    """Names of the columns that exchanges of a plan send."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        return shuffled_columns(plan.initialPlan())
    own = {plan.output().apply(i).name() for i in range(plan.output().size())} if "Exchange" in plan.nodeName() else set()
    return own.union(*(shuffled_columns(plan.children().apply(i)) for i in range(plan.children().size())))


def test_kept_texts_are_not_shuffled(spark):
    """However large the tables are: without broadcasts only numbers go to the texts, in blocks of several tasks."""
    texts = [" ".join(f"w{n % 90}x{n * i % 1009}" for i in range(80)) for n in range(1, 181)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for kept in (simhash.dedupe(docs), similar.dedupe(docs), corpus_pipeline.drop_similar(spark, docs, "")):
            assert "_1" not in shuffled_columns(kept._jdf.queryExecution().executedPlan())
            assert sorted(r["text"] for r in kept.collect()) == sorted(set(texts))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def clustered(rng, n):
    centres = rng.integers(0, 2**63, max(1, n // 40), dtype=np.uint64)
    points = centres[rng.integers(0, len(centres), n)]
    for _ in range(3):
        points = points ^ (np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64))
    return np.unique(points)


def same_partition(a, b):
    return len(set(zip(a.tolist(), b.tolist()))) == len(set(a.tolist())) == len(set(b.tolist()))


@pytest.mark.parametrize("n", [1, 2, 70, 900, 3000])
def test_vantage_links(n):
    points = clustered(np.random.default_rng(n), n)
    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= 4
    label = np.arange(len(points))
    while True:
        new = np.where(near, label[None, :], len(points)).min(axis=1)
        if (new == label).all():
            break
        label = new
    parent = simhash.vantage_links(points, 4)
    assert same_partition(simhash.roots_of(parent, np.arange(len(points))), label)
    small = simhash.small_links(points, np.zeros(len(points), np.int64), 4) if n <= 900 else parent
    assert same_partition(simhash.roots_of(small, np.arange(len(points))), label)
    half = len(points) // 2
    if half:
        parent = simhash.vantage_links(points, 4, (np.arange(half), np.arange(half, len(points))))
        cross = near.copy()
        cross[:half, :half] = np.eye(half, dtype=bool)
        cross[half:, half:] = np.eye(len(points) - half, dtype=bool)
        label = np.arange(len(points))
        while True:
            new = np.where(cross, label[None, :], len(points)).min(axis=1)
            if (new == label).all():
                break
            label = new
        assert same_partition(simhash.roots_of(parent, np.arange(len(points))), label)


def test_runs_across_batches():
    points = clustered(np.random.default_rng(8), 700)
    shard = np.sort(np.random.default_rng(9).integers(0, 5, len(points)))
    batch = pa.RecordBatch.from_arrays([pa.array(shard), pa.array(np.zeros(len(points), np.int32)), pa.array(points.view(np.int64))], names=["shard", "side", "fp"])

    def edges(step):
        parts = [batch.slice(i, step) for i in range(0, len(points), step)]
        return sorted((u, v) for b in simhash.run_links(4)(iter(parts)) for u, v in zip(*(c.to_pylist() for c in b.columns)))
    whole = edges(10_000)
    assert whole and {u for u, _ in edges(7)} == {u for u, _ in whole}


def brute(ids, vectors, k=10, every=100):
    scaled = [[int(np.floor(1024 * float(x))) for x in v] for v in vectors]
    out = []
    for q in range(len(ids)):
        if ids[q] % every == 0:
            hits = sorted((-sum(a * b for a, b in zip(scaled[q], scaled[j])), ids[j]) for j in range(len(ids)) if j != q and len(vectors[j]) == len(vectors[q]))
            out += [(ids[q], r + 1, i, -s) for r, (s, i) in enumerate(hits[:k])]
    return sorted(out)


@pytest.mark.parametrize("rows_per_shard", [16, 150, 10_000])
def test_search_matches_brute_force(spark, rows_per_shard):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(6, 5)).astype(np.float32)
    vectors = [(base[i % 6] + (0 if i % 3 else rng.normal(0, 0.1, 5))).astype(np.float32).tolist() for i in range(400)]
    ids = [int(x) for x in rng.permutation(400)]
    ids[5] = ids[6] = 100  # repeated ids
    vectors += [[0.5], [0.25], [1e6, -1e6, 1e6, 3e5, 1.0], [0.0] * 5]
    ids += [200, 201, 300, -100]
    bad = [(900, None), (1000, [float("nan")] * 5), (1100, [float("inf")] * 5), (1200, [None, 1.0, 1.0, 1.0, 1.0]), (1300, []), (None, [1.0] * 5)]
    rows = [(i, v, 0, "s") for i, v in zip(ids, vectors)] + [(i, v, 0, "s") for i, v in bad]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int, shard string")
    got = sorted(map(tuple, ball_tree.top_k(frame, shard_rows=rows_per_shard, block=3).collect()))
    assert got == brute(ids, [np.float32(v).tolist() for v in vectors])


def test_search_empty(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ball_tree.top_k(frame).count() == 0
