"""Chat formatting (exact round trip, layout) and edit-aware counts (against a full encoding)."""

import hashlib
import random

import public_tokenizers as P
import pytest
import regex
from pyspark.sql import functions as F

from logloom.llm import chat, token_counts

TEXTS = ["</s>[INST] ok [/INST]", "a\\b\\\\<|turn|>", "<|end|>", "", None, "plain é\n", "<|<|body|>body|>", "[\\INST]", "<<SYS>>x<</SYS>>"]


@pytest.fixture(scope="module")
def talks(spark):
    rng = random.Random(3)
    rows = []
    for conv in range(40):
        start = TEXTS[: rng.randint(1, 3)]
        own = [rng.choice(TEXTS) for _ in range(rng.randint(0, 3))]
        for turn, text in enumerate(start + own):
            rows.append((conv, turn, ["user", "assistant", None, "assistant"][turn % 4], text, conv, "x"))
    rows += [(None, 0, "user", "no id", 1, "y"), (5, 9, "user", "same", 1, "y"), (5, 9, "user", "same", 1, "y"), (6, None, "assistant", "first", 1, "z")]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth int, digest string")


def turns_of(talks):
    out = {}
    for r in sorted(talks.collect(), key=lambda r: (r["turn"] is not None, r["turn"] or 0, r["role"] or "", r["text"] or "")):
        out.setdefault(r["conv_id"], []).append((r["role"] or "", r["text"] or ""))
    return out


def test_round_trip(talks):
    nodes, paths = chat.prefix_forest(talks, P.path("byte_bpe_50k.json"))
    back = chat.read_back(nodes, paths, P.path("byte_bpe_50k.json")).withColumn("turns", chat.parse(F.col("formatted"))).withColumn(
        "sha", chat.digest_turns(F.col("turns"))).collect()
    want = turns_of(talks)
    assert {r["conv_id"] for r in back} == set(want) and len(back) == len(want)
    for r in back:
        turns = want[r["conv_id"]]
        assert [tuple(t) for t in r["turns"]] == turns
        assert r["sha"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r["loss_text"] == "".join(b for a, b in turns if a == "assistant")


def test_layout(talks):
    nodes, paths = chat.prefix_forest(talks, P.path("byte_bpe_50k.json"))
    rows = {r["digest"]: r for r in nodes.collect()}
    prefixes = {tuple(t[:i + 1]) for t in turns_of(talks).values() for i in range(len(t))}
    assert len(rows) == len(prefixes)  # shared turns once
    at = 0
    for r in sorted(rows.values(), key=lambda r: r["start"]):  # gapless
        assert r["start"] == at and r["tokens"] == len(r["ids"])
        at += r["tokens"]
    for p in paths.collect():
        line = [rows[d] for d in p["path"]]
        for i, r in enumerate(line):
            assert [tuple(a) for a in r["ancestors"]] == [(x["start"], x["start"] + x["tokens"]) for x in line[:i]]
            assert r["position"] == sum(x["tokens"] for x in line[:i]) and r["depth"] == i
    order = sorted(rows.values(), key=lambda r: r["start"])
    for r in order:  # depth-first: what follows a node until a node as shallow is below it
        inside = [x for x in order if x["start"] > r["start"]]
        below = [len([a for a in x["ancestors"] if a["start"] == r["start"]]) == 1 for x in inside]
        assert below == sorted(below, reverse=True)


def test_empty_chat(talks):
    nodes, paths = chat.prefix_forest(talks.limit(0), P.path("byte_bpe_50k.json"))
    assert nodes.count() == 0 and paths.count() == 0


@pytest.fixture(scope="module")
def encoding():
    return token_counts.counter_of(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def test_edits_equal_full_encoding(encoding):
    cut = regex.compile(P.PATTERN)
    rng = random.Random(11)
    alphabet = ["a", "bc", " ", "  ", "\n", "'", "'re", "l", "9", "é", "́", "!?", "\t", "x" * 50, " " * 40]

    def count(piece):
        return len(encoding.encode_ordinary(piece))

    for _ in range(150):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 400)))
        pieces = cut.findall(text)
        tree = token_counts.TokenTree(text, [len(p) for p in pieces], [count(p) for p in pieces], cut, count)
        for _ in range(rng.randint(1, 12)):
            at, removed = rng.randint(0, len(text) + 2), rng.choice([0, 0, 1, 3, 30, 300])
            new = "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 2, 8])))
            tree.edit(at, removed, new)
            a = min(at, len(text))
            text = text[:a] + new + text[a + removed:]
            pieces = cut.findall(text)
            assert tree.text() == text and tree.n_chars == len(text)
            assert [n for b in tree.lengths for n in b] == [len(p) for p in pieces]
            assert tree.n_tokens == sum(map(count, pieces)) == len(encoding.encode_ordinary(text))


def test_only_the_touched_region_is_encoded(encoding):
    cut = regex.compile(P.PATTERN)
    text = "some words in a row, " * 5000
    pieces = cut.findall(text)
    tree = token_counts.TokenTree(text, [len(p) for p in pieces], [1] * len(pieces), cut, lambda p: 1)
    tree.edit(50_000, 3, "xyz")
    assert tree.reencoded < 10


def test_counts_of_documents(spark, encoding):
    rows = [(1, "Hello there, world", 3), (2, None, 4), (3, "", 5), (None, "x y", 6), (1, "Hello there, world", 3), (4, "ab " * 20000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lengths int")
    edits = spark.createDataFrame([(1, 1, 5, 1, "_"), (1, 2, 0, 0, "Oh "), (2, 1, 9, 9, "new"), (4, 1, 100, 0, None), (9, 1, 0, 0, "?")],
                                  "doc_id long, seq long, at long, removed long, inserted string")
    args = P.path("byte_bpe_50k.tiktoken"), P.PATTERN
    out = token_counts.apply_edits(token_counts.build_trees(token_counts.with_edits(docs, edits), *args), *args).collect()
    by = {r["doc_id"]: r for r in out}
    assert len(out) == 6 and by[1]["text"] == "Oh Hello_there, world" and by[2]["text"] == "new" and by[3]["n_tokens"] == 0
    for r in out:
        assert r["edited_tokens"] == len(encoding.encode_ordinary(r["text"])) and r["edited_chars"] == len(r["text"])
    assert token_counts.apply_edits(token_counts.build_trees(docs.limit(0), *args), *args).count() == 0
    assert {r["n_edits"] for r in token_counts.apply_edits(token_counts.build_trees(docs, *args), *args).collect()} == {0}
