"""Prefix tries against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from logloom.llm import prefix_trie as P
from logloom.llm.queries import op13_prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, Conv_id string"


def rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(c - 5 * int(c / 5))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, own in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(own) - 1) * len(node[-1][1].encode()) if node else 0
    return sorted((min(own), len(node), min(members[node[:-1]]) if node else -1, len(own), children[node], leaves[node], saved[node],
                   hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()) for node, own in members.items())


def shown(df):
    return sorted((r["conv_id"], r["depth"], -1 if r["parent_conv_id"] is None else r["parent_conv_id"], r["n_convs"], r["n_children"],
                   r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    for c in [*range(-7, 60), 10 ** 12]:
        for t in range(rng.randint(1, 14)):
            out.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "é", "", None, "long " * 50])))
    out += [(2, None, "user", "first"), (None, 1, "user", "nobody"), (None, None, None, None)]
    out += [(4000 + 5 * i, t, "user", "same") for i in range(40) for t in range(3)]  # a third of the conversations are equal
    out += [(5000, t, "user", f"{t % 3}") for t in range(60)]
    return out


def test_fat_numbers():
    for low in range(40):
        for high in range(low + 1, 41):
            best = max(range(low + 1, high + 1), key=lambda v: (v & -v if v else 0))
            assert P.two_fattest(low, high) == best


@given(st.lists(st.lists(st.sampled_from("ab"), max_size=9), min_size=1, max_size=40))
@settings(max_examples=300, deadline=None)
def test_trie_of_a_task(sequences):
    trie = P.ZFastTrie()
    for c, sequence in enumerate(sequences):
        ids = P.prefix_digests(P.ROOT, [x.encode() for x in sequence], 100)
        root = trie.roots.get(P.ROOT)
        if root is not None:  # the exit node is the deepest one that lies on the sequence
            deepest = max((n for n in range(len(trie.low)) if trie._holds(n, ids)), key=lambda n: trie.high[n])
            assert trie.exit(ids, root) == deepest
        trie.insert(ids, [1] * len(sequence), 0, 1, c)
    want = defaultdict(list)
    for c, sequence in enumerate(sequences):
        for i in P.prefix_digests(P.ROOT, [x.encode() for x in sequence], 100):
            want[i].append(c)
    got = {row[1]: row for row in trie.rows()}
    assert got.keys() == want.keys()
    for i, members in want.items():
        assert got[i][5:] == (len(members), min(members))


@pytest.mark.parametrize("segment,held", [(1024, 200_000), (3, 10)])
def test_against_brute_force(spark, rows, segment, held):
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    turns, convs = P.with_shared_openings(P.ordered_turns(frame))
    assert shown(P.build_trie(turns, convs, segment, held)) == brute(rebuilt(rows))


def test_long_hot_conversation_and_empty_table(spark):
    frame = spark.range(5000).selectExpr("if(id < 2000, 7, id) conv_id", "null turn", "'user' role", "cast(id % 2 as string) text")
    nodes = P.build_trie(*P.with_shared_openings(P.ordered_turns(frame)), segment=64)
    assert nodes.agg({"depth": "max"}).first()[0] > 1900
    assert nodes.filter("depth = 0").first()["n_convs"] == 3001
    assert P.build_trie(*P.with_shared_openings(P.ordered_turns(frame.limit(0)))).count() == 0


def test_query(spark):
    path = "/root/testdata/sf0.001"
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in spark.read.parquet(f"{path}/conversations.parquet").collect()]
    assert shown(op13_prefix_trie(spark, path)) == brute(rebuilt(rows))
