"""Prefix trie of conversations, built from z-fast tries.

A conversation is a sequence of turns (role, text). The digest of a prefix identifies it, so that equal prefixes meet by
their digests. Every task inserts the conversations it meets, one Arrow batch after the other, into a z-fast trie of its
own: compacted nodes sit in a dictionary under the digest of their handle, the prefix at the two-fattest depth of their
edge, and a fat binary search over the depths finds where a conversation leaves the trie. A trie that has grown to ``HELD``
turns expands its edges into one row per depth and starts anew, so a task's memory is bounded. The rows of all tries then
add up by digest, and sums over subtrees come from rounds that double the distance to the ancestor.

Defined results: null role or text is empty text. Turns are ordered by ``turn``, null first; equal ones by the digest of role
and text. Repeated rows are turns of their own. Rows without a conversation id belong to none and are left out. Without any
conversation there is no node, not even the root. Very long texts and conversations are whole: a conversation is worked on
in segments of ``SEGMENT`` turns, and the chain of its segments' digests is the only thing that one task walks alone.
Extra columns with clashing names do no harm: only the named ones are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import pick, running_total, stored

#: Turns of a segment; turns a task's trie holds before it is written out; ids of one piece of a list of conversations.
SEGMENT, HELD, PIECE = 1024, 200_000, 4096
ROWS_OUT = 20_000
ROOT = bytes(16)

PARTS = "is_end boolean, id binary, parent binary, depth bigint, bytes bigint, n bigint, conv_id bigint"


def turn_digest(role: Column, text: Column) -> Column:
    """Sixteen bytes of SHA-256 over role and text, with the role's length in front."""
    told = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.substring(F.unhex(F.sha2(told.cast("binary"), 256)), 1, 16)


def ordered_turns(df: DataFrame) -> DataFrame:
    """conv_id, depth (from 1), digest and bytes of every turn; ranks come from a range partitioning, so no conversation
    is ever one task's alone."""
    rows = pick(df, "conv_id", "turn", "role", "text")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = rows.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint"), "turn", turn_digest(role, text).alias("digest"),
        F.octet_length(text).cast("bigint").alias("bytes"), F.monotonically_increasing_id().alias("tie"))
    order = [F.col("conv_id"), F.col("turn").isNotNull(), F.col("turn"), F.col("digest"), F.col("tie")]
    ranked = stored(running_total(rows, order, F.lit(1), "rank", "trie-order").drop("turn", "tie"), "trie-turns")
    firsts = ranked.groupBy("conv_id").agg(F.min("rank").alias("first"))
    return ranked.join(firsts, "conv_id").select("conv_id", (F.col("rank") - F.col("first") + 1).alias("depth"), "digest", "bytes")


def with_shared_openings(turns: DataFrame, group: int = 5, longest: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt to share openings: conversation c has the first h turns of conversation c - c % ``group``
    (h = crc32 of the decimal id, modulo ``longest``), then its own turns after its first h.

    Returns the turns and the table of conversations (conv_id, total turns); those left without turns are in the latter.
    """
    turns = stored(turns, "trie-original")
    hidden = F.crc32(F.col("conv_id").cast("string").cast("binary")) % longest
    convs = turns.groupBy("conv_id").agg(F.max("depth").alias("own"))
    convs = convs.withColumns({"h": hidden, "base": F.col("conv_id") - F.col("conv_id") % group})
    bases = convs.filter("conv_id = base").select("base", F.col("own").alias("base_own"))
    convs = convs.join(bases, "base", "left").withColumn("lent", F.least("h", F.coalesce("base_own", F.lit(0))))
    convs = stored(convs.withColumn("total", F.col("lent") + F.greatest(F.col("own") - F.col("h"), F.lit(0))), "trie-conversations")
    kept = (turns.filter(F.col("depth") > hidden).join(convs.select("conv_id", "h", "lent"), "conv_id")
            .select("conv_id", (F.col("lent") + F.col("depth") - F.col("h")).alias("depth"), "digest", "bytes"))
    lent = (turns.filter((F.col("conv_id") % group == 0) & (F.col("depth") < longest)).withColumnRenamed("conv_id", "base")
            .join(convs.select("conv_id", "base", "h"), "base").filter("depth <= h").select("conv_id", "depth", "digest", "bytes"))
    return kept.unionByName(lent), convs.select("conv_id", "total")


# --- digests of prefixes -----------------------------------------------------------------------------

def _digest(*parts: bytes) -> bytes:
    return hashlib.blake2b(b"".join(parts), digest_size=16).digest()


def _segment_end(start: bytes, whole: bytes) -> bytes:
    """Digest of the prefix that ends with a full segment."""
    return hashlib.blake2b(start + whole, digest_size=16, person=b"segment").digest()


def prefix_digests(start: bytes, turns: list[bytes], segment: int) -> list[bytes]:
    """Digests of the prefixes from the segment's start on (first) to its last turn."""
    ids = [start]
    for turn in turns:
        ids.append(_digest(ids[-1], turn))
    if len(turns) == segment:
        ids[-1] = _segment_end(start, _digest(*turns))
    return ids


def _whole_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of every full segment; rows come ordered by conv_id, segment and depth."""
    key, state = None, None
    out: list[tuple[int, int, bytes]] = []
    for batch in batches:
        for conv, segment, digest in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "segment", "digest"))):
            if (conv, segment) != key:
                if key:
                    out.append((*key, state.digest()))
                key, state = (conv, segment), hashlib.blake2b(digest_size=16)
            state.update(digest)
        if len(out) >= ROWS_OUT:
            yield _columns(out, [pa.int64(), pa.int64(), pa.binary()], ["conv_id", "segment", "whole"])
            out = []
    if key:
        out.append((*key, state.digest()))
    yield _columns(out, [pa.int64(), pa.int64(), pa.binary()], ["conv_id", "segment", "whole"])


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest each later segment starts from: a chain over a conversation's full segments, in order."""
    last, start = None, ROOT
    for batch in batches:
        out = []
        for conv, segment, whole in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "segment", "whole"))):
            start = _segment_end(ROOT if conv != last else start, whole)
            last = conv
            out.append((conv, segment + 1, start))
        yield _columns(out, [pa.int64(), pa.int64(), pa.binary()], ["conv_id", "segment", "start"])


def _columns(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)


# --- the trie of a task --------------------------------------------------------------------------------

def two_fattest(low: int, high: int) -> int:
    """The number in (low, high] that the highest power of two divides."""
    return high & -1 << (low ^ high).bit_length() - 1


class ZFastTrie:
    """Compacted trie over sequences of prefix digests. A node stands for the edge from depth ``low`` (its parent's end) to
    ``high``; ``path`` holds the digests from ``low`` to ``high``, ``sizes`` the bytes of the turns after ``low``."""

    def __init__(self):
        self.low, self.high, self.parent, self.base = [], [], [], []
        self.path, self.sizes, self.count, self.least = [], [], [], []
        self.handles: dict[bytes, int] = {}
        self.first: dict[bytes, int] = {}  # children by the first digest of their edge
        self.roots: dict[bytes, int] = {}
        self.held = 0

    def _node(self, low: int, parent: int, base: int, path: list[bytes], sizes: list[int]) -> int:
        node = len(self.low)
        self.low.append(low)
        self.high.append(low + len(path) - 1)
        self.parent.append(parent)
        self.base.append(base)
        self.path.append(path)
        self.sizes.append(sizes)
        self.count.append(0)
        self.least.append(None)
        self.held += len(path)
        if parent >= 0:
            self._hang(node)
        return node

    def _hang(self, node: int) -> None:
        low, path = self.low[node], self.path[node]
        self.first[path[1]] = node
        self.handles[path[two_fattest(low, self.high[node]) - low]] = node

    def _holds(self, node: int, ids: list[bytes]) -> bool:
        return self.high[node] < len(ids) and self.path[node][-1] == ids[self.high[node]]

    def exit(self, ids: list[bytes], root: int) -> int:
        """The deepest node whose whole edge lies on the sequence, by fat binary search."""
        found, low, high = root, 0, len(ids) - 1
        while low < high:
            middle = two_fattest(low, high)
            node = self.handles.get(ids[middle])
            if node is None:
                high = middle - 1
            elif self._holds(node, ids):
                found, low = node, self.high[node]
            else:
                return self.parent[node]
        return found

    def insert(self, ids: list[bytes], sizes: list[int], base: int, count: int, least: int) -> None:
        last = len(ids) - 1
        root = self.roots.get(ids[0])
        if root is None:
            root = self.roots[ids[0]] = self._node(0, -1, base, ids[:1], [])
        node = self.exit(ids, root)
        depth = self.high[node]
        if depth < last:
            child = self.first.get(ids[depth + 1])
            if child is not None:  # the sequence leaves inside this edge
                depth = self._common(child, ids)
                node = self._split(child, depth)
            if depth < last:
                node = self._node(depth, node, base, ids[depth:], sizes[depth:])
        self.count[node] += count
        self.least[node] = least if self.least[node] is None else min(self.least[node], least)

    def _common(self, child: int, ids: list[bytes]) -> int:
        """The last depth of an edge that lies on the sequence (its first one does)."""
        low, path = self.low[child], self.path[child]
        good, bad = low + 1, min(self.high[child], len(ids) - 1) + 1
        while bad - good > 1:
            middle = (good + bad) // 2
            good, bad = (middle, bad) if path[middle - low] == ids[middle] else (good, middle)
        return good

    def _split(self, child: int, depth: int) -> int:
        low, path, sizes = self.low[child], self.path[child], self.sizes[child]
        if depth == self.high[child]:
            return child
        del self.handles[path[two_fattest(low, self.high[child]) - low]]
        upper = self._node(low, self.parent[child], self.base[child], path[:depth - low + 1], sizes[:depth - low])
        self.low[child], self.parent[child] = depth, upper
        self.path[child], self.sizes[child] = path[depth - low:], sizes[depth - low:]
        self._hang(child)
        return upper

    def rows(self) -> Iterator[tuple]:
        """Edges expanded: one row per depth, with the sequences that pass it and the least of their conversations."""
        for node in sorted(range(len(self.low)), key=self.high.__getitem__, reverse=True):
            up = self.parent[node]
            if up >= 0:
                self.count[up] += self.count[node]
                self.least[up] = self.least[node] if self.least[up] is None else min(self.least[up], self.least[node])
                path, depth = self.path[node], self.base[node] + self.low[node]
                for i, size in enumerate(self.sizes[node], 1):
                    yield False, path[i], path[i - 1], depth + i, size, self.count[node], self.least[node]
            elif not self.base[node]:
                yield False, self.path[node][0], None, 0, 0, self.count[node], self.least[node]


def _segments(batch: pa.RecordBatch, open_: list) -> Iterator[tuple]:
    """((conv_id, segment), (start, digests, sizes, total)) of the segments that end in this batch; the last one, which may
    go on in the next batch, stays in ``open_``."""
    names = ("conv_id", "segment", "start", "digest", "bytes", "total")
    for conv, segment, start, digest, size, total in zip(*(batch.column(c).to_pylist() for c in names)):
        if not open_ or open_[0] != (conv, segment):
            if open_:
                yield tuple(open_)
            open_[:] = [(conv, segment), (start or ROOT, [], [], total)]
        if digest is not None:
            open_[1][1].append(digest)
            open_[1][2].append(size)


def inserter(segment_size: int, held: int):
    kinds = [pa.bool_(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    names = ["is_end", "id", "parent", "depth", "bytes", "n", "conv_id"]

    def cut(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        block = []
        for row in rows:
            block.append(row)
            if len(block) == ROWS_OUT:
                yield _columns(block, kinds, names)
                block = []
        yield _columns(block, kinds, names)

    def insert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, open_ = ZFastTrie(), []

        def put(segments) -> list[tuple]:
            together, ends = {}, []
            for (conv, number), (start, turns, sizes, total) in segments:
                ids = prefix_digests(start, turns, segment_size)
                base = number * segment_size
                if base + len(turns) == total:
                    ends.append((True, ids[-1], None, None, None, None, conv))
                same = together.setdefault((ids[0], ids[-1]), [ids, sizes, base, 0, conv])
                same[3] += 1
                same[4] = min(same[4], conv)
            for entry in together.values():
                trie.insert(*entry)
            return ends

        for batch in batches:
            yield from cut(iter(put(_segments(batch, open_))))
            if trie.held >= held:
                yield from cut(trie.rows())
                trie = ZFastTrie()
        if open_:
            yield from cut(iter(put([tuple(open_)])))
        yield from cut(trie.rows())
    return insert


# --- the whole trie --------------------------------------------------------------------------------------

def list_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the decimal conversation ids that end at a node, ascending and joined by commas.

    Ids are first joined in pieces of at most ``PIECE``; a node's pieces are then hashed one after the other as they stream by.
    """
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = ends.groupBy("id", F.floor(F.col("conv_id") / PIECE).alias("piece")).agg(ids.alias("ids"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        names, kinds = ["id", "ends_sha256"], [pa.binary(), pa.string()]
        for batch in batches:
            out = []
            for node, text in zip(batch.column("id").to_pylist(), batch.column("ids").to_pylist()):
                if node != last:
                    if last is not None:
                        out.append((last, state.hexdigest()))
                    last, state = node, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(text.encode())
            yield _columns(out, kinds, names)
        if last is not None:
            yield _columns([(last, state.hexdigest())], kinds, names)

    return (pieces.repartition("id").sortWithinPartitions("id", "piece").select("id", "ids")
            .mapInArrow(hashed, "id binary, ends_sha256 string"))


def subtree_sums(nodes: DataFrame, height: int, columns: list[str]) -> DataFrame:
    """``columns`` of (id, parent, ...) summed over each node and all below it, in as many rounds as ``height`` has binary
    digits: each doubles the distance to the ancestor a node hands its sum to."""
    state = nodes.select("id", F.col("parent").alias("up"), *columns)
    for turn in range(height.bit_length()):
        state = stored(state, f"trie-sums-{turn}")
        handed = state.filter("up IS NOT NULL").groupBy(F.col("up").alias("id")).agg(*[F.sum(c).alias(f"_{c}") for c in columns])
        above = state.filter("up IS NOT NULL").select(F.col("id").alias("up"), F.col("up").alias("above"))
        state = (state.join(handed, "id", "left").join(above, "up", "left")
                 .select("id", F.col("above").alias("up"), *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in columns]))
    return state.select("id", *columns)


def _started(rows: DataFrame, segment: int) -> DataFrame:
    """Rows with the digest their segment starts from (null: the root)."""
    full = rows.filter((F.col("depth") > 0) & ((F.col("segment") + 1) * segment <= F.col("total")) & (F.col("total") > segment))
    whole = (full.select("conv_id", "segment", "depth", "digest").repartition("conv_id", "segment")
             .sortWithinPartitions("conv_id", "segment", "depth").mapInArrow(_whole_segments, "conv_id bigint, segment bigint, whole binary"))
    starts = (whole.repartition("conv_id").sortWithinPartitions("conv_id", "segment")
              .mapInArrow(_starts, "conv_id bigint, segment bigint, start binary"))
    return rows.join(stored(starts, "trie-starts"), ["conv_id", "segment"], "left")


def build_trie(turns: DataFrame, conversations: DataFrame, segment: int = SEGMENT, held: int = HELD) -> DataFrame:
    """One row per node (distinct prefix, the textless root included) of ``turns`` (conv_id, depth from 1, digest, bytes):
    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``conversations`` (conv_id, total turns) also names those without turns.
    """
    roots = conversations.select("conv_id", F.lit(0).cast("bigint").alias("depth"), F.lit(None).cast("binary").alias("digest"),
                                 F.lit(0).cast("bigint").alias("bytes"), "total")
    rows = turns.join(conversations, "conv_id").select("conv_id", "depth", "digest", "bytes", "total").unionByName(roots)
    number = F.when(F.col("depth") > 0, F.floor((F.col("depth") - 1) / segment)).otherwise(0).cast("bigint")
    rows = stored(rows.withColumn("segment", number), "trie-rows")
    height = rows.agg(F.max("depth")).first()[0] or 0
    started = _started(rows, segment) if height > segment else rows.withColumn("start", F.lit(None).cast("binary"))
    parts = stored(started.repartition("conv_id", "segment").sortWithinPartitions("conv_id", "segment", "depth")
                   .mapInArrow(inserter(segment, held), PARTS), "trie-parts")
    merged = (parts.filter("NOT is_end").groupBy("id").agg(F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("bytes").alias("bytes"),
              F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id")))
    nodes = stored(merged, "trie-nodes")
    children = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("n_children"))
    counted = stored(nodes.join(children, "id", "left").withColumns({
        "n_children": F.coalesce("n_children", F.lit(0)),
        "n_leaves": F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("bigint"),
        "saved_tokens": (F.col("n_convs") - 1) * F.col("bytes")}), "trie-counted")
    sums = subtree_sums(counted, height, ["n_leaves", "saved_tokens"])
    parents = nodes.select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    ends = list_digests(parts.filter("is_end").select("id", "conv_id"))
    return (counted.drop("n_leaves", "saved_tokens").join(sums, "id").join(parents, "parent", "left").join(ends, "id", "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256")))
