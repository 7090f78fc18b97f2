"""Edit-aware token counts.

A document keeps its pre-tokens (the pieces a byte-level tokenizer's pattern cuts, within which merges happen) as leaves of
a segment tree whose nodes hold character and token sums. An edit finds its place by descending the tree, re-cuts and
re-encodes only from the pre-token before the touched characters to the first cut after them that the old text had too,
and updates the sums on the way to the root. The pattern looks at most ``LOOK`` characters past a piece and never back, so
equal cuts stay equal from there on.

State is per document: one pass without a shuffle. Edits of a document are applied in order, each to the result of the one
before; a place beyond the text means its end. Null or empty text has no pre-tokens; null edits are no edits; a null
``inserted`` is empty. Rows repeat freely; a null id is kept. An empty table gives no rows.
"""

from __future__ import annotations

import base64
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import batches_of, binaries, filled, pick

LOOK = 3
BLOCK = 32
ROWS = 500
TREES = "doc_id bigint, text string, edits {edits}, lengths binary, counts binary"
EDITS = "array<struct<at:bigint,removed:bigint,inserted:string>>"
RESULT = ("doc_id bigint, n_chars bigint, n_pretokens bigint, n_tokens bigint, n_edits bigint, edited_chars bigint, "
          "edited_pretokens bigint, edited_tokens bigint, reencoded bigint, text string")


class TokenTree:
    """A segment tree over blocks of pre-tokens."""

    def __init__(self, text: str, lengths: list[int], counts: list[int], pattern: regex.Pattern, count: Callable[[str], int]):
        self.pattern, self.count, self.reencoded = pattern, count, 0
        self._build(text, lengths, counts)

    def _build(self, text: str, lengths: list[int], counts: list[int]) -> None:
        self.lengths = [lengths[i:i + BLOCK] for i in range(0, len(lengths), BLOCK)] or [[]]
        self.counts = [counts[i:i + BLOCK] for i in range(0, len(counts), BLOCK)] or [[]]
        self.texts, at = [], 0
        for block in self.lengths:
            size = sum(block)
            self.texts.append(text[at:at + size])
            at += size
        self.width = 1 << (len(self.lengths) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for i, (size, n) in enumerate(zip(self.lengths, self.counts)):
            self.chars[self.width + i], self.tokens[self.width + i] = sum(size), sum(n)
        for node in range(self.width - 1, 0, -1):
            self._sum(node)

    def _sum(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def _refresh(self, block: int) -> None:
        node = self.width + block
        self.chars[node], self.tokens[node] = sum(self.lengths[block]), sum(self.counts[block])
        while node > 1:
            node //= 2
            self._sum(node)

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join(self.texts)

    def _block_at(self, place: int) -> tuple[int, int]:
        """The block that holds character ``place`` (or ends the text), and where it starts."""
        node, before = 1, 0
        while node < self.width:
            node *= 2
            if place - before >= self.chars[node]:
                before += self.chars[node]
                node += 1
                if self.chars[node] == 0:  # beyond the text: stay left
                    node -= 1
                    before -= self.chars[node]
        return min(node - self.width, len(self.lengths) - 1), before

    def _read(self, start: int, stop: int) -> str:
        block, before = self._block_at(start)
        out = []
        while before < stop and block < len(self.texts):
            part = self.texts[block]
            out.append(part[max(0, start - before):stop - before])
            before += len(part)
            block += 1
        return "".join(out)

    def edit(self, at: int, removed: int, inserted: str) -> None:
        total = self.n_chars
        at = min(max(at, 0), total)
        removed = min(max(removed, 0), total - at)
        if not removed and not inserted:
            return
        first, left = self._block_at(max(0, at - LOOK))
        keep = 0  # pre-tokens of the first block that stay
        for size in self.lengths[first]:
            if left + size > at - LOOK:
                break
            left, keep = left + size, keep + 1
        shift = len(inserted) - removed
        context = 64
        while True:
            right = min(total, at + removed + context)
            buffer = self._read(left, at) + inserted + self._read(at + removed, right)
            pieces, place, met = [], 0, None
            touched = at - left + len(inserted)
            last, last_start = self._block_at(at + removed)
            cuts, block, start = {}, last, last_start
            while start <= right and block < len(self.lengths):  # old cuts from the end of the edit on
                p = start
                for k, size in enumerate(self.lengths[block]):
                    if p >= at + removed:
                        cuts[p] = (block, k)
                    p += size
                start, block = p, block + 1
            cuts[total] = (len(self.lengths) - 1, len(self.lengths[-1]))
            whole = right == total
            for match in self.pattern.finditer(buffer):
                if not whole and match.end() + LOOK > len(buffer):
                    break
                pieces.append(match[0])
                place = match.end()
                if place >= touched and left + place - shift in cuts:
                    met = cuts[left + place - shift]
                    break
            if met is None and whole and place == len(buffer):
                met = cuts[total]
            if met is None and touched == 0 and left - shift in cuts:
                met = cuts[left - shift]
            if met is not None:
                break
            context *= 4
        counts = [self.count(p) for p in pieces]
        self.reencoded += len(pieces)
        last, skip = met
        tail_chars = sum(self.lengths[last][:skip])
        head_text = self.texts[first][:sum(self.lengths[first][:keep])]
        tail_text = self.texts[last][tail_chars:]
        sizes = [len(p) for p in pieces]
        tail = (self.lengths[last][skip:], self.counts[last][skip:])
        self.lengths[first] = self.lengths[first][:keep] + sizes + tail[0]
        self.counts[first] = self.counts[first][:keep] + counts + tail[1]
        self.texts[first] = head_text + "".join(pieces) + tail_text
        for block in range(first + 1, last + 1):
            self.lengths[block], self.counts[block], self.texts[block] = [], [], ""
            self._refresh(block)
        self._refresh(first)
        if len(self.lengths[first]) > 8 * BLOCK:
            self._build(self.text(), [n for b in self.lengths for n in b], [n for b in self.counts for n in b])


def counter_of(ranks_path: str, pattern: str):
    """An encoder over a vocabulary of ranked byte strings."""
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def tree_maker(ranks_path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, cut = counter_of(ranks_path, pattern), regex.compile(pattern)
        known: dict[str, int] = {}
        for batch in batches_of(batches, ROWS):
            texts = filled(batch.column("text"))
            pieces = [cut.findall(t) for t in texts.to_pylist()]
            sizes = [len(p) for p in pieces]
            flat = [x for p in pieces for x in p]
            if len(known) > 300_000:
                known.clear()
            known.update((x, len(encoding.encode_ordinary(x))) for x in set(flat) if x not in known)
            lengths = np.fromiter(map(len, flat), np.int32, len(flat))
            counts = np.fromiter(map(known.__getitem__, flat), np.int32, len(flat))
            starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), batch.column("edits"), binaries(lengths, starts), binaries(counts, starts)],
                                             names=["doc_id", "text", "edits", "lengths", "counts"])
    return run


def editor(ranks_path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, cut = counter_of(ranks_path, pattern), regex.compile(pattern)

        def count(piece: str) -> int:
            return len(encoding.encode_ordinary(piece))

        for batch in batches_of(batches, ROWS):
            rows = []
            texts = filled(batch.column("text")).to_pylist()
            for doc, text, edits, lengths, counts in zip(*(batch.column(n).to_pylist() for n in ("doc_id",)), texts,
                                                         *(batch.column(n).to_pylist() for n in ("edits", "lengths", "counts"))):
                sizes, numbers = np.frombuffer(lengths, np.int32).tolist(), np.frombuffer(counts, np.int32).tolist()
                tree = TokenTree(text, sizes, numbers, cut, count)
                before = (tree.n_chars, len(sizes), tree.n_tokens, len(edits or []))
                for e in edits or []:
                    if e is not None:
                        tree.edit(e["at"] or 0, e["removed"] or 0, e["inserted"] or "")
                rows.append((doc, *before, tree.n_chars, sum(map(len, tree.lengths)), tree.n_tokens, tree.reencoded, tree.text()))
            names = [part.split()[0] for part in RESULT.split(", ")]
            types = [pa.string() if n == "text" else pa.int64() for n in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], names=names)
    return run


def build_trees(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """The leaves of every document's tree: (doc_id, text, edits, lengths, counts), 32-bit numbers per pre-token.

    ``docs`` may carry ``edits`` (array of at, removed, inserted; code points).
    """
    names = ("doc_id", "text", "edits") if "edits" in docs.columns else ("doc_id", "text")
    rows = pick(docs, *names)
    edits = F.col("edits").cast(EDITS) if "edits" in names else F.lit(None).cast(EDITS)
    rows = rows.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), edits.alias("edits"))
    return rows.mapInArrow(tree_maker(ranks_path, pattern), TREES.format(edits=EDITS))


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """Attach rows (doc_id, seq, at, removed, inserted) to their documents in order of seq."""
    rows = pick(edits, "doc_id", "seq", "at", "removed", "inserted")
    lists = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("seq", "at", "removed", "inserted"))).alias("e"))
    lists = lists.select("doc_id", F.transform("e", lambda x: F.struct(x["at"], x["removed"], x["inserted"])).alias("edits"))
    return pick(docs, "doc_id", "text").join(lists, "doc_id", "left")


def apply_edits(trees: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Counts of each document before and after its edits, pre-tokens re-encoded for them, and the edited text."""
    return trees.mapInArrow(editor(ranks_path, pattern), RESULT)


def hashed_edits(doc_id: Column, length: Column, edits: int = 4) -> Column:
    """A fixed series of edits per document: places, sizes and inserted texts by hashes of its id."""
    inserted = F.array(*map(F.lit, ("", " new", "'s", "  \n", "é", " 1,000", "re", "word ")))

    def one(k: int) -> Column:
        return F.struct(F.pmod(F.xxhash64(doc_id, F.lit(3 * k)), length + 1).alias("at"), F.pmod(F.xxhash64(doc_id, F.lit(3 * k + 1)), F.lit(12)).alias("removed"),
                        F.element_at(inserted, (F.pmod(F.xxhash64(doc_id, F.lit(3 * k + 2)), F.lit(8)) + 1).cast("int")).alias("inserted"))
    return F.array(*map(one, range(edits)))
