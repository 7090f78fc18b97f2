"""Language-model scoring with a probabilistic suffix tree, beside a word unigram baseline.

The tree's symbols are the UTF-8 bytes of a text's words (A-Z lower-cased), each word followed by a blank, and an end symbol
after the last; contexts are the up to ``depth`` bytes before a symbol, across words. A context is a candidate if it was seen
at least ``least_count`` times, so what the model keeps grows with the corpus. A candidate is retained if its next-symbol
distribution diverges from that of its longest retained suffix by at least ``least_gain`` nats over all its occurrences.
Distributions are smoothed towards the next shorter retained suffix with weight ``types`` (Witten-Bell), the root towards all
257 symbols. A symbol is scored by the longest retained suffix of what precedes it.

Three passes. The first turns each task's documents into chunks (a dictionary of distinct words, and codes), counts their
(depth + 1)-grams and training words, and stores them, bucketed by chunk, so that they are never shuffled. Grams are dealt into
parts by the two symbols before the last, so that all grams of a context of two or more symbols are in one part; words into parts
of their own by a hash of their bytes. A chunk's grams or words of a part are one compressed row, grams ordered by the last symbol
and then outwards: those with the same probability are mostly neighbours. The second pass adds up each part and stores its counts;
contexts of less than two symbols (at most 258 * 257 codes, whatever the corpus) are learned on the driver, all others part by
part. The third joins the chunks' rows with their part's counts, learns the part's subtrees and returns a probability per distinct
gram and a count per distinct word to the chunks, which are then scored: a symbol finds its gram by hash. A task holds the distinct
grams or words of one part and rows of chunks of about that size at a time.

Null or empty text is the end symbol alone. Rows repeat freely; ``held_out`` follows from the id (a null id is training
text). A null id is kept. Without training rows the unigram is uniform over the unseen and the tree is its smoothed root.
An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import bucketed, filled, looked_up, lowered, pick, split_words, stored

END = 256
SYMBOLS = 257
DEPTH = 5
LEAST_COUNT = 2
NEAR = 2  # symbols before the last by which grams are dealt into parts
PARTS = 8  # parts a shuffle partition
MOST_PARTS = 1024  # of grams and of words: a chunk has a row per part, so these should not grow with the corpus as chunks do
MERGE = 2_000_000  # grams gathered before they are added up
LEAST_GAIN = 20.0
CHUNK_WORDS = 1_000_000
ASKED = 50_000  # compressed bytes of a part answered at a time, at least
HASHED = 1_000_000  # bytes of words hashed at a time
BASE_SMOOTHING = 0.1
PIECE = 250_000  # words counted at a time
SCORED = 60_000  # words scored at a time: what is looked up should stay in the cache


# --- symbols -------------------------------------------------------------------------------------------

def spelled(dictionary: pa.Array) -> pa.Array:
    """The words, each with the blank after it."""
    nothing, blank = (pa.scalar(x, pa.large_binary()) for x in (b"", b" "))
    return pc.binary_join_element_wise(dictionary.cast(pa.large_binary()), nothing, blank)


def symbols(dictionary: pa.Array, codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all documents, each word followed by a blank, with an end symbol (256) per document, and their starts."""
    return symbols_of(with_end(spelled(dictionary)), codes, starts)


def with_end(words: pa.Array) -> pa.Array:
    """One more word of one byte, which keeps the place of an end."""
    return pa.concat_arrays([words, pa.array([b"."], pa.large_binary())])


def symbols_of(words: pa.Array, codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``symbols``, of ``spelled`` words ``with_end``."""
    last = starts[1:] + np.arange(len(starts) - 1)  # places of the ends among the words
    flat = words.take(pa.array(np.insert(codes, starts[1:], len(words) - 1)))
    at = np.concatenate([[0], np.cumsum(pc.binary_length(flat).to_numpy())])
    out = np.frombuffer(flat.buffers()[2] or b"", np.uint8, int(at[-1])).astype(np.uint16)
    out[at[last]] = END
    return out, np.concatenate([[0], at[last + 1]])


def grams(data: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """For each symbol: the ``depth`` symbols before it (9 bits each, nearest lowest; before the text 0), above its own 9 bits."""
    codes, have = data.astype(np.int64), 1
    while have <= depth:  # codes of twice as many symbols from two of the last
        step = min(have, depth + 1 - have)
        codes[step:] |= codes[:-step] << (9 * step)
        have += step
    for place in range(depth):  # what lies before a text is not its context
        near = starts[:-1][np.diff(starts) > place] + place
        codes[near] = suffix(codes[near], place + 1)
    return codes


# --- tree ----------------------------------------------------------------------------------------------

@dataclass
class Tree:
    """Per depth: sorted retained contexts, and sorted (context, symbol) codes with their log10 probability.

    ``escape[d]`` is the log10 weight a context of depth d leaves to the suffix ``shorter[d]`` (a depth).
    """
    depth: int
    contexts: list[np.ndarray] = field(default_factory=list)
    entries: list[np.ndarray] = field(default_factory=list)
    chances: list[np.ndarray] = field(default_factory=list)
    escape: list[np.ndarray] = field(default_factory=list)


def found_in(sorted_: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each value would be, and whether it is there."""
    if not len(sorted_):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)
    return at, sorted_[at] == values


def suffix(codes: np.ndarray, depth: int) -> np.ndarray:
    return codes & ((1 << (9 * depth)) - 1)


def learn(levels: dict[int, tuple[np.ndarray, np.ndarray]], depth: int, least_gain: float, low: Tree | None = None) -> Tree:
    """``levels[d]``: sorted (context of d symbols, next symbol) codes of the candidate contexts, and their counts.

    ``low`` is a tree of the first levels, which the new one goes on from.
    """
    tree = Tree(depth) if low is None else Tree(depth, *map(list, (low.contexts, low.entries, low.chances, low.escape)))
    for d in range(len(tree.contexts), depth + 1):
        codes, counts = levels.get(d, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
        first, types = runs(codes >> 9)
        contexts = codes[first] >> 9
        totals = run_totals(counts, first)
        if d == 0 and not len(contexts):
            contexts, types, totals = np.zeros(1, np.int64), np.ones(1, np.int64), np.zeros(1, np.int64)
        owner = np.repeat(np.arange(len(contexts)), types) if len(codes) else np.zeros(0, np.int64)
        lower = probability(tree, codes, d - 1) if d else np.full(len(codes), 1 / SYMBOLS)
        chance = (counts + types[owner] * lower) / (totals[owner] + types[owner])
        escape = types / (totals + types)
        if d:  # divergence from the longest retained suffix, over all occurrences
            gain = np.bincount(owner, counts * np.log(chance / lower), len(contexts))
            keep = gain >= least_gain
        else:
            keep = np.ones(len(contexts), bool)
        tree.contexts.append(contexts[keep])
        tree.entries.append(codes[keep[owner]] if len(codes) else codes)
        tree.chances.append(chance[keep[owner]] if len(codes) else chance)
        tree.escape.append(escape[keep])
    return tree


def probability(tree: Tree, codes: np.ndarray, depth: int) -> np.ndarray:
    """P(symbol | longest retained suffix of at most ``depth``) of (context, symbol) codes."""
    out = np.zeros(len(codes))
    left = np.arange(len(codes))
    weight = np.ones(len(codes))
    for d in range(min(depth, len(tree.contexts) - 1), -1, -1):
        code = suffix(codes[left], d + 1)
        at, state = found_in(tree.contexts[d], code >> 9)
        entry, there = found_in(tree.entries[d], code)
        hit = state & there
        out[left[hit]] = weight[left[hit]] * (tree.chances[d][entry[hit]] if len(tree.chances[d]) else 0.0)
        passed = state & ~there
        weight[left[passed]] *= tree.escape[d][at[passed]]
        left = left[~hit]
    out[left] = weight[left] / SYMBOLS
    return out


def level(keys: np.ndarray, counts: np.ndarray, depth: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Sorted (context, symbol) codes of the contexts of ``depth`` symbols that were seen at least ``least`` times, and counts."""
    codes, n = added(suffix(keys, depth + 1), counts)
    first, types = runs(codes >> 9)
    often = np.repeat(run_totals(n, first) >= least, types)
    return codes[often], n[often]


def runs(sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct value starts, and how often it is there."""
    first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(sorted_) else np.zeros(0, np.int64)
    return first, np.diff(first, append=len(sorted_))


def run_totals(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of values in runs that start at ``first``."""
    return np.add.reduceat(values, first) if len(first) else np.zeros(0, np.int64)


def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their sums."""
    order = np.argsort(keys)
    keys = keys[order]
    first, _ = runs(keys)
    return keys[first], run_totals(counts[order], first)


def counted(codes: np.ndarray, training: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct codes, and how often each is training."""
    marked = codes.view(np.uint64) << np.uint64(1)
    marked |= training.astype(bool)
    marked.sort()
    first, times = runs(marked)  # of a code at most two: not training, training
    marked = marked[first]
    keys = (marked >> np.uint64(1)).astype(np.int64)
    first, _ = runs(keys)
    return keys[first], run_totals(times * (marked & np.uint64(1)).astype(np.int64), first)


class Places:
    """Finds values in ``known`` (distinct) by hash: a binary search misses the cache at each of its steps."""

    def __init__(self, known: np.ndarray):
        self.known, self.bits = known, max(8, (2 * len(known)).bit_length())  # at most half of the slots are taken
        self.slots = np.full(1 << self.bits, -1, np.int32)
        left, slot = np.arange(len(known), dtype=np.int32), self.slot_of(known)
        while len(left):  # one value wins a free slot, the others go on to the next
            free = self.slots[slot] < 0
            self.slots[slot[free]] = left[free]
            lost = self.slots[slot] != left
            left, slot = left[lost], (slot[lost] + 1) & (len(self.slots) - 1)

    def slot_of(self, values: np.ndarray) -> np.ndarray:
        return (values.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).view(np.int64)

    def find(self, values: np.ndarray) -> np.ndarray:
        """The place of each value, -1 if it is not known."""
        if not len(self.known):
            return np.full(len(values), -1, np.int32)
        slot = self.slot_of(values)
        out = self.slots[slot]
        left = np.flatnonzero((self.known[out] != values) & (out >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & (len(self.slots) - 1)
            out[left] = self.slots[slot[left]]
            left = left[(self.known[out[left]] != values[left]) & (out[left] >= 0)]
        return out


def turned(codes: np.ndarray, depth: int) -> np.ndarray:
    """Codes with their symbols in reverse order: the last symbol highest, then the nearest before it. Its own inverse."""
    out = np.zeros(len(codes), np.int64)
    for back in range(depth + 1):
        out |= ((codes >> (9 * back)) & 511) << (9 * (depth - back))
    return out


def part_of(keys: np.ndarray, depth: int, parts: int) -> np.ndarray:
    near = (keys >> 9) & ((1 << (9 * min(NEAR, depth))) - 1)
    return ((near.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(parts)).astype(np.int32)


def word_part_of(words: pa.Array, parts: int) -> np.ndarray:
    """By a hash of the bytes of ``spelled`` words."""
    at = np.concatenate([[0], np.cumsum(pc.binary_length(words).to_numpy())])
    out, a = np.zeros(len(words), np.uint64), 0
    while a < len(words):  # words in pieces of bounded size
        b = max(int(np.searchsorted(at, at[a] + HASHED, "right")) - 1, a + 1)
        raw, first = raw_of(words.slice(a, b - a)), at[a:b] - at[a]
        length = np.diff(at[a:b + 1])
        powers = np.cumprod(np.full(int(length.max()), 0x100000001B3, np.uint64))
        out[a:b] = np.add.reduceat(powers[np.arange(len(raw)) - np.repeat(first, length)] * raw, first)
        a = b
    return ((out * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(parts)).astype(np.int32)


def piece_end(starts: np.ndarray, a: int, most: int) -> int:
    """Documents from ``a`` on with together at most ``most`` words: at least one."""
    b = int(np.searchsorted(starts, starts[a] + most, "right")) - 1
    return min(max(b, a + 1), len(starts) - 1, a + 50_000)


# --- first pass: chunks --------------------------------------------------------------------------------

CHUNK = ("chunk bigint, doc_ids binary, no_id binary, held binary, starts binary, codes binary, "
         "low array<bigint>, low_counts array<bigint>, part array<int>, keys array<binary>, counts array<binary>")


def one_list(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def planes(codes: np.ndarray) -> bytes:
    """32-bit codes with their low bytes first, then the next ones: such columns compress well."""
    return codes.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int32)


def squeezed(data: bytes) -> bytes:
    import zstandard

    return zstandard.compress(data)


def restored(data: bytes) -> bytes:
    import zstandard

    return zstandard.decompress(data)


def packed(numbers: np.ndarray) -> bytes:
    """64-bit numbers, all lowest bytes first, compressed."""
    return squeezed(numbers.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(restored(data), np.uint8).reshape(8, -1).T).view("<i8").reshape(-1)


def packed_rising(numbers: np.ndarray) -> bytes:
    """Sorted numbers as their differences."""
    return packed(np.diff(numbers, prepend=0))


def unpacked_rising(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data))


def raw_of(words: pa.Array) -> np.ndarray:
    """The bytes of large binaries."""
    if not len(words):
        return np.zeros(0, np.uint8)
    at = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, 8 * words.offset)
    return np.frombuffer(words.buffers()[2], np.uint8)[at[0]:at[-1]]


def from_raw(raw: np.ndarray) -> pa.Array:
    """``spelled`` words: a blank ends each."""
    at = np.concatenate([[0], np.flatnonzero(raw == 32) + 1])
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(raw)])


def packed_words(words: pa.Array) -> bytes:
    return squeezed(raw_of(words).tobytes())


def unpacked_words(data: bytes) -> pa.Array:
    return from_raw(np.frombuffer(restored(data), np.uint8))


def added_words(words: list[pa.Array], counts: list[np.ndarray]) -> tuple[pa.Array, np.ndarray]:
    """Distinct words and their sums."""
    coded = pa.concat_arrays(words).dictionary_encode()
    return coded.dictionary, np.bincount(coded.indices.to_numpy(), np.concatenate(counts), len(coded.dictionary)).astype(np.int64)


def by_part(part: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of parts, the parts there are, and where each starts in that order."""
    order = np.argsort(part.astype(np.min_scalar_type(parts)), kind="stable")
    first, _ = runs(part[order])
    return order, part[order][first], first


def chunker(depth: int, chunk_words: int, parts_: int):
    def chunk(name: int, parts: list[tuple]) -> pa.RecordBatch:
        ids, missing, held, texts = (pa.concat_arrays(x) for x in zip(*parts))
        flat, starts = split_words(lowered(filled(texts)))
        coded = flat.dictionary_encode()
        words = spelled(coded.dictionary)
        order, word_parts, word_first = by_part(word_part_of(words, parts_), parts_)
        words, rank = words.take(pa.array(order)), np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order))
        codes = rank[coded.indices.to_numpy()]  # words are numbered in order of parts
        out = held.to_numpy(zero_copy_only=False)
        training = np.repeat(~out, np.diff(starts))
        counts = np.bincount(codes[training], minlength=len(words))
        known, seen, a = with_end(words), [], 0
        while a < len(out):  # documents in pieces of bounded size
            b = piece_end(starts, a, PIECE)
            data, at = symbols_of(known, codes[starts[a]:starts[b]], starts[a:b + 1] - starts[a])
            # grams of held-out documents have count 0: they are scored, not learned from
            seen.append(counted(grams(data, at, depth), np.repeat(~out[a:b], np.diff(at))))
            a = b
        keys, number = added(np.concatenate([k for k, _ in seen]), np.concatenate([n for _, n in seen]))
        low, low_number = added(suffix(keys, max(1, min(NEAR, depth))), number)
        part, keys = part_of(keys, depth, parts_), turned(keys, depth)
        rising = np.argsort(keys)
        keys, number = keys[rising], number[rising]
        order, gram_parts, gram_first = by_part(part[rising], parts_)
        packs = [packed_rising(x) for x in np.split(keys[order], gram_first[1:])] + [
            packed_words(words.slice(a, b - a)) for a, b in zip(word_first, np.append(word_first[1:], len(words)))]
        packed_counts = [packed(x) for x in [*np.split(number[order], gram_first[1:]), *(np.split(counts, word_first[1:]) if len(words) else [])]]
        single = [ids.to_numpy().tobytes(), missing.to_numpy(zero_copy_only=False).tobytes(), out.tobytes(), starts.astype(np.int64).tobytes(),
                  squeezed(planes(codes))]
        return pa.RecordBatch.from_arrays(
            [pa.array([name], pa.int64()), *(pa.array([x], pa.binary()) for x in single), *(one_list(pa.array(x, pa.int64())) for x in (low, low_number)),
             one_list(pa.array(np.concatenate([gram_parts, word_parts + parts_]), pa.int32())), *(one_list(pa.array(x, pa.binary())) for x in (packs, packed_counts))],
            names=["chunk", "doc_ids", "no_id", "held", "starts", "codes", "low", "low_counts", "part", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n, parts, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            ids = batch.column("doc_id")
            rows = (pc.fill_null(ids, 0), pc.is_null(ids), batch.column("held_out"), batch.column("text").cast(pa.large_string()))
            lengths = pc.fill_null(pc.binary_length(rows[3]), 0).to_numpy() // 6 + 1
            group = (size + np.cumsum(lengths)) // chunk_words
            for g in np.unique(group).tolist():
                where = np.flatnonzero(group == g)
                a, b = int(where[0]), int(where[-1]) + 1
                if parts and g > 0 and g != group[0]:
                    yield chunk((part << 32) + n, parts)
                    n, parts = n + 1, []
                parts.append(tuple(x.slice(a, b - a) for x in rows))
            size = int((size + lengths.sum()) % chunk_words) if len(lengths) else size
            if len(group) and group[-1] > 0 and group[0] == group[-1]:
                yield chunk((part << 32) + n, parts)
                n, parts = n + 1, []
        if parts:
            yield chunk((part << 32) + n, parts)
    return run


# --- second and third pass: parts ----------------------------------------------------------------------

SUMS = "part int, keys binary, counts binary, total bigint, distinct_keys bigint"


def run_sums(parts: int):
    """Of rows (part, keys, counts) in order of parts: one row per part with its training grams or words and their sums."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size = None, [], 0

        def merged() -> tuple:
            keys, n = zip(*held)
            return added(np.concatenate(keys), np.concatenate(n)) if now < parts else added_words(keys, n)

        def row() -> pa.RecordBatch:
            keys, n = merged()
            return pa.RecordBatch.from_arrays(
                [pa.array([now], pa.int32()), *(pa.array([x], pa.binary()) for x in (packed_rising(keys) if now < parts else packed_words(keys), packed(n))),
                 pa.array([n.sum()], pa.int64()), pa.array([len(n)], pa.int64())], names=["part", "keys", "counts", "total", "distinct_keys"])

        for batch in batches:
            for part, keys, n in zip(*(batch.column(c) for c in ("part", "keys", "counts"))):
                if part.as_py() != now:
                    if held:
                        yield row()
                    now, held, size = part.as_py(), [], 0
                n = unpacked(n.as_py())
                keys = unpacked_rising(keys.as_py())[n > 0] if now < parts else unpacked_words(keys.as_py()).filter(pa.array(n > 0))
                held.append((keys, n[n > 0]))
                size += len(keys)
                if size > MERGE + 2 * len(held[0][0]):
                    held, size = [merged()], 0
        if held:
            yield row()
    return run


def run_found(parts: int, low: Tree, depth: int, least: float, least_gain: float):
    """Of rows (part, chunk, keys, counts) in order, a part's sums (no chunk) first: log10 probabilities of each chunk's grams, sums of its words."""
    none = np.zeros(0, np.int64)

    def ends_of(lists: list) -> np.ndarray:
        return np.cumsum([len(x) for x in lists])[:-1]

    def grams_of(keys: np.ndarray, n: np.ndarray):
        tree = learn({d: level(turned(keys, depth), n, d, least) for d in range(len(low.contexts), depth + 1)}, depth, least_gain, low)

        def chances(codes: np.ndarray) -> np.ndarray:
            return np.log10(probability(tree, turned(codes, depth), depth))
        known = chances(keys)  # training grams get their chance once, not in each chunk

        def answer(asked: list[bytes]) -> list[bytes]:
            lists = [unpacked_rising(x) for x in asked]
            codes = np.concatenate(lists)
            at, there = found_in(keys, codes)
            found = np.empty(len(codes))
            found[there], found[~there] = known[at[there]], chances(codes[~there])
            return [squeezed(x.tobytes()) for x in np.split(found, ends_of(lists))]
        return answer

    def words_of(words: pa.Array, n: np.ndarray):
        n = np.append(n, 0)

        def answer(asked: list[bytes]) -> list[bytes]:
            lists = [unpacked_words(x) for x in asked]
            at = pc.fill_null(pc.index_in(pa.concat_arrays(lists), words), len(words)).to_numpy()
            return [packed(x) for x in np.split(n[at], ends_of(lists))]
        return answer

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, answer, room, asked, size = None, None, 0, [], 0

        def answers() -> pa.RecordBatch:
            chunks, keys = zip(*asked)
            return pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array([now] * len(chunks), pa.int32()), pa.array(answer(keys), pa.binary())],
                                              names=["chunk", "part", "found"])

        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("part", "chunk", "keys", "counts"))):
                part, chunk, keys, n = (x.as_py() for x in row)
                if asked and (part != now or size > room):
                    yield answers()
                    asked, size = [], 0
                if chunk is None or part != now:  # without sums nothing of the part is training
                    first = (keys, n) if chunk is None else (packed_rising(none) if part < parts else squeezed(b""), packed(none))
                    now, answer = part, (grams_of(unpacked_rising(first[0]), unpacked(first[1])) if part < parts else
                                         words_of(unpacked_words(first[0]), unpacked(first[1])))
                    room = ASKED + len(first[0])  # what is asked at a time: as much as is known, so that this is looked through in proportion
                if chunk is not None:
                    asked.append((chunk, keys))
                    size += len(keys)
        if asked:
            yield answers()
    return run


# --- last pass: scores -------------------------------------------------------------------------------

SCORE = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def scorer(parts: int, depth: int, total: int, distinct: int, ends: int):
    def per_document(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
        return sums[starts[1:]] - sums[starts[:-1]]

    def base(counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + BASE_SMOOTHING) / (total + BASE_SMOOTHING * (distinct + 1)))

    def exact_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        if not len(values):
            return np.zeros(len(starts) - 1)
        filled_ = np.append(values, 0.0)
        out = np.add.reduceat(filled_, starts[:-1])
        out[starts[1:] == starts[:-1]] = 0.0
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i] for n in ("doc_ids", "no_id", "held", "starts", "codes")}
                row = {n: v.as_py() for n, v in row.items()}
                ids, starts = np.frombuffer(row["doc_ids"], np.int64), np.frombuffer(row["starts"], np.int64)
                codes = from_planes(restored(row["codes"]))
                found = dict(zip(batch.column("found_parts")[i].as_py(), batch.column("found")[i].values))
                own_parts, keys = batch.column("part")[i].as_py(), batch.column("keys")[i].values
                grams_, words_ = ([(keys[k].as_py(), found[p].as_py()) for k, p in enumerate(own_parts) if (p >= parts) == of_words] for of_words in (False, True))
                chance = np.concatenate([np.frombuffer(restored(x)) for _, x in grams_])
                places = Places(turned(np.concatenate([unpacked_rising(k) for k, _ in grams_]), depth))
                words = with_end(from_raw(np.frombuffer(b"".join(restored(k) for k, _ in words_), np.uint8)))
                counts = np.concatenate([np.zeros(0, np.int64), *(unpacked(x) for _, x in words_)])
                each = base(counts)
                n_known, base_score, score = np.zeros(len(ids), np.int64), np.zeros(len(ids)), np.zeros(len(ids))
                a = 0
                while a < len(ids):  # documents in pieces of bounded size
                    b = piece_end(starts, a, SCORED)
                    own, at = codes[starts[a]:starts[b]], starts[a:b + 1] - starts[a]
                    n_known[a:b], base_score[a:b] = exact_sums(counts[own] > 0, at), exact_sums(each[own], at)
                    data, at = symbols_of(words, own, at)
                    score[a:b] = exact_sums(chance[places.find(grams(data, at, depth))], at)
                    a = b
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids, mask=np.frombuffer(row["no_id"], bool)), pa.array(np.frombuffer(row["held"], bool)),
                    pa.array(np.diff(starts) + 1), pa.array(n_known + (ends > 0)), pa.array(base_score + base(np.array([ends]))[0]), pa.array(score)],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])
    return run


def parts_for(partitions: int) -> int:
    return min(PARTS * partitions, MOST_PARTS)


def score_documents(docs: DataFrame, held_out, depth: int = DEPTH, least_share: float = 0.0, least_gain: float = LEAST_GAIN,
                    chunk_words: int = CHUNK_WORDS, least_count: int = LEAST_COUNT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; ``held_out`` is a condition over doc_id.

    A ``least_share`` above 0 asks for a smaller tree: contexts below that share of all training positions are left out too.
    """
    if depth > 6:
        raise ValueError("contexts of more than 6 symbols do not fit a long")
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = parts_for(partitions)
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"),
                                               F.coalesce(held_out, F.lit(False)).alias("held_out"))
    chunks = bucketed(rows.mapInArrow(chunker(depth, chunk_words, parts), CHUNK), "chunk", "pst-chunks")
    packs = chunks.select("chunk", F.inline(F.arrays_zip("part", "keys", "counts")))
    sums = stored(packs.repartition(partitions, "part").sortWithinPartitions("part").select("part", "keys", "counts").mapInArrow(run_sums(parts), SUMS), "pst-sums")
    of_words = sums.filter(F.col("part") >= parts).agg(F.sum("total"), F.sum("distinct_keys")).first()
    ends = rows.filter(~F.col("held_out")).count()
    total, distinct = (of_words[0] or 0) + ends, (of_words[1] or 0) + (ends > 0)
    pairs = chunks.select(F.explode(F.arrays_zip("low", "low_counts")).alias("g")).groupBy(F.col("g.low").alias("code")).agg(F.sum("g.low_counts").alias("n"))
    seen = pairs.filter("n > 0").collect()  # at most 258 * 257 rows: contexts of one symbol
    codes, n = (np.array([r[c] for r in seen], np.int64) for c in ("code", "n"))
    least = max(least_count, float(n.sum()) * least_share)
    near = min(NEAR, depth)
    low = learn({d: level(codes, n, d, least) for d in range(near)}, near - 1, least_gain)
    asked = sums.select(F.lit(None).cast("bigint").alias("chunk"), "part", "keys", "counts").union(
        packs.select("chunk", "part", "keys", F.lit(None).cast("binary").alias("counts")))
    found = (asked.repartition(partitions, "part").sortWithinPartitions("part", F.col("chunk").asc_nulls_first())
             .mapInArrow(run_found(parts, low, depth, least, least_gain), "chunk bigint, part int, found binary")
             .groupBy("chunk").agg(F.collect_list(F.struct("part", "found")).alias("found")))
    wanted = ["doc_ids", "no_id", "held", "starts", "codes", "part", "keys"]
    joined = looked_up(chunks.select("chunk", *wanted), found, "chunk", "inner").select(
        *wanted, F.col("found.part").alias("found_parts"), F.col("found.found").alias("found"))
    return joined.mapInArrow(scorer(parts, depth, total, distinct, ends), SCORE).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"), "base_score", "score")
