"""SimHash near-duplicates through vantage-point trees.

A fingerprint has a bit set where more than half of the document's shingle hashes have it. Documents whose fingerprints
differ in at most ``radius`` bits are linked, and a component is what links reach.

* Equal fingerprints become one point first, so groups of exact copies cost one point.
* Points are dealt into shards by Hamming distance. A whole-fingerprint vantage point separates badly (distances of
  unrelated fingerprints crowd at 32 bits, so a ball of radius 4 overlaps more than half of all shells around any vantage
  point, and most points would have to be sent to most shards). The distance is therefore taken over ``radius + 1``
  disjoint bit blocks, each a Hamming metric of its own: two points within ``radius`` bits have distance 0 in at least one
  block. A shard is a ball of radius 0 around one block value, and each point is queried in all ``radius + 1`` shards that
  its ball overlaps. No link is lost.
* Inside a shard a vantage-point tree is joined with itself: shells around a vantage point are paired only where the
  triangle inequality allows a link, and pairs of subtrees that are already connected are skipped, so a dense group of
  near copies costs no quadratic work. A shard returns a spanning forest (at most one edge a point), never all pairs.
* A shard with more than ``shard_points`` points is split into chunks, and every pair of chunks is a task: same links.
* Components follow from alternating large-star and small-star rounds over stored tables.

Null or empty text has fingerprint 0, linked like any other. Repeated rows and ids are fine: a component is named by its
smallest doc_id (null only if all its ids are null). An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from logloom.llm.common import batches_of, chosen, dropped, filled, lowered, numbered, pick, split_words, stored

SHINGLE = 4
SEED = 42
RADIUS = 4
ROWS = 2000
LEAF = 64
SHARD_POINTS = 20_000


# --- fingerprints --------------------------------------------------------------------------------------

def shingle_hashes(texts: pa.Array, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of each text's word shingles (in order, repeats included), and where each text's hashes start."""
    import xxhash

    flat, starts = split_words(lowered(texts))
    flat = flat.cast(pa.large_string())
    count = len(flat)
    raw = np.frombuffer(flat.buffers()[2] or b"", np.uint8) if count else np.zeros(0, np.uint8)
    at = np.frombuffer(flat.buffers()[1], np.int64, count + 1, 8 * flat.offset) if count else np.zeros(1, np.int64)
    lengths = np.diff(at)
    spaced = np.full(int(lengths.sum()) + count, 32, np.uint8)
    spaced[np.arange(int(lengths.sum())) + np.repeat(np.arange(count), lengths)] = raw[at[0]:at[-1]]
    first = at[:-1] - at[0] + np.arange(count)
    last = first + lengths
    words = np.diff(starts)
    each = np.where(words == 0, 0, np.maximum(words - size + 1, 1))
    ends = np.concatenate([[0], np.cumsum(each)])
    head = np.arange(ends[-1]) - np.repeat(ends[:-1], each) + np.repeat(starts[:-1], each)
    tail = np.minimum(head + size, np.repeat(starts[1:], each)) - 1
    data, digest = spaced.tobytes(), xxhash.xxh64_intdigest
    hashes = [digest(data[a:b], seed) for a, b in zip(first[head].tolist(), last[tail].tolist())]
    return np.array(hashes, np.uint64), ends


def majority(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The fingerprint of each text as an unsigned 64-bit number."""
    out = np.zeros((len(ends) - 1, 8), np.uint8)
    octets = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
        ones = np.zeros(64, np.int64)
        for c in range(a, b, 100_000):
            ones += np.unpackbits(octets[c:min(b, c + 100_000)], axis=1).sum(axis=0, dtype=np.int64)
        out[i] = np.packbits(2 * ones > b - a)
    return out.reshape(-1).view(">u8").astype(np.uint64)


def fingerprinter(size: int, seed: int, text_at: int):
    """Appends the fingerprint (as a signed long) to each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, ROWS):
            hashes, ends = shingle_hashes(filled(batch.column(text_at)), size, seed)
            prints = pa.array(majority(hashes, ends).view(np.int64))
            yield batch.append_column("fp", prints)
    return run


def fingerprints(docs: DataFrame, size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): one row per document."""
    rows = pick(docs, "doc_id", "text").select("doc_id", F.col("text").cast("string"))
    return rows.mapInArrow(fingerprinter(size, seed, 1), StructType([*rows.schema, StructField("fp", LongType())])).select("doc_id", "fp")


# --- links within a shard ------------------------------------------------------------------------------

def roots_of(parent: np.ndarray, which: np.ndarray) -> np.ndarray:
    out = parent[which]
    while True:
        up = parent[out]
        if np.array_equal(up, out):
            parent[which] = out
            return out
        out = up


def unite(parent: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Connect left[i] with right[i]; the smaller index becomes the root."""
    a, b = roots_of(parent, left), roots_of(parent, right)
    open_ = a != b
    for x, y in np.unique(np.stack([np.minimum(a, b)[open_], np.maximum(a, b)[open_]], axis=1), axis=0).tolist():
        while parent[x] != x:
            x = parent[x]
        while parent[y] != y:
            y = parent[y]
        if x != y:
            parent[max(x, y)] = min(x, y)


def shells(points: np.ndarray, members: np.ndarray, vantage: np.uint64) -> dict[int, np.ndarray]:
    distance = np.bitwise_count(points[members] ^ vantage)
    order = np.argsort(distance, kind="stable")
    values, first = np.unique(distance[order], return_index=True)
    return dict(zip(values.tolist(), np.split(members[order], first[1:])))


def vantage_links(points: np.ndarray, radius: int, sides: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """The parent of each point in a spanning forest of the links among ``points`` (or between two sides only).

    Self-join of a vantage-point tree: a pair of node sets is split into shells around a vantage point, and only shells
    whose distances differ by at most ``radius`` can hold a link.
    """
    parent = np.arange(len(points))
    every = parent.copy()
    todo = [(every, None) if sides is None else sides]
    turn = 0
    while todo:
        a, b = todo.pop()
        other = a if b is None else b
        known = np.union1d(roots_of(parent, a), roots_of(parent, other))
        if len(known) == 1 and (b is None or len(a) + len(b) > 1):
            continue
        if len(a) * len(other) <= LEAF * LEAF:
            i, j = np.nonzero(np.bitwise_count(points[a][:, None] ^ points[other][None, :]) <= radius)
            unite(parent, a[i], other[j])
            continue
        big = a if len(a) >= len(other) else other
        turn += 1
        vantage = points[big[(turn * 7919) % len(big)]]
        near = shells(points, a, vantage)
        if b is None:
            if len(near) == 1:  # duplicates of one distance only: halve instead
                half = len(a) // 2
                todo += [(a[:half], None), (a[half:], None), (a[:half], a[half:])]
                continue
            keys = sorted(near)
            for n, s in enumerate(keys):
                todo.append((near[s], None))
                todo += [(near[s], near[t]) for t in keys[n + 1:] if t - s <= radius]
            continue
        far = shells(points, b, vantage)
        if len(near) == 1 and len(far) == 1:
            if abs(next(iter(near)) - next(iter(far))) <= radius:
                long, short = (a, b) if len(a) >= len(b) else (b, a)
                half = len(long) // 2
                todo += [(long[:half], short), (long[half:], short)]
            continue
        todo += [(x, y) for s, x in near.items() for t, y in far.items() if abs(s - t) <= radius]
    return parent


def small_links(points: np.ndarray, group: np.ndarray, radius: int) -> np.ndarray:
    """As ``vantage_links`` for many leaf-sized groups at once; ``group`` is sorted."""
    parent = np.arange(len(points))
    step = 1
    while step < len(points):
        same = np.flatnonzero(group[step:] == group[:-step])
        if not len(same):
            break
        hit = same[np.bitwise_count(points[same] ^ points[same + step]) <= radius]
        if len(hit):
            unite(parent, hit, hit + step)
        step += 1
    return parent


def run_links(radius: int):
    """Links of sorted (shard, side, fp) rows: one edge (fp, root) per point that is linked to another."""
    def edges(points: np.ndarray, parent: np.ndarray) -> pa.RecordBatch:
        root = roots_of(parent, np.arange(len(points)))
        other = np.flatnonzero(root != np.arange(len(points)))
        return pa.RecordBatch.from_arrays([pa.array(points[other].view(np.int64)), pa.array(points[root[other]].view(np.int64))], names=["u", "v"])

    def large(points: np.ndarray, side: np.ndarray) -> pa.RecordBatch:
        two = None if (side == 0).all() else (np.flatnonzero(side == 1), np.flatnonzero(side == 2))
        return edges(points, vantage_links(points, radius, two))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # the run that may go on in the next batch

        def settle(shard: np.ndarray, side: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            cuts = np.flatnonzero(np.diff(shard)) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(shard)]])
            size = np.repeat(ends - starts, ends - starts)
            leaf = (size <= LEAF) & (side == 0)
            if leaf.any():
                yield edges(fp[leaf], small_links(fp[leaf], shard[leaf], radius))
            for s, e in zip(starts.tolist(), ends.tolist()):
                if not leaf[s]:
                    yield large(fp[s:e], side[s:e])

        for batch in batches:
            if not batch.num_rows:
                continue
            shard, side, fp = (batch.column(n).to_numpy() for n in ("shard", "side", "fp"))
            fp = fp.view(np.uint64)
            if held and held[-1][0][-1] != shard[0]:
                yield from settle(*map(np.concatenate, zip(*held)))
                held = []
            cut = int(np.searchsorted(shard, shard[-1]))
            if cut:
                yield from settle(*map(np.concatenate, zip(*held, (shard[:cut], side[:cut], fp[:cut]))))
                held = []
            held.append((shard[cut:].copy(), side[cut:].copy(), fp[cut:].copy()))
        if held:
            yield from settle(*map(np.concatenate, zip(*held)))
    return run


def blocks_of(radius: int) -> list[tuple[int, int]]:
    """(shift, width) of ``radius + 1`` disjoint bit blocks that cover 64 bits."""
    widths = [64 // (radius + 1) + (i < 64 % (radius + 1)) for i in range(radius + 1)]
    return [(sum(widths[:i]), w) for i, w in enumerate(widths)]


def links(points: DataFrame, radius: int = RADIUS, shard_points: int = SHARD_POINTS) -> DataFrame:
    """Edges (u, v) between distinct fingerprints ``points.fp``: a spanning forest per shard, so the same components."""
    balls = [F.struct(F.lit(i).alias("block"), F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << w) - 1)).alias("ball"))
             for i, (s, w) in enumerate(blocks_of(radius))]
    dealt = stored(points.select("fp", F.inline(F.array(*balls))), "simhash-shards")
    # at most radius + 1 blocks times 2**13 values: a bounded table
    heavy = (dealt.groupBy("block", "ball").agg(F.count("*").alias("n")).filter(F.col("n") > shard_points)
             .withColumn("chunks", F.ceil(F.col("n") / shard_points).cast("int")).drop("n"))
    sized = dealt.join(F.broadcast(heavy), ["block", "ball"], "left")
    mine = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    pairs = F.when(F.col("chunks").isNull(), F.array(F.struct(F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(0).alias("side")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct(
            F.least(c, F.col("chunk")).alias("lo"), F.greatest(c, F.col("chunk")).alias("hi"),
            F.when(c == F.col("chunk"), 0).when(F.col("chunk") < c, 1).otherwise(2).alias("side"))))
    keyed = (sized.withColumn("chunk", mine).select("fp", "block", "ball", F.inline(pairs))
             .select("fp", F.xxhash64("block", "ball", "lo", "hi").alias("shard"), "side"))
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    together = keyed.repartition(n, "shard").sortWithinPartitions("shard", "fp")
    return together.mapInArrow(run_links(radius), "u bigint, v bigint")


# --- components ----------------------------------------------------------------------------------------

def connected(edges: DataFrame) -> DataFrame:
    """(u, v): each node that is not a root, and its component's root (the smallest node)."""
    now = stored(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "components")
    seen = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == seen:
            return now
        seen = state
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("u", "low"))
        large = stored(both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).filter("u != v").distinct(), "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("low").alias("v")).union(joined.select("u", F.col("low").alias("v")))
        after = stored(small.filter("u != v").distinct(), "small-star")
        dropped(now)
        dropped(large)
        now = after


def components(prints: DataFrame, radius: int = RADIUS, shard_points: int = SHARD_POINTS) -> DataFrame:
    """(fp, root, component_id) for the distinct fingerprints of a stored (doc_id, fp) table.

    ``root`` is a fingerprint and tells components apart; ``component_id`` only names them (null or repeated ids may share one).
    """
    points = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-points")
    roots = connected(links(points, radius, shard_points))
    nodes = roots.select(F.col("u").alias("fp"), F.col("v").alias("root")).union(roots.select(F.col("v").alias("fp"), F.col("v").alias("root")).distinct())
    members = stored(nodes.join(points, "fp"), "simhash-members")
    least = members.groupBy("root").agg(F.min("first").alias("component_id"))
    named = stored(members.join(least, "root").select("fp", "root", "component_id"), "simhash-named")
    out = points.join(named, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "first").alias("component_id"))
    return stored(out, "simhash-components")


def simhash_groups(docs: DataFrame, size: int = SHINGLE, seed: int = SEED, radius: int = RADIUS,
                   shard_points: int = SHARD_POINTS) -> DataFrame:
    """doc_id, fp (signed long) and component_id per document."""
    prints = stored(fingerprints(docs, size, seed), "simhash-prints")
    return prints.join(components(prints, radius, shard_points), "fp").select("doc_id", "fp", "component_id")


def hexadecimal(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")


def fingerprinted(docs: DataFrame, size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``docs`` as ``numbered`` rows with their fingerprints; its columns are called ``_0``, ``_1`` and so on."""
    names = docs.columns
    plain = docs.toDF(*(f"_{i}" for i in range(len(names))))
    schema = StructType([*plain.schema, StructField("fp", LongType())])
    return numbered(plain.mapInArrow(fingerprinter(size, seed, names.index("text")), schema), "simhash-rows")


def firsts(rows: DataFrame, doc: str, radius: int = RADIUS) -> DataFrame:
    """Those ``fingerprinted`` rows that come first in their component: by ``doc`` (nulls last), then by number."""
    keys = rows.select(F.col(doc).alias("doc_id"), "fp", "row")
    grouped = keys.join(components(keys.select("doc_id", "fp"), radius).select("fp", F.col("root").alias("c")), "fp")
    # the root tells components apart (ids may be null or repeat); the smallest id is kept, the smallest row settles ties
    order = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("row").alias("c"))
    return chosen(rows, stored(grouped.groupBy("c").agg(F.min(order).alias("m")).select(F.col("m.c").alias("row")), "simhash-firsts"))


def dedupe(docs: DataFrame, size: int = SHINGLE, seed: int = SEED, radius: int = RADIUS) -> DataFrame:
    """One document of each component: the smallest doc_id (nulls last), one row of it if rows repeat."""
    names = docs.columns
    rows = firsts(fingerprinted(docs, size, seed), f"_{names.index('doc_id')}", radius)
    return rows.select(*(f"_{i}" for i in range(len(names)))).toDF(*names)
