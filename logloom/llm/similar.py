"""Near-duplicates by the Jaccard similarity of word shingles.

Documents whose sets of five-word shingles have a similarity of ``LEAST`` or more are linked, and a component is what links
reach. Candidates share one of ``BANDS`` bands of ``BAND_ROWS`` min-hashes (a pair at 0.8 is missed with probability
(1 - 0.8**4)**24, about 3 in a million, less above); each link is checked on the exact sets before it counts.

Documents with equal sets are one from the start. The bands are then taken in ``ROUNDS``: after each, what its links connect
is one component, and a band all of whose documents are in one component is not looked at again. So most texts are sent
to one band, not to every band they share. Inside a band pairs that are already connected are skipped, so a
large group of near copies costs no quadratic work and gives at most one edge a document; a band of more than ``band_docs``
documents is split into chunks, and every pair of chunks is a group of its own: same links.

Texts without words are copies of each other. Repeated rows and null ids are fine. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.common import BLOCK, batches_of, bucketed, chosen, filled, looked_up, numbered, stored
from logloom.llm.simhash import ROWS, SEED, connected, shingle_hashes

SHINGLE = 5
LEAST = (4, 5)
BANDS, BAND_ROWS = 24, 4
ROUNDS = [(0, 1), (1, 4), (4, BANDS)]
BAND_DOCS = 2000
PIECE = 10_000  # shingles hashed at a time
_RNG = np.random.default_rng(SEED)
_TIMES = _RNG.integers(0, 2**63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RNG.integers(0, 2**63, BANDS * BAND_ROWS, dtype=np.uint64)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; {0} without words."""
    hashes, ends = shingle_hashes(filled(texts), SHINGLE, SEED)
    return [np.unique(hashes[a:b]) if b > a else np.zeros(1, np.uint64) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def bands_of(shingles: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max)
    for a in range(0, len(shingles), PIECE):
        least = np.minimum(least, (shingles[a:a + PIECE, None] * _TIMES + _PLUS).min(axis=0))
    key = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, BAND_ROWS).T:
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + column
    return key.view(np.int64)


def run_signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A digest of each text's set, and its bands."""
    for batch in batches_of(batches, ROWS):
        sets = shingle_sets(batch.column("text"))
        whole = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
        bands = pa.array([bands_of(s) for s in sets], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(whole, pa.binary()), bands], names=["row", "whole", "bands"])


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return LEAST[1] * both >= LEAST[0] * (len(a) + len(b) - both)


def checked(sets: list[np.ndarray], side: np.ndarray, component: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``sets``, or between the sides 1 and 2 only, beyond what is connected already."""
    size = np.array([len(s) for s in sets])
    root, out = np.unique(component, return_inverse=True)[1], []
    for i in range(1, len(sets)):
        open_ = (LEAST[1] * np.minimum(size[:i], size[i]) >= LEAST[0] * np.maximum(size[:i], size[i])) & ((side[:i] != side[i]) | (side[i] == 0))
        left = np.flatnonzero(open_ & (root[:i] != root[i]))
        while len(left):
            j, left = int(left[0]), left[1:]
            if alike(sets[i], sets[j]):
                out.append((i, j))
                root[root == root[i]] = root[j]
                left = left[root[left] != root[i]]
    return out


def run_checks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Checked links of sorted (shard, side, row, component, text) rows."""
    now, held = None, []

    def settled() -> pa.RecordBatch:
        side, rows, component, sets = zip(*held)
        pairs = checked(list(sets), np.array(side), np.array(component))
        return pa.RecordBatch.from_arrays([pa.array([rows[i] for i, _ in pairs], pa.int64()), pa.array([rows[j] for _, j in pairs], pa.int64())], names=["u", "v"])

    for batch in batches_of(batches, ROWS):
        columns = [batch.column(c).to_pylist() for c in ("shard", "side", "row", "component")]
        for shard, side, row, component, shingles in zip(*columns, shingle_sets(batch.column("text"))):
            if shard != now:
                if held:
                    yield settled()
                now, held = shard, []
            held.append((side, row, component, shingles))
    if held:
        yield settled()


def round_links(rows: DataFrame, bands: DataFrame, components: DataFrame | None, band_docs: int) -> DataFrame:
    """Edges (u, v) that the bands (row, band) add to the components (u, v: row and root) known so far."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if components is None:
        marked = bands.withColumn("component", F.col("row"))
    else:
        known = components.select(F.col("u").alias("row"), "v")
        marked = bands.join(known, "row", "left").select("row", "band", F.coalesce("v", "row").alias("component"))
    marked = stored(marked, "similar-bands")
    open_ = (marked.groupBy("band").agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi"))
             .filter("lo < hi").select("band", F.ceil(F.col("n") / band_docs).cast("int").alias("chunks")))
    mine = marked.join(open_, "band").withColumn("chunk", F.pmod(F.xxhash64("row"), F.col("chunks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct(
        F.least(c, F.col("chunk")).alias("lo"), F.greatest(c, F.col("chunk")).alias("hi"),
        F.when(c == F.col("chunk"), 0).when(F.col("chunk") < c, 1).otherwise(2).alias("side")))
    keyed = stored(mine.select("row", "component", "band", F.inline(pairs)).select(
        "row", "component", F.xxhash64("band", "lo", "hi").alias("shard"), "side"), "similar-shards")
    # texts go to the bands, not sets: a set is larger and cannot be compressed. What a text is asked for comes to the text
    asked = (keyed.groupBy("row").agg(F.collect_list(F.struct("shard", "side", "component")).alias("asked"))
             .groupBy(F.shiftright("row", BLOCK).alias("_block")).agg(F.map_from_entries(F.collect_list(F.struct("row", "asked"))).alias("_asked")))
    found = looked_up(rows, asked, F.col("block") == F.col("_block"), "inner").select("row", "text", F.element_at("_asked", F.col("row")).alias("asked"))
    together = found.select("row", "text", F.inline("asked")).repartition(n, "shard").sortWithinPartitions("shard", "row")
    return together.select("shard", "side", "row", "component", "text").mapInArrow(run_checks, "u bigint, v bigint")


def links(rows: DataFrame, band_docs: int = BAND_DOCS) -> DataFrame:
    """Edges (u, v) between ``numbered`` rows (row, block, text) that connect what is linked, and nothing else."""
    signed = stored(rows.select("row", "text").mapInArrow(run_signatures, "row bigint, whole binary, bands array<bigint>"), "similar-signatures")
    firsts = signed.groupBy("whole").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    edges = stored(signed.select("row", "whole").join(firsts.filter("n > 1"), "whole").filter("row > first").select(
        F.col("row").alias("u"), F.col("first").alias("v")), "similar-edges")
    alone = signed.join(edges.select(F.col("u").alias("row")), "row", "left_anti")
    every = alone.select("row", F.posexplode("bands").alias("at", "band"))
    beside = Window.partitionBy("band").orderBy("row")
    several = F.lag("row").over(beside).isNotNull() | F.lead("row").over(beside).isNotNull()
    shared = stored(every.withColumn("several", several).filter("several").drop("several"), "similar-shared")
    # only texts that share a band with another are sent anywhere
    texts = bucketed(chosen(rows, shared.select("row")), "block", "similar-texts")
    for turn, (start, stop) in enumerate(ROUNDS):
        bands = shared.filter((F.col("at") >= start) & (F.col("at") < stop)).select("row", "band")
        found = round_links(texts, bands, connected(edges) if turn else None, band_docs)
        edges = edges.union(stored(found, "similar-edges"))
    return edges


def firsts(rows: DataFrame, text: str, doc: str, band_docs: int = BAND_DOCS) -> DataFrame:
    """Those ``numbered`` rows that come first in their component: by ``doc`` (nulls last), then by number."""
    roots = connected(links(rows.select("row", "block", F.col(text).cast("string").alias("text")), band_docs))
    members = stored(roots.select(F.col("u").alias("row"), F.col("v").alias("root")).union(roots.select("v", "v").distinct()), "similar-members")
    order = F.struct(F.col(doc).isNull().alias("a"), F.col(doc).alias("b"), F.col("row").alias("c"))
    first = members.join(rows.select("row", doc), "row").groupBy("root").agg(F.min(order).alias("m")).select(F.col("m.c").alias("row"))
    return chosen(rows, members.select("row").join(first, "row", "left_anti"), "left_anti")


def dedupe(docs: DataFrame, band_docs: int = BAND_DOCS) -> DataFrame:
    """One document of each component: the smallest doc_id (nulls last), one row of it if rows repeat."""
    names = docs.columns
    rows = numbered(docs.toDF(*(f"_{i}" for i in range(len(names)))), "similar-rows")
    kept = firsts(rows, f"_{names.index('text')}", f"_{names.index('doc_id')}", band_docs)
    return kept.select(*(f"_{i}" for i in range(len(names)))).toDF(*names)
