"""Exact top-k search by inner product with ball trees.

The vectors are dealt into shards of about ``shard_rows`` rows (round robin, so equal vectors or ids cannot crowd one
shard). Each shard builds a ball tree: nodes with a centre, a radius, and the smallest id below. For a query q the score
below a node is at most ``q . centre + |q| radius``; nodes are visited in order of that bound, and a node is skipped once
its bound is below the current kth score (or equal to it, with no smaller id below). The kth score is shared: a query
first searches its home shard, and takes the kth score (and id) found there to all other shards, where a shard's hits
raise it further. Scores are exact integers; bounds carry a margin for rounding.

Queries are packed in blocks, one row per (block, shard): a stated query set against all rows, in blocks. Memory is
bounded by one shard and one block. Every shard returns at most k rows a query.

Vectors that are null, empty, or hold null or non-finite components take no part, nor do rows without an id. Only vectors
of one length are compared. Rows with equal ids are rows of their own: a query skips its own row only. Equal scores go to
the smaller id. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.common import pick, stored

SHARD_ROWS = 8192
BLOCK = 256
LEAF = 64
EXACT = float(1 << 53)

SHARD = ("shard int, dim int, ids binary, vectors binary, centres binary, radii binary, least binary, bounds binary, "
         "n_queries int, place binary, floor_score binary, floor_id binary")
HIT = "query_shard int, query_place int, query_id bigint, vec_id bigint, score bigint"


def scaled(vectors: np.ndarray, factor: int) -> np.ndarray:
    return np.floor(vectors.astype(np.float64) * factor)


# --- tree ----------------------------------------------------------------------------------------------

def build(ids: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The order of rows in the leaves, and the nodes in an array: children of node i are left[i] and left[i] + 1."""
    order = np.arange(len(ids))
    begin, end, left, centres, radii, least = [0], [len(ids)], [-1], [], [], []
    node = 0
    while node < len(begin):
        a, b = begin[node], end[node]
        rows = vectors[order[a:b]]
        centre = rows.mean(axis=0)
        away = np.sqrt(((rows - centre) ** 2).sum(axis=1))
        centres.append(centre)
        radii.append(away.max() if len(away) else 0.0)
        least.append(ids[order[a:b]].min() if b > a else 0)
        if b - a > LEAF and radii[-1] > 0:
            pole = rows[away.argmax()]
            other = rows[((rows - pole) ** 2).sum(axis=1).argmax()]
            along = rows @ (other - pole)
            half = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(along, half)]
            left[node] = len(begin)
            begin += [a, a + half]
            end += [a + half, b]
            left += [-1, -1]
        node += 1
    return order, {"begin": np.array(begin), "end": np.array(end), "left": np.array(left), "centres": np.array(centres),
                   "radii": np.array(radii), "least": np.array(least, np.int64)}


def scores(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products of integral vectors (as long; beyond its range, its ends)."""
    if len(vectors) and np.abs(vectors).max() * np.abs(query).max() * len(query) < EXACT:
        return (vectors @ query).astype(np.int64)
    whole = [sum(int(a) * int(b) for a, b in zip(row.tolist(), query.tolist())) for row in vectors]
    return np.array([max(min(x, 2**63 - 1), -2**63) for x in whole], np.int64)


def search(tree: dict[str, np.ndarray], ids: np.ndarray, vectors: np.ndarray, query: np.ndarray, k: int, skip: int,
           floor: tuple[int, int] | None) -> list[tuple[int, int]]:
    """The best (score, -id) pairs of a shard that can still be among the k best, unordered.

    ``floor`` is the kth (score, -id) known from elsewhere: only better or equal pairs count. ``skip`` is a row to leave out.
    """
    best: list[tuple[int, int]] = []
    length = float(np.sqrt(query @ query))

    def bound(node: int) -> float:
        middle = float(tree["centres"][node] @ query)
        top = middle + length * float(tree["radii"][node])
        return np.floor(top + 1e-9 * (abs(middle) + length * float(tree["radii"][node]) + 1.0) + 1e-6)

    def limit() -> tuple[int, int] | None:
        own = best[0] if len(best) == k else None
        return max(x for x in (own, floor) if x is not None) if own is not None or floor is not None else None

    queue = [(-bound(0), 0)]
    while queue:
        top, node = heapq.heappop(queue)
        now = limit()
        if now is not None and (-top, -int(tree["least"][node])) < now:
            if -top < now[0]:
                break
            continue
        if tree["left"][node] >= 0:
            for child in (int(tree["left"][node]), int(tree["left"][node]) + 1):
                heapq.heappush(queue, (-bound(child), child))
            continue
        a, b = int(tree["begin"][node]), int(tree["end"][node])
        found = scores(vectors[a:b], query)
        if now is not None:
            near = np.flatnonzero(found >= now[0])
        elif len(found) > k + 1:
            near = np.flatnonzero(found >= np.partition(found, -(k + 1))[-(k + 1)])
        else:
            near = np.arange(len(found))
        for pair in heapq.nlargest(k + 1, ((int(found[i]), -int(ids[a + i]), a + i) for i in near.tolist())):
            if pair[2] == skip:
                continue
            if len(best) < k:
                heapq.heappush(best, pair[:2])
            elif pair[:2] > best[0]:
                heapq.heapreplace(best, pair[:2])
    return [x for x in best if floor is None or x >= floor]


# --- tasks ---------------------------------------------------------------------------------------------

def shard_maker(factor: int, every: int, k: int):
    """One row per vector length in a partition: the shard, its tree, its queries and their kth score at home."""
    def pack(x: np.ndarray) -> bytes:
        return np.ascontiguousarray(x).tobytes()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            lists, ids = batch.column("embedding"), batch.column("vec_id").to_numpy()
            flat, at = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            sizes = np.diff(at)
            for dim in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == dim)
                held.setdefault(dim, []).append((ids[rows], flat[(at[rows] - at[0])[:, None] + np.arange(dim)]))
        for dim, parts in held.items():
            ids = np.concatenate([x for x, _ in parts])
            vectors = scaled(np.concatenate([x for _, x in parts]), factor)
            order, tree = build(ids, vectors)
            ids, vectors = ids[order], vectors[order]
            place = np.flatnonzero(ids % every == 0)
            floors = []
            for p in place.tolist():
                best = search(tree, ids, vectors, vectors[p], k, p, None)
                floors.append(min(best) if len(best) == k else (-2**63, -2**63 + 1))
            floor = np.array(floors, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_pylist([{
                "shard": part, "dim": dim, "ids": pack(ids.astype(np.int64)), "vectors": pack(vectors), "centres": pack(tree["centres"]),
                "radii": pack(tree["radii"]), "least": pack(tree["least"]),
                "bounds": pack(np.stack([tree["begin"], tree["end"], tree["left"]]).astype(np.int64)), "n_queries": len(place),
                "place": pack(place.astype(np.int64)), "floor_score": pack(floor[:, 0]), "floor_id": pack(floor[:, 1])}], schema=OUT)
    return make


OUT = pa.schema([("shard", pa.int32()), ("dim", pa.int32()), *((n, pa.binary()) for n in ("ids", "vectors", "centres", "radii", "least", "bounds")),
                 ("n_queries", pa.int32()), *((n, pa.binary()) for n in ("place", "floor_score", "floor_id"))])


def blocks(block: int):
    """The queries of the shards in blocks of at most ``block``."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, place = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["place"], np.int64)
                vectors = np.frombuffer(row["vectors"], np.float64).reshape(len(ids), row["dim"])
                score, other = np.frombuffer(row["floor_score"], np.int64), np.frombuffer(row["floor_id"], np.int64)
                for a in range(0, len(place), block):
                    p = place[a:a + block]
                    yield pa.RecordBatch.from_pylist([{
                        "home": row["shard"], "dim": row["dim"], "q_place": p.tobytes(), "q_ids": ids[p].tobytes(), "q_vectors": vectors[p].tobytes(),
                        "q_score": score[a:a + block].tobytes(), "q_other": other[a:a + block].tobytes()}], schema=BLOCK_OUT)
    return cut


BLOCK_OUT = pa.schema([("home", pa.int32()), ("dim", pa.int32()), *((n, pa.binary()) for n in ("q_place", "q_ids", "q_vectors", "q_score", "q_other"))])
BLOCK_SCHEMA = "home int, dim int, q_place binary, q_ids binary, q_vectors binary, q_score binary, q_other binary"


def searcher(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                dim = row["dim"]
                ids = np.frombuffer(row["ids"], np.int64)
                vectors = np.frombuffer(row["vectors"], np.float64).reshape(-1, dim)
                begin, end, left = np.frombuffer(row["bounds"], np.int64).reshape(3, -1)
                tree = {"begin": begin, "end": end, "left": left, "centres": np.frombuffer(row["centres"], np.float64).reshape(-1, dim),
                        "radii": np.frombuffer(row["radii"], np.float64), "least": np.frombuffer(row["least"], np.int64)}
                place, names = np.frombuffer(row["q_place"], np.int64), np.frombuffer(row["q_ids"], np.int64)
                queries = np.frombuffer(row["q_vectors"], np.float64).reshape(-1, dim)
                floors = zip(np.frombuffer(row["q_score"], np.int64).tolist(), np.frombuffer(row["q_other"], np.int64).tolist())
                home = row["home"] == row["shard"]
                out = []
                for p, name, q, floor in zip(place.tolist(), names.tolist(), queries, floors):
                    known = None if floor[0] == -2**63 and floor[1] == -2**63 + 1 else floor
                    out += [(row["home"], p, name, -i, s) for s, i in search(tree, ids, vectors, q, k, p if home else -1, known)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                                                     names=["query_shard", "query_place", "query_id", "vec_id", "score"])
    return run


def usable(vectors: Column) -> Column:
    bad = F.exists(vectors, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.isNotNull() & (F.size(vectors) > 0) & ~bad


def top_k(embeddings: DataFrame, k: int = 10, every: int = 100, factor: int = 1024, shard_rows: int = SHARD_ROWS, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best rows by inner product of ``floor(factor * x)``.

    Queries are the rows whose id is divisible by ``every``; a query's own row is left out. Fewer rows: all of them.
    """
    rows = pick(embeddings, "vec_id", "embedding").withColumn("embedding", F.col("embedding").cast("array<double>"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).withColumn("vec_id", F.col("vec_id").cast("bigint"))
    count = max(1, -(-rows.count() // shard_rows))
    shards = stored(rows.repartition(count).mapInArrow(shard_maker(factor, every, k), SHARD), "ball-shards")
    queries = stored(shards.select("shard", "dim", "ids", "vectors", "place", "floor_score", "floor_id", "n_queries").filter("n_queries > 0")
                     .mapInArrow(blocks(block), BLOCK_SCHEMA), "ball-queries")
    # each block meets each shard once: a stated query set against all rows, in blocks
    dealt = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    trees = shards.select("shard", "dim", "ids", "vectors", "centres", "radii", "least", "bounds")
    n = min(count * 4, int(embeddings.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    met = dealt.join(trees, ["shard", "dim"]).repartition(max(1, n))
    hits = met.mapInArrow(searcher(k), HIT)
    ranked = Window.partitionBy("query_shard", "query_place", "query_id").orderBy(F.desc("score"), "vec_id")
    return (hits.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
