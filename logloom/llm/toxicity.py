"""Toxicity by compression distance.

Two zstandard dictionaries are learned from labelled texts, near copies once:

* the ordinary one by the library's training routine from windows of ordinary texts;
* the toxic one from windows of toxic texts. A window is ranked by the bytes that other toxic texts save on it beyond what
  as much ordinary text saves; the training routine makes segments of the best ranked; a segment is kept for what it
  saves on toxic windows, beyond ordinary ones, that the segments before it do not save. How many segments are kept is
  decided by the fit on labelled texts that took no part so far. No count or ratio has to be reached, so few labels make
  a smaller dictionary, not an empty one.

A text is cut into overlapping byte windows, and each window is compressed with the ordinary dictionary and with the toxic
one put before it (so that both share the ordinary content and differ by the toxic part alone); the bytes the toxic
dictionary saves are the window's gain. A document's gains are counted by size, and a logistic model, calibrated on other
labelled documents and set to the labels' own share of toxic ones, turns them into a score.

Fitting reads at most ``sample_rows`` labelled rows of each class (the first by a hash of the id, of at most
``sample_chars`` characters each) and ranks at most ``RANKED`` windows of each; scoring reads every window of every text in
one pass without a shuffle.

Null or empty text has one empty window and is scored like any other; repeated rows get equal scores. Of the texts of a
repeated id one is learned from, the same in every run. If one class has no labelled text, every score is the share of
toxic labels (0 without any label). An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import batches_of, filled, pick

WINDOW, STRIDE = 96, 80
MATCH = 4  # the shortest run of bytes that a dictionary can replace
ORDINARY_BYTES, CANDIDATE_BYTES = 32_768, 8_192
RANKED, MEASURED = 100_000, 2_500  # windows of a class that are ranked, and on which segments are measured
SHORT = 32  # bytes of a ranked window
COMPARED_BYTES = 131_072  # of each class, what a window is ranked by
SEGMENT, STEP = 8, 3
KEPT = (2, 4, 6, 8, 12, 16, 24, 32, 48, 64)  # how many segments the toxic dictionary may hold
GAINS = (1, 2, 3, 4, 5, 6, 8)  # a gain of at least so many bytes is counted
SCHEMA = "doc_id bigint, score double"
ROWS = 500


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the first is the intercept


def lowered_bytes(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass")


def windows(data: bytes) -> list[bytes]:
    return [data[i:i + WINDOW] for i in range(0, max(1, len(data) - (WINDOW - STRIDE)), STRIDE)]


def compressor(content: bytes, strategy: int, table_log: int):
    """Compresses windows with ``content`` as the dictionary."""
    import zstandard as z

    settings = z.ZstdCompressionParameters(
        format=z.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, window_log=max(17, table_log + 1), hash_log=table_log,
        chain_log=table_log, search_log=3 if table_log < 17 else 6, min_match=MATCH, strategy=strategy)
    dictionary = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=settings)
    return z.ZstdCompressor(dict_data=dictionary, compression_params=settings).compress


def compressors(ordinary: bytes, toxic: bytes):
    """By the ordinary dictionary, and by the toxic one before it. In front all offsets are long, so that what both hold is
    no cheaper there; the compressor's tables hold both dictionaries whole, so that nothing hides the front."""
    import zstandard as z

    return [compressor(content, z.STRATEGY_LAZY, 16) for content in (ordinary, toxic + ordinary)]


def marks(data: bytes) -> np.ndarray:
    """A 16-bit hash of every run of MATCH bytes."""
    raw = np.frombuffer(data, np.uint8).astype(np.uint64)
    code = np.zeros(max(0, len(raw) - MATCH + 1), np.uint64)
    for i in range(MATCH):
        code = (code << np.uint64(8)) | raw[i:len(raw) - MATCH + 1 + i]
    return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)


def table_of(toxic: bytes) -> np.ndarray:
    held = np.zeros(1 << 16, bool)
    held[marks(toxic)] = True
    return held


def gains(data: bytes, plain, toxic, held: np.ndarray) -> np.ndarray:
    """The gain of each window. A window without a run of MATCH bytes that the toxic content holds cannot gain: it is
    compressed alike by both dictionaries, so its gain is 0 without compressing it."""
    count = max(1, -(-(len(data) - (WINDOW - STRIDE)) // STRIDE))
    out = np.zeros(count, np.int64)
    at = np.flatnonzero(held[marks(data)])
    if len(at):
        last = np.minimum(at // STRIDE, count - 1)
        first = np.maximum(-(-(at + MATCH - WINDOW) // STRIDE), 0)
        touched = np.unique(np.concatenate([last, first])) if WINDOW <= 2 * STRIDE else np.arange(count)
        for i in touched.tolist():
            w = data[i * STRIDE:i * STRIDE + WINDOW]
            out[i] = len(plain(w)) - len(toxic(w))
    return out


def features(found: np.ndarray) -> list[float]:
    """Counts of gains by size, and their density."""
    counts = [int((found >= g).sum()) for g in GAINS]
    n = len(found)
    return [*(math.log1p(c) for c in counts), *(c / n for c in counts), float(found.max()), math.log1p(n)]


def without_near_copies(texts: list[bytes]) -> list[bytes]:
    """Texts of which at least half of the three-word windows are new; copies must not vouch for each other's words."""
    seen, kept = set(), []
    for text in texts:
        words = text.split()
        runs = {tuple(words[i:i + 3]) for i in range(max(1, len(words) - 2))}
        if 2 * len(runs & seen) <= len(runs):
            kept.append(text)
        seen |= runs
    return kept


def some(items: list[bytes], most: int) -> list[bytes]:
    """At most ``most`` of the items, the same ones in every run."""
    if len(items) <= most:
        return items
    return [items[i] for i in np.sort(np.random.default_rng(0).choice(len(items), most, replace=False)).tolist()]


def ranked_windows(toxic: list[bytes], ordinary: list[bytes], base: bytes) -> list[bytes]:
    """Short windows of toxic texts, first those on which the other half of the toxic texts saves most bytes beyond what
    as much ordinary text saves."""
    import zstandard as z

    found = []
    for half in (0, 1):
        mine, others, like = toxic[half::2], b" ".join(toxic[1 - half::2]), b" ".join(ordinary[half::2] or ordinary)
        size = min(len(others), len(like), COMPARED_BYTES)
        plain, marked = (compressor(x[:size] + base, z.STRATEGY_BTOPT, 18) for x in (like, others))
        pieces = [t[i:i + SHORT] for t in mine for i in range(0, max(1, len(t) - SHORT // 2), SHORT // 2)]
        found += [(len(marked(w)) - len(plain(w)), w) for w in some(pieces, RANKED // 2)]
    return [w for _, w in sorted(found)]


def segment_gains(segments: list[bytes], texts: list[bytes], base: bytes) -> np.ndarray:
    """What each segment (row) saves on each of a sample of windows (column); single bytes are noise and count nothing."""
    held = some([w for t in texts for w in windows(t)], MEASURED)
    plain, _ = compressors(base, b"")
    sizes, at = [len(plain(w)) for w in held], defaultdict(list)
    for i, w in enumerate(held):
        for mark in set(marks(w).tolist()):
            at[mark].append(i)
    out = np.zeros((len(segments), len(held)), np.float32)
    for row, segment in enumerate(segments):
        _, marked = compressors(base, segment)
        for i in {i for mark in set(marks(segment).tolist()) for i in at.get(mark, ())}:
            out[row, i] = sizes[i] - len(marked(held[i]))
    out[out < 2] = 0
    return out


def chosen_segments(segments: list[bytes], toxic: np.ndarray, ordinary: np.ndarray, most: int) -> list[bytes]:
    """Segments one by one: the next saves most on toxic windows, beyond ordinary ones and in units of its error, of what
    those before it do not save."""
    saved_t, saved_o = np.zeros(toxic.shape[1], np.float32), np.zeros(ordinary.shape[1], np.float32)
    floor = (4 / toxic.shape[1]) ** 2 + (4 / ordinary.shape[1]) ** 2
    out = []
    while len(out) < min(most, len(segments)):
        t, o = np.maximum(toxic - saved_t, 0), np.maximum(ordinary - saved_o, 0)
        error = np.sqrt((t * t).mean(axis=1) / t.shape[1] + (o * o).mean(axis=1) / o.shape[1] + floor)
        contrast = (t.mean(axis=1) - o.mean(axis=1)) / error
        best = int(contrast.argmax())
        if out and contrast[best] <= 0:
            break
        out.append(segments[best])
        saved_t, saved_o = np.maximum(saved_t, toxic[best]), np.maximum(saved_o, ordinary[best])
    return out


def toxic_segments(toxic: list[bytes], ordinary: list[bytes], base: bytes) -> list[bytes]:
    """Segments for the toxic dictionary, the clearest first; never empty."""
    import zstandard as z

    ranked = ranked_windows(toxic, ordinary, base)
    best = ranked[:max(50, len(ranked) // 20)]
    try:
        content = z.train_dictionary(CANDIDATE_BYTES, best, k=2 * SEGMENT, d=6).as_bytes()
    except z.ZstdError:  # too little text for the training routine
        content = b"".join(reversed(best))[-CANDIDATE_BYTES:]
    segments = sorted({content[i:i + SEGMENT] for i in range(0, max(1, len(content) - SEGMENT + 1), STEP)})
    return chosen_segments(segments, segment_gains(segments, toxic, base), segment_gains(segments, ordinary, base), max(KEPT))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a ridge logistic regression (intercept first), by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(toxic: list[bytes], ordinary: list[bytes], share: float) -> Model:
    """Dictionaries from the first half of each class; size of the toxic one and calibration from the second."""
    import zstandard as z

    toxic, ordinary = without_near_copies(toxic), without_near_copies(ordinary)
    if not toxic or not ordinary:
        return Model(b"", b"", np.zeros(1), np.ones(1), np.array([share]))
    cut = [max(1, len(x) // 2) for x in (toxic, ordinary)]
    pieces = [w for t in ordinary[:cut[1]] for w in windows(t)[::3]]
    try:
        base = z.train_dictionary(ORDINARY_BYTES, pieces, k=32, d=6).as_bytes()
    except z.ZstdError:  # too little text for the training routine
        base = b"".join(pieces)[-ORDINARY_BYTES:]
    segments = toxic_segments(toxic[:cut[0]], ordinary[:cut[1]], base)
    held = [(x[c:] or x, label) for x, c, label in ((toxic, cut[0], 1.0), (ordinary, cut[1], 0.0))]
    y = np.array([label for texts, label in held for _ in texts])
    best = None
    for count in sorted({min(n, len(segments)) for n in KEPT}):
        extra = b"".join(reversed(segments[:count]))
        plain, marked = compressors(base, extra)
        runs = table_of(extra)
        table = np.array([features(gains(t, plain, marked, runs)) for texts, _ in held for t in texts])
        mean, scale = table.mean(axis=0), table.std(axis=0) + 1e-9
        weights = logistic((table - mean) / scale, y)
        wrong = np.where(y > 0, -1, 1) * (weights[0] + ((table - mean) / scale) @ weights[1:])
        loss = float(np.logaddexp(0, wrong).mean())
        if best is None or loss < best[0]:
            best = (loss, Model(base, extra, mean, scale, weights))
    model = best[1]
    seen = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
    real = float(np.clip(share, 1e-6, 1 - 1e-6))
    model.weights[0] += math.log(real / (1 - real)) - math.log(seen / (1 - seen))
    return model


def score_texts(model: Model, texts: list[str]) -> np.ndarray:
    if len(model.weights) == 1:
        return np.full(len(texts), model.weights[0])
    plain, marked = compressors(model.ordinary, model.toxic)
    held = table_of(model.toxic)
    table = np.array([features(gains(lowered_bytes(t), plain, marked, held)) for t in texts]).reshape(len(texts), -1)
    return 1 / (1 + np.exp(-np.clip(model.weights[0] + ((table - model.mean) / model.scale) @ model.weights[1:], -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, usable: Column, sample_rows: int = 1500, sample_chars: int = 65_536) -> Model:
    """Learn from the labelled rows for which ``usable`` (over doc_id) holds; at most ``sample_rows`` of each class."""
    known = pick(labels, "doc_id", "toxic").filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & usable)
    counts = {r["toxic"]: r["n"] for r in known.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    chosen = None
    for kind in (F.col("toxic") > 0, F.col("toxic") <= 0):
        part = known.filter(kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
        chosen = part if chosen is None else chosen.union(part)
    # at most twice sample_rows ids
    texts = (pick(docs, "doc_id", "text").filter(F.length("text") <= sample_chars)
             .join(F.broadcast(chosen.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))), "doc_id")
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min_by("text", F.struct(F.xxhash64("text"), F.col("text"))).alias("text"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * sample_rows).select("text", "toxic").collect())
    both = [[lowered_bytes(r["text"]) for r in texts if (r["toxic"] > 0) == kind] for kind in (True, False)]
    return train(both[0], both[1], share)


def scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, ROWS):
            scores = score_texts(model, filled(batch.column("text")).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns)), pa.array(scores, pa.float64())],
                                             names=[*batch.schema.names, "score"])
    return run


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every document."""
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return rows.mapInArrow(scorer(model), "doc_id bigint, text string, score double").select("doc_id", "score")


def keep_clean(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """The documents whose score is below ``limit``, with their columns unchanged."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    names = docs.columns
    plain = docs.toDF(*(f"_{i}" for i in range(len(names)))).withColumn("text", F.col(f"_{names.index('text')}"))
    scored = plain.mapInArrow(scorer(model), StructType([*plain.schema, StructField("score", DoubleType())]))
    return scored.filter(F.col("score") < limit).select(*(f"_{i}" for i in range(len(names)))).toDF(*names)
