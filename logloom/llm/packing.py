"""Packing by power-of-two decomposition.

A document's token ids (its text's ids, then an end id) are cut from left to right into pieces of ``max_length`` and then
into one piece per binary digit of the rest, largest first. A piece is a training sequence of its own: its length is a
power of two, so it needs no padding, and no sequence crosses documents. Sequences of one length form a bucket, and a
training batch is drawn from one bucket.

There is no shuffle: pieces follow from one document alone, so a hot source or key makes no hot task.

Null or empty text gives the end id alone (one piece of length 1). Repeated rows and repeated ids are documents of their
own. Texts of any length are cut whole. A null ``doc_id`` is kept. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import batches_of, binaries, filled, lowered, pick, split_words

SCHEMA = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, bucket int"
ROWS = 2000  # documents encoded at a time
UNIQUE = 20_000  # distinct words encoded at a time
GROUP = 100  # words of letters encoded as one text
KNOWN = 400_000  # words remembered before the memory is cleared


def cut(length: int, max_length: int) -> list[int]:
    """The pieces of a document of ``length`` tokens, as ``pieces_of`` cuts it."""
    rest = length % max_length
    return [max_length] * (length // max_length) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pieces_of(lengths: np.ndarray, max_length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each piece of all documents, in order: the document's number and the piece's length."""
    order, sizes, docs = [], [], []
    full, rest = lengths // max_length, lengths % max_length
    which = np.repeat(np.arange(len(lengths)), full)
    docs.append(which)
    sizes.append(np.full(len(which), max_length, np.int64))
    for bit in range(max_length.bit_length() - 2, -1, -1):
        which = np.flatnonzero(rest >> bit & 1)
        docs.append(which)
        sizes.append(np.full(len(which), 1 << bit, np.int64))
    docs, sizes = np.concatenate(docs), np.concatenate(sizes)
    order = np.argsort(docs, kind="stable")
    return docs[order], sizes[order]


class WordEncoder:
    """Encodes words once each: ids of known words lie in one pool, in order of ``place`` and ``size``.

    The tokenizer lower-cases, drops white space, and never joins across it or between letters and other signs. So a word
    is encoded alone, whatever stands around it. Words of letters alone are encoded many at a time: each ends with the
    only id that carries the end-of-word mark.
    """

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        suffix = "</w>"
        self.ends = np.zeros(tokenizer.get_vocab_size(), bool)
        self.ends[[i for token, i in tokenizer.get_vocab().items() if token.endswith(suffix)]] = True
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.pool, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _alone(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self._encode(words)
        return np.fromiter((i for x in ids for i in x), np.uint32), np.array([len(x) for x in ids], np.int64)

    def _add(self, words: list[str]) -> None:
        plain = [w for w in words if w.isalpha()]
        other = [w for w in words if not w.isalpha()]
        pools, sizes, order = [self.pool], [self.sizes], []
        for at in range(0, len(plain), UNIQUE):
            part = plain[at:at + UNIQUE]
            groups = [part[i:i + GROUP] for i in range(0, len(part), GROUP)]
            for group, ids in zip(groups, self._encode([" ".join(g) for g in groups])):
                found = np.array(ids, np.uint32)
                cut = np.flatnonzero(self.ends[found]) + 1
                if len(cut) == len(group) and cut[-1] == len(found):
                    pools.append(found)
                    sizes.append(np.diff(cut, prepend=0))
                else:  # a letter that the tokenizer's tables do not count as one
                    pool, size = self._alone(group)
                    pools.append(pool)
                    sizes.append(size)
            order += part
        for at in range(0, len(other), UNIQUE):
            pool, size = self._alone(other[at:at + UNIQUE])
            pools.append(pool)
            sizes.append(size)
            order += other[at:at + UNIQUE]
        self.known.update(zip(order, range(len(self.known), len(self.known) + len(order))))
        self.pool, self.sizes = np.concatenate(pools), np.concatenate(sizes)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the number of ids per text."""
        apart = pc.replace_substring_regex(lowered(texts), r"([a-z])([.,])", r"\1 \2")
        flat, starts = split_words(apart)
        coded = flat.dictionary_encode()
        unique = coded.dictionary.to_pylist()
        if len(self.known) > KNOWN:
            self.clear()
        self._add([w for w in unique if w not in self.known])
        word = np.fromiter(map(self.known.__getitem__, unique), np.int64, len(unique))[coded.indices.to_numpy()]
        each = self.sizes[word]
        ends = np.concatenate([[0], np.cumsum(each)])
        place = np.cumsum(self.sizes) - self.sizes
        picked = np.arange(ends[-1]) + np.repeat(place[word] - ends[:-1], each)
        return self.pool[picked], ends[starts[1:]] - ends[starts[:-1]]


def packer(tokenizer_path: str, max_length: int, end_id: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark owns the cores
        from tokenizers import Tokenizer

        words = WordEncoder(Tokenizer.from_file(tokenizer_path))
        for batch in batches_of(batches, ROWS):
            ids, counts = words.encode(filled(batch.column("text")))
            total = counts + 1
            ends = np.cumsum(total)
            data = np.full(int(total.sum()), end_id, np.uint32)
            real = np.ones(len(data), bool)
            real[ends - 1] = False
            data[real] = ids
            docs, sizes = pieces_of(total, max_length)
            starts = np.concatenate([[0], np.cumsum(sizes)])
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(pa.array(docs)),
                pa.array(starts[:-1] - (ends - total)[docs]), pa.array(sizes), binaries(data.astype("<u4"), starts),
                pa.array(total[docs]), pa.array(np.log2(sizes).astype(np.int32)),
            ], names=["doc_id", "start", "length", "ids", "doc_tokens", "bucket"])
    return pack


def pack_documents(docs: DataFrame, tokenizer_path: str, max_length: int = 2048, end_id: int = 1) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, bucket (log2 of the
    length), sequence_id, offset (always 0: a piece is a sequence). ``max_length`` is a power of two."""
    if max_length < 1 or max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    pieces = rows.mapInArrow(packer(tokenizer_path, max_length, end_id), SCHEMA)
    return pieces.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("bigint")})


def write_buckets(pieces: DataFrame, path: str) -> None:
    """The sequences as Parquet, one folder per length; large buckets are split, small ones share a task."""
    pieces.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(path)
