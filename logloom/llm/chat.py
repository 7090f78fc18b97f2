"""Chat formatting with a prefix tree.

A conversation becomes a path of turns; conversations that share initial turns share the nodes of these turns. The forest is
laid out depth-first: each node's tokens are emitted once, in one long sequence, with ``start`` (place in the sequence),
``position`` (position id of its first token: tokens of its ancestors) and ``ancestors`` (the intervals of the sequence that
its tokens may attend to besides earlier tokens of their own node).

The template marks turns with control strings; control strings (and backslashes) inside roles and texts are escaped, and
``parse`` reverses both exactly. Role and control strings, texts and ends are encoded separately by a lossless byte-level
tokenizer, so a node's loss interval ``[loss_from, loss_to)`` holds an assistant's text and nothing else.

A conversation is one row (its turns in order). Identical conversations become one before any sorting, a shared turn is a
group that is reduced to its first conversation by a partial aggregate, and the layout's offsets come from a range sort
with one subtotal per partition. So a first turn shared by a third of all conversations is one node and no hot task; nodes
are joined back to paths by a join whose skewed side adaptive execution splits.

Turns are ordered by ``turn`` (null first), then role and text; repeated rows are turns of their own. Null text or role is
empty. Rows with a null conversation id form one conversation. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import pick, running_total, stored

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
#: Strings that mean something to this or common other templates; none survives inside a formatted text.
CONTROLS = (TURN, BODY, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
TRAINED = "assistant"
_CONTROL = "|".join(f"(?<={re.escape(c[0])})(?={re.escape(c[1:])})" for c in CONTROLS)


def escape(text: Column) -> Column:
    """Backslashes are doubled, and one is put behind the first character of every control string."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit(_CONTROL), F.lit("\\\\"))


def unescape(text: Column) -> Column:
    """A doubled backslash is one; a single one was put in."""
    return F.regexp_replace(text, F.lit(r"\\(\\?)"), F.lit("$1"))


def head(role: Column) -> Column:
    return F.concat(F.lit(TURN), escape(role), F.lit(BODY))


def parse(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    parts = F.split(formatted, re.escape(TURN))
    turns = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))  # nothing stands before the first mark
    return F.transform(turns, lambda t: F.struct(
        unescape(F.substring_index(t, BODY, 1)).alias("role"),
        unescape(F.regexp_replace(F.substring_index(t, BODY, -1), re.escape(END) + r"\z", "")).alias("text")))


def conversations(rows: DataFrame) -> DataFrame:
    """conv_id, turns array<struct<role, text>>, path (a digest per turn of all turns up to it)."""
    turn = F.struct(F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                    F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    whole = (pick(rows, "conv_id", "turn", "role", "text").groupBy("conv_id")
             .agg(F.sort_array(F.collect_list(turn)).alias("turns"))
             .select("conv_id", F.transform("turns", lambda t: F.struct(t["role"], t["text"])).alias("turns")))
    chained = F.aggregate("turns", F.array().cast("array<string>"), lambda path, t: F.concat(path, F.array(F.md5(
        F.concat_ws("|", F.coalesce(F.try_element_at(path, F.lit(-1)), F.lit("")), F.md5(t["role"].cast("binary")), F.md5(t["text"].cast("binary"))).cast("binary")))))
    return whole.withColumn("path", chained)


ENCODED = "digest string, depth int, parent string, rank bigint, role string, ids array<int>, loss_from int, loss_to int, tokens int"


def encoder(tokenizer_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)
        tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text

        def ids(texts: list[str]) -> list[list[int]]:
            return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

        for batch in batches:
            heads, bodies = ids(batch.column("head").to_pylist()), ids(batch.column("body").to_pylist())
            tail = ids([END])[0]
            full = [h + b + tail for h, b in zip(heads, bodies)]
            trained = [r == TRAINED for r in batch.column("role").to_pylist()]
            loss_from = [len(h) for h in heads]
            loss_to = [len(h) + len(b) * t for h, b, t in zip(heads, bodies, trained)]
            keep = [batch.column(n) for n in ("digest", "depth", "parent", "rank", "role")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(full, pa.list_(pa.int32())), pa.array(loss_from, pa.int32()), pa.array(loss_to, pa.int32()),
                                              pa.array([len(x) for x in full], pa.int32())],
                                             names=["digest", "depth", "parent", "rank", "role", "ids", "loss_from", "loss_to", "tokens"])
    return run


def decoder(tokenizer_path: str):
    """(key, ids, loss_from, loss_to) to (key, text, loss_text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            cut = [x[a:b] for x, a, b in zip(ids, batch.column("loss_from").to_pylist(), batch.column("loss_to").to_pylist())]
            texts = [tokenizer.decode_batch(x, skip_special_tokens=False) for x in (ids, cut)]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), batch.column("depth"), *(pa.array(t, pa.string()) for t in texts)],
                                             names=["digest", "depth", "text", "loss_text"])
    return run


def prefix_forest(rows: DataFrame, tokenizer_path: str) -> tuple[DataFrame, DataFrame]:
    """The laid out nodes, and the conversations' paths through them.

    nodes: digest, depth, role, ids, start, tokens, position, loss_from, loss_to, ancestors array<struct<start, stop>>.
    paths: conv_id, path (digests from the root).
    """
    convs = stored(conversations(rows), "chat-conversations")
    paths = convs.select("conv_id", "path")
    distinct = convs.groupBy(F.element_at("path", -1).alias("leaf")).agg(F.first(F.struct("path", "turns")).alias("c")).select("leaf", "c.*")
    # depth-first order: conversations sorted by path; a node comes with the first conversation through it
    ranked = stored(running_total(distinct.withColumn("key", F.array_join("path", "")), [F.col("key")], F.lit(1), "rank", "chat-order").drop("key"), "chat-ranked")
    turns = ranked.select("rank", F.posexplode(F.arrays_zip("path", "turns")).alias("depth", "n"), "path").select(
        "rank", "depth", F.col("n.path").alias("digest"), F.get("path", F.col("depth") - 1).alias("parent"), F.col("n.turns").alias("turn"))
    nodes = turns.groupBy("digest").agg(F.min("rank").alias("rank"), F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.first("turn").alias("turn"))
    texts = nodes.select("digest", "depth", "parent", "rank", F.col("turn.role").alias("role"), head(F.col("turn.role")).alias("head"), escape(F.col("turn.text")).alias("body"))
    encoded = texts.mapInArrow(encoder(tokenizer_path), ENCODED)
    placed = stored(running_total(encoded, [F.col("rank"), F.col("depth")], F.col("tokens"), "start", "chat-layout"), "chat-nodes")
    # each node's ancestors, read off the first conversation through it
    spots = placed.select("digest", F.struct("start", (F.col("start") + F.col("tokens")).alias("stop")).alias("span"))
    first = ranked.select("rank", F.posexplode("path").alias("depth", "digest"))
    lines = (first.join(spots, "digest").groupBy("rank")
             .agg(F.transform(F.sort_array(F.collect_list(F.struct("depth", "span"))), lambda x: x["span"]).alias("spans")))
    above = F.slice("spans", F.lit(1), F.col("depth"))
    out = placed.join(lines, "rank").withColumn("ancestors", above).drop("spans")
    position = F.aggregate("ancestors", F.lit(0).cast("bigint"), lambda s, x: s + x["stop"] - x["start"])
    return out.withColumn("position", position).drop("rank"), paths


def read_back(nodes: DataFrame, paths: DataFrame, tokenizer_path: str) -> DataFrame:
    """conv_id, formatted and the text under the loss mask per conversation, decoded from the nodes' tokens."""
    decoded = stored(nodes.select("digest", "depth", "ids", "loss_from", "loss_to").mapInArrow(
        decoder(tokenizer_path), "digest string, depth int, text string, loss_text string"), "chat-decoded")
    along = stored(paths.select("conv_id", F.explode("path").alias("digest")), "chat-paths")
    joined = along.join(decoded, "digest")
    return (joined.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("depth", "text", "loss_text"))).alias("nodes"))
            .select("conv_id", F.array_join(F.transform("nodes", lambda n: n["text"]), "").alias("formatted"),
                    F.array_join(F.transform("nodes", lambda n: unescape(n["loss_text"])), "").alias("loss_text")))


def digest_turns(turns: Column) -> Column:
    """SHA-256 of role and text of each turn, a line each."""
    return F.sha2(F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256)
