"""The registered queries of this package, each over its whole table, with SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import (ball_tree, chat, host_rules, mixing, packing, piece_bpe, pii, prefix_trie, simhash, suffix_tree, token_counts, toxicity,
                         whitening)
from logloom.llm.common import table

#: Files of public tokenizers; a user may put own files in their place.
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
PATTERN = public_tokenizers.PATTERN


def remainder(divisor: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), WORD_TOKENIZER)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], rows.schema)
    nodes, paths = chat.prefix_forest(rows.unionByName(own), BYTE_TOKENIZER)
    back = chat.read_back(nodes, paths, BYTE_TOKENIZER).withColumn("turns", chat.parse(F.col("formatted")))
    return back.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), chat.digest_turns(F.col("turns")).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"))


def _occurrences(column: str, text: str) -> str:
    return f"(length({column}) - length(replace({column}, '{text}', ''))) // {len(text)}"


def _escaped_length(column: str) -> str:
    return " + ".join([f"length({column})", _occurrences(column, "\\"), *(_occurrences(column, c) for c in chat.CONTROLS)])


OP2_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum({len(chat.TURN + chat.BODY + chat.END)} + {_escaped_length('role')} + {_escaped_length('text')}) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id"""


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("edits", token_counts.hashed_edits(F.col("doc_id"), F.coalesce(F.length("text"), F.lit(0))))
    trees = token_counts.build_trees(docs, BYTE_RANKS, PATTERN)
    edited = token_counts.apply_edits(trees, BYTE_RANKS, PATTERN)
    return edited.withColumn("edited_crc32", F.crc32(F.col("text").cast("binary"))).drop("text")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.find_personal_data(docs, pii.fit(docs))

    def listed(column: str):
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")

    def counted(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [counted(kind) for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed("found").alias("spans"))


def op6_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score_documents(table(spark, sf_dir, "documents"), remainder(10) == 0)


def op7_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.top_k(table(spark, sf_dir, "embeddings"))


OP7_SQL = """
WITH v AS (SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e
           FROM embeddings WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= 10"""


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", simhash.hexadecimal().alias("fingerprint"), "component_id")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), remainder(5) != 0)
    scored = toxicity.score_documents(docs, model)
    return scored.select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ruled = host_rules.apply_host_rules(table(spark, sf_dir, "documents"))
    return ruled.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP10_SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
g AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, i + unnest([0, 1, 2]) AS p FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, l FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM lines GROUP BY doc_id),
c AS (SELECT w.doc_id, w.source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN covered USING (doc_id)),
f AS (SELECT *, n_words < {host_rules.MIN_WORDS} OR 100 * n_repeat_words > {host_rules.MAX_REPEATED} * n_words AS base_failed FROM c),
hosts AS (SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(sum(CAST(base_failed AS INT)) AS DOUBLE) AS x FROM f GROUP BY source),
sums AS (SELECT count(*) AS k, sum(n) AS n1, sum(x) / sum(n) AS m, sum(n * n) AS n2, sum(x * x / n) AS f2 FROM hosts),
fit AS (SELECT m, CASE WHEN n1 - n2 / n1 - (k - 1) > 0 THEN ((f2 - n1 * m * m) - (k - 1) * m * (1 - m)) / (n1 - n2 / n1 - (k - 1)) END AS v FROM sums),
prior AS (SELECT m, CASE WHEN v > 0 THEN greatest(m * (1 - m) / v - 1, 0) END AS s FROM fit),
verdict AS (SELECT source, CASE WHEN s IS NULL THEN m ELSE (x + m * s) / (n + s) END
            > least({host_rules.HOST_LIMIT}, CASE WHEN s IS NULL THEN 1 ELSE m + {host_rules.DEVIATIONS} * sqrt(m * (1 - m) / (s + 1)) END) AS bad FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT bad AS kept
FROM f JOIN verdict ON f.source IS NOT DISTINCT FROM verdict.source"""


def op11_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = piece_bpe.encode_texts(table(spark, sf_dir, "documents"), PIECE_MODEL, ["doc_id"])
    digest = F.sha2("ids", 256).alias("ids_sha256")
    back = piece_bpe.decode_ids(coded.select("doc_id", "n_tokens", "ids", digest), PIECE_MODEL, ["doc_id", "n_tokens", "ids_sha256"])
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.ordered_turns(table(spark, sf_dir, "conversations"))
    return prefix_trie.build_trie(*prefix_trie.with_shared_openings(turns))


OP13_SQL = """
WITH o AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, digest) AS p, digest, bytes FROM (
    SELECT conv_id AS c, turn, strlen(coalesce(text, '')) AS bytes,
           sha256(concat(strlen(coalesce(role, '')), ':', role, text)) AS digest FROM conversations WHERE conv_id IS NOT NULL)),
n AS (SELECT c, count(*) AS own FROM o GROUP BY c),
hidden AS (SELECT c, own, c - c % 5 AS base, xor(list_reduce(list_concat([4294967295], [ascii(x) FOR x IN string_split(CAST(c AS VARCHAR), '')]),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0],
      lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 9 AS h FROM n),
convs AS (SELECT hidden.c, h, base, least(h, coalesce(n.own, 0)) AS lent FROM hidden LEFT JOIN n ON n.c = base),
turns AS (SELECT c, lent + p - h AS d, digest, bytes FROM o JOIN convs USING (c) WHERE p > h
          UNION ALL SELECT convs.c, p, digest, bytes FROM o JOIN convs ON o.c = base WHERE p <= h),
q AS (SELECT c, 0 AS d, '' AS k, 0 AS bytes FROM convs
      UNION ALL SELECT c, d, sha256(string_agg(digest, ',') OVER (PARTITION BY c ORDER BY d)), bytes FROM turns),
node AS (SELECT d, k, min(c) AS conv_id, count(*) AS n, any_value(bytes) AS bytes FROM q GROUP BY d, k),
up AS (SELECT DISTINCT a.d, a.k, b.k AS parent FROM q a JOIN q b ON a.c = b.c AND b.d = a.d - 1),
children AS (SELECT d - 1 AS d, parent AS k, count(*) AS n_children FROM up GROUP BY d, parent),
below AS (SELECT DISTINCT a.d, a.k, b.d AS bd, b.k AS bk FROM q a JOIN q b ON a.c = b.c AND b.d >= a.d),
sums AS (SELECT below.d, below.k, count(*) FILTER (children.k IS NULL) AS n_leaves, sum((n - 1) * bytes) AS saved
         FROM below JOIN node ON node.d = bd AND node.k = bk LEFT JOIN children ON children.d = bd AND children.k = bk GROUP BY below.d, below.k),
ends AS (SELECT d, k, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM (SELECT c, max(d) AS d, arg_max(k, d) AS k FROM q GROUP BY c) GROUP BY d, k)
SELECT node.conv_id, CAST(node.d AS BIGINT) AS depth, above.conv_id AS parent_conv_id, n AS n_convs, coalesce(n_children, 0) AS n_children,
       n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM (SELECT node.*, parent FROM node LEFT JOIN up USING (d, k)) node LEFT JOIN (SELECT d AS ad, k AS ak, conv_id FROM node) above ON ad = node.d - 1 AND ak = parent
LEFT JOIN children ON children.d = node.d AND children.k = node.k JOIN sums ON sums.d = node.d AND sums.k = node.k
LEFT JOIN ends ON ends.d = node.d AND ends.k = node.k"""

QUERIES = {f.__name__: f for f in (op1_packing, op2_chat, op3_token_counts, op4_mixing, op5_pii, op6_suffix_tree, op7_ball_tree, op8_simhash,
                                   op9_toxicity, op10_host_rules, op11_piece_bpe, op12_whitening, op13_prefix_trie)}
ORACLES = {"op2_chat": OP2_SQL, "op7_ball_tree": OP7_SQL, "op10_host_rules": OP10_SQL, "op13_prefix_trie": OP13_SQL}
