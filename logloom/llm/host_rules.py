"""Quality rules with host-level verdicts, in DataFrame functions only.

Each document gets counts and a base verdict from its own text. Failures are then aggregated per host (``source``), each
host's failure rate is shrunk towards all hosts' by a beta prior fitted to the hosts themselves (method of moments, hosts
weighted by their documents). A host whose shrunken rate lies more than ``deviations`` standard deviations of that prior above
its mean, or above ``host_limit``, fails all its documents. Hosts that differ by chance only have no such limit but the last.

Failures are pre-aggregated before the shuffle; the fit is one row of sums over hosts; verdicts return to the documents by
a join on the host whose skewed side adaptive execution splits, over a stored table of counts (no text is shuffled).

Null or empty text has no words and fails the base rule. A null source is a host of its own. Repeated rows count each.
Texts of any length are read whole. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import BLANK, let, pick, stored, words_of

MIN_WORDS = 50
MAX_REPEATED = 50  # percent
HOST_LIMIT = 0.8
DEVIATIONS = 3.0  # of the fitted prior
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 3


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def window_hashes(words: Column, size: int = WINDOW) -> Column:
    """A 64-bit hash per window of ``size`` words, in order; empty for fewer words."""
    def at(starts: Column) -> Column:
        return F.transform(starts, lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(size))))
    return F.when(F.size(words) < size, F.array().cast("array<bigint>")).otherwise(
        at(F.sequence(F.lit(0), F.size(words) - size)))


def repeated_words(hashes: Column, size: int = WINDOW) -> Column:
    """How many words lie in windows that occur more than once. Sorted (hash, place) pairs put equal windows side by side."""
    def covered(pairs: Column) -> Column:
        twice = F.filter(pairs, lambda x, i: (x["h"] == F.get(pairs, i - 1)["h"]) | (x["h"] == F.get(pairs, i + 1)["h"]))
        places = F.transform(twice, lambda x: x["i"])
        spread = F.flatten(F.transform(places, lambda i: F.sequence(i, i + (size - 1))))
        return F.size(F.array_distinct(spread))
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(pairs, covered))


def document_counts(docs: DataFrame) -> DataFrame:
    """doc_id, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words per document."""
    texts = pick(docs, "doc_id", "source", "text").withColumn("text", F.coalesce("text", F.lit("")))
    split = texts.withColumn("words", words_of("text"))
    hashed = split.withColumn("hashes", window_hashes(F.col("words")))
    return hashed.select(
        "doc_id", "source", F.size("words").cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        duplicate_lines(F.col("text")).cast("bigint").alias("n_dup_lines"),
        repeated_words(F.col("hashes")).cast("bigint").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def host_verdicts(counts: DataFrame, host_limit: float = HOST_LIMIT, deviations: float = DEVIATIONS) -> DataFrame:
    """source, documents, failures, shrunken rate and ``host_failed``, from (source, base_failed) rows.

    The prior Beta(a, b) matches the mean m and the variance v between hosts: a + b = m (1 - m) / v - 1 after the
    binomial part of the spread is taken off. Without spread between hosts every host gets the overall rate.
    """
    hosts = counts.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("base_failed").cast("bigint")).alias("failures"))
    n, f = F.col("documents"), F.col("failures")
    sums = hosts.agg(F.count("*").alias("k"), F.sum("documents").alias("n1"), F.sum("failures").alias("f1"),
                     F.sum(n * n).alias("n2"), F.sum(f * f / n).alias("f2"))
    m = F.when(F.col("n1") > 0, F.col("f1") / F.col("n1")).otherwise(0.0)
    fitted = sums.select("k", m.alias("m"), "n1", "n2", (F.col("f2") - F.col("n1") * m * m).alias("spread"))
    within = (F.col("k") - 1) * F.col("m") * (1 - F.col("m"))
    scale = F.col("n1") - F.col("n2") / F.col("n1") - (F.col("k") - 1)
    between = F.when(scale > 0, (F.col("spread") - within) / scale)
    strength = F.when(between > 0, F.greatest(F.col("m") * (1 - F.col("m")) / between - 1, F.lit(0.0)))
    prior = fitted.select("m", strength.alias("strength"))  # one row
    rate = F.when(F.col("strength").isNull(), F.col("m")).otherwise(
        (F.col("failures") + F.col("m") * F.col("strength")) / (F.col("documents") + F.col("strength")))
    spread = F.sqrt(F.col("m") * (1 - F.col("m")) / (F.col("strength") + 1))  # standard deviation of the prior
    limit = F.least(F.lit(host_limit), F.col("m") + deviations * spread)  # least() leaves a null out
    return (hosts.join(F.broadcast(prior)).withColumn("host_rate", rate)
            .select("source", "documents", "failures", "host_rate", (F.col("host_rate") > limit).alias("host_failed")))


def apply_host_rules(docs: DataFrame, host_limit: float = HOST_LIMIT, deviations: float = DEVIATIONS) -> DataFrame:
    """The counts of each document with base_failed, host_rate and kept."""
    counts = stored(document_counts(docs).withColumn("base_failed", base_failed()), "host-counts")
    verdicts = host_verdicts(counts, host_limit, deviations).select(F.col("source").alias("_s"), "host_rate", "host_failed")
    joined = counts.join(verdicts, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed")).drop("host_failed")
