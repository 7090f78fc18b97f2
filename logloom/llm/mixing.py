"""Mixing sources to target weights.

Every source gets a share of the tokens in proportion to its weight, at most ``max_repeats`` times what it has; what a
capped source cannot take goes to the others by weight. A source's repetition rate is its target over its size. A document
is emitted ``floor(rate)`` times, and once more if a seeded hash of its id and text falls below the rate's fraction.

Sizes are pre-aggregated per source before the shuffle, so a hot source costs one row per task; per-source targets come
back to the documents by a join whose skewed side adaptive execution splits. Targets are found by rounds of two sums over
the sources, never by collecting them.

Null text has size 0. A null source is a source of its own, after all others. Documents with a null or equal id draw by
their texts. In ``mix_plan`` rows with equal source, id and text draw by their number among these, 0, 1, 2 and so on:
which row has which number is of no account, so they are counted before the shuffle and written out again in pieces,
and a source that repeats one row comes near its target, too. ``mix_documents``, which keeps all columns, emits each such
row ``floor(rate)`` times and the further copies of all of them from the one with the smallest hash. A source of size 0
has target 0. Reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import WORD, dropped, pick, running_total, stored

CYCLE = (5.0, 2.0, 1.0)
PIECE = 4096  # equal rows written out by one task at a time


def word_count(column: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("bigint")


def cycle_weights(sources: DataFrame, cycle: tuple[float, ...] = CYCLE) -> DataFrame:
    """Adds ``weight``: the cycle's entries in turn, sources by code point, null last."""
    ranked = running_total(sources, [F.col("source")], F.lit(1), "_rank", "mix-sources")
    pick_weight = F.element_at(F.array(*map(F.lit, cycle)), (F.col("_rank") % len(cycle) + 1).cast("int"))
    return ranked.withColumn("weight", pick_weight).drop("_rank")


def with_targets(sources: DataFrame, max_repeats: float = 3.0, budget: float | None = None) -> DataFrame:
    """Adds ``target`` to (source, source_size, weight): the budget (all sizes) by weight, capped, the excess reshared.

    Every round fixes the sources above their cap, so it ends after as many rounds as there are steps of capping.
    """
    cap = F.col("source_size") * F.lit(float(max_repeats))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    budget = float(total if budget is None else budget)
    level = 0.0
    while True:
        over = cap <= F.col("weight") * F.lit(level)
        row = sources.agg(F.sum(F.when(over, cap).otherwise(0.0)).alias("fixed"),
                          F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("free")).first()
        if not row["free"]:
            break
        raised = (budget - row["fixed"]) / row["free"]
        if raised <= level * (1 + 1e-12):
            break
        level = raised
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(level), cap))


def source_sizes(docs: DataFrame) -> DataFrame:
    return docs.groupBy("source").agg(F.sum("size").alias("source_size"))


def with_rates(sized: DataFrame, max_repeats: float = 3.0, weights: DataFrame | None = None,
               budget: float | None = None) -> DataFrame:
    """``sized`` (source, size, ...) with source_size, target and ``rate``; ``weights`` (source, weight) or the cycle.

    A source absent from ``weights`` has weight 0.
    """
    sources = source_sizes(sized)
    if weights is None:
        weighted = cycle_weights(sources)
    else:
        given = pick(weights, "source", "weight").withColumnRenamed("source", "_s")
        weighted = sources.join(given, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").fillna({"weight": 0.0})
    kept = stored(weighted, "mix-weights")
    targets = with_targets(kept, max_repeats, budget).withColumnRenamed("source", "_s")
    joined = sized.join(targets, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s", "weight")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(max_repeats)))).otherwise(0.0)
    return joined.withColumn("rate", rate)


def text_key(text: Column) -> Column:
    return F.xxhash64(text)


def numbered(keyed: DataFrame, piece: int = PIECE) -> DataFrame:
    """The rows again, equal ones numbered from 0 as ``nth``.

    Equal rows meet as one row a task with their count; more than ``piece`` of them are written out by several tasks.
    """
    keys, n = keyed.columns, F.col("_n")
    counted = stored(keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), "mix-counted")  # else both branches read the texts
    few = counted.filter(n <= piece).select(*keys, F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("nth"))
    starts = F.sequence(F.lit(0).cast("bigint"), n - 1, F.lit(piece).cast("bigint"))
    many = (counted.filter(n > piece).select(*keys, "_n", F.explode(starts).alias("_from")).repartition(*keys, "_from")
            .select(*keys, F.explode(F.sequence(F.col("_from"), F.least(n, F.col("_from") + piece) - 1)).alias("nth")))
    return few.unionByName(many)


def copies(rate: Column, doc_id: Column, key: Column, nth: Column, seed: int) -> Column:
    """How often a document is emitted: floor(rate), and once more by a seeded hash of id, text key and number among equals."""
    whole = F.floor(rate)
    draw = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id, key, nth), 11)).cast("double") / F.lit(float(1 << 53))
    return whole + F.when(draw < rate - whole, 1).otherwise(0)


def mix_plan(docs: DataFrame, seed: int = 7, max_repeats: float = 3.0, weights: DataFrame | None = None) -> DataFrame:
    """doc_id, size, source_size, target, rate, copies, taken (words the mix takes, repeats counted), per document."""
    keyed = pick(docs, "doc_id", "source", "text").select("doc_id", "source", word_count().alias("size"), text_key(F.col("text")).alias("key"))
    sized = stored(numbered(keyed), "mix-sizes")
    planned = with_rates(sized, max_repeats, weights)
    times = copies(F.col("rate"), F.col("doc_id"), F.col("key"), F.col("nth"), seed)
    return (planned.withColumn("copies", times.cast("int")).drop("key", "nth")
            .withColumn("taken", (F.col("copies") * F.col("size")).cast("bigint")))


def mix_documents(docs: DataFrame, seed: int = 7, max_repeats: float = 3.0, weights: DataFrame | None = None) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with their columns unchanged."""
    names = docs.columns
    plain = docs.toDF(*(f"_{i}" for i in range(len(names))))
    sized = plain.withColumns({"source": F.col(f"_{names.index('source')}"), "_doc": F.col(f"_{names.index('doc_id')}"),
                               "size": word_count(f"_{names.index('text')}"), "_key": text_key(F.col(f"_{names.index('text')}"))})
    sources = stored(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-totals")
    weighted = cycle_weights(sources) if weights is None else (
        sources.join(pick(weights, "source", "weight").withColumnRenamed("source", "_s"),
                     F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").fillna({"weight": 0.0}))
    rates = with_targets(stored(weighted, "mix-weights"), max_repeats).select(
        F.col("source").alias("_s"), F.when(F.col("source_size") > 0, F.least(
            F.col("target") / F.col("source_size"), F.lit(float(max_repeats)))).otherwise(0.0).alias("_rate"))
    dropped(sources)
    keys = ["source", "_doc", "_key"]
    joined = sized.join(rates, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    many = stored(repeated_extras(sized.select(*keys), rates, seed), "mix-repeated")
    same = [F.col(k).eqNullSafe(F.col(f"_r{i}")) for i, k in enumerate(keys)]
    met = joined.join(many, same[0] & same[1] & same[2], "left")
    alone = copies(F.col("_rate"), F.col("_doc"), F.col("_key"), F.lit(0).cast("bigint"), seed)
    own = met.withColumn("_copies", F.when(F.col("_extra").isNull(), alone).otherwise(F.floor("_rate")))
    row = F.struct(*(F.col(f"_{i}") for i in range(len(names))))
    first = (joined.join(many, same[0] & same[1] & same[2], "inner").groupBy(*keys)
             .agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("_row"), F.max("_extra").alias("_copies")))
    taken = own.select(*(F.col(f"_{i}") for i in range(len(names))), "_copies").unionByName(
        first.select(*(F.col("_row")[f"_{i}"].alias(f"_{i}") for i in range(len(names))), "_copies"))
    pieces = F.sequence(F.lit(0).cast("bigint"), F.col("_copies") - 1, F.lit(PIECE).cast("bigint"))
    spread = taken.filter("_copies > 0").withColumn("_from", F.explode(pieces))
    return (spread.withColumn("_copy", F.explode(F.sequence(F.col("_from"), F.least("_copies", F.col("_from") + PIECE) - 1)))
            .select(*(F.col(f"_{i}") for i in range(len(names)))).toDF(*names))


def repeated_extras(keyed: DataFrame, rates: DataFrame, seed: int) -> DataFrame:
    """For rows equal in source, id and text key: (_r0, _r1, _r2, _extra), how many copies beyond floor(rate) all of them get."""
    drawn = numbered(keyed).join(rates, F.col("source").eqNullSafe(F.col("_s")), "left")
    more = copies(F.col("_rate"), F.col("_doc"), F.col("_key"), F.col("nth"), seed) - F.floor("_rate")
    return (drawn.groupBy(*(F.col(k).alias(f"_r{i}") for i, k in enumerate(keyed.columns)))
            .agg(F.count(F.lit(1)).alias("_n"), F.sum(more).cast("bigint").alias("_extra")).filter("_n > 1").drop("_n"))
