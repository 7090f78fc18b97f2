"""From documents to packed training sequences: toxicity, near-duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all but the last return the columns of
``documents``. Removed rows are gone from all later stages, masked texts and repeated documents are what later stages see.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logloom.llm import mixing, packing, pii, simhash, similar, toxicity
from logloom.llm.common import stored, table
from logloom.llm.queries import WORD_TOKENIZER, remainder


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), remainder(5) != 0)
    return toxicity.keep_clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.dedupe(docs)


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-identical fingerprints first, then what shares at least 0.8 of its five-word shingles; one numbering serves both."""
    names = docs.columns
    text, doc = (f"_{names.index(c)}" for c in ("text", "doc_id"))
    distinct = simhash.firsts(simhash.fingerprinted(docs), doc)
    return similar.firsts(distinct, text, doc).select(*(f"_{i}" for i in range(len(names)))).toDF(*names)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.mask(docs, pii.fit(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, WORD_TOKENIZER)


STAGES = [("toxicity", reject_toxic), ("near_duplicates", drop_similar), ("personal_data", mask_personal_data),
          ("mixing", mix_sources), ("packing", pack)]

#: No SQL expresses a trained model or a tokenizer; tests/llm checks the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
