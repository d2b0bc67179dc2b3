"""Five stages that turn documents into packed training sequences.

language    drops documents in no language (null texts and texts without letters)
exact       of equal texts keeps the one with the largest doc_id
near        of each group of linked near copies keeps the one with the smallest doc_id
mix         repeats or leaves out documents so that sources meet their target weights
pack        cuts what is left into sequences; one row per piece

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() applies
them to documents, writing each result to the shared folder before the next
stage reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cadastra.llm import exact_dedup, jaccard, langid, mixing, packing
from cadastra.llm.common import materialize, table
from cadastra.llm.queries import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accepted(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.representatives(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES = [("language", language), ("exact", exact), ("near", near), ("mix", mix), ("pack", pack)]

#: SQL can express neither the learned language nor the packing; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
