"""From raw documents to packed training pieces.

Each stage takes (spark, docs, sf_dir) and works on all documents its predecessor kept. All but the
last return the columns of ``documents``; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from punctual.llm import language, mixing, neardup, packing, quality_rules
from punctual.llm.storage import stored


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or are far from every language's reference."""
    return quality_rules.kept_documents(docs)


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter or without a certain language."""
    return language.certain_documents(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves one document of each near-duplicate class."""
    return neardup.deduplicated(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and cuts sources to their target weights."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts documents into sequences of power-of-two lengths."""
    return packing.pack(docs)


STAGES = [("quality_rules", rules), ("language_id", languages), ("near_dedup", dedup), ("mixing", mix), ("packing", pack)]

#: Sampling, Viterbi paths and a tokenizer are beyond SQL; a brute-force version checks the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
