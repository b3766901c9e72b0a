"""A corpus from raw documents to token ids, stage by stage.

Each stage takes all that the one before kept, as a table read back from Parquet, and all
but the last return rows with the columns of ``documents``. The learned, hashed and drawn
parts have no SQL; tests compare each stage with a brute-force version.

Every stage sets small Arrow batches (``common.small_batches``) for the session; what it
returns is computed under them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from runmend.llm import exact_dedup, mixing, ngram_join, pieces, quality
from runmend.llm.common import small_batches, stored, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    small_batches(spark)
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def different_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with equal texts."""
    small_batches(spark)
    return exact_dedup.keep_first(docs)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words a shingle, similarity 0.8."""
    small_batches(spark)
    return ngram_join.keep_representatives(docs)


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their source takes them, in shards' random order."""
    small_batches(spark)
    return mixing.mixture(docs).select(*docs.columns)


def encoded_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in place of texts, and whether they decode to the text."""
    small_batches(spark)
    return pieces.encode_and_decode(docs, pieces.Vocabulary.read())


STAGES = [
    ("quality", good_documents),
    ("exact_dedup", different_documents),
    ("ngram_join", distinct_documents),
    ("mixing", mixed_documents),
    ("sentencepiece", encoded_documents),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
