"""The corpus pipeline: rules, classifier, near duplicates, packing, each over all that came before.

``STAGES`` names the stages in order. Every stage takes (spark, docs, sf_dir) and returns a
DataFrame that is written as Parquet and read again as the next one's ``docs``; all but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cadenza.llm import minhash_join, packing, quality_rules, weak_labels
from cadenza.llm.queries import BYTE_PATTERN, BYTE_RANKS, BYTE_TOKENIZER, PIECES
from cadenza.llm.tables import given, settle

#: Words of a shingle for near duplicates of the corpus; the similarity is 0.8.
SHINGLE_WORDS = 5


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no quality rule."""
    return quality_rules.keep_good(docs, PIECES)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier takes for good."""
    return weak_labels.keep_good(docs, given(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least id."""
    return minhash_join.keep_one(docs, width=SHINGLE_WORDS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, in windows of 1024 tokens."""
    return packing.pack_documents(docs, BYTE_RANKS, BYTE_PATTERN, BYTE_TOKENIZER)


STAGES = [
    ("quality_rules", rules), ("quality_classifier", classifier), ("near_dedup", near_dedup), ("packing", pack),
]

# Signatures, learnt bands and weights, and tokenising are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = given(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
