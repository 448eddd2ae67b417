"""The corpus pipeline: quality, near copies, secrets, mixture, packing; each stage is written and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallywell.llm import boosting, mixing, packing, randomness, sketch_dedup
from tallywell.llm.common import table

#: Word shingles and similarity of the near-copy stage.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80
#: What a sequence may hold: tokens, pieces of documents, and attention cost (the sum of the squared lengths of its pieces). Pieces are at most
#: half a sequence, so that the cost of a sequence stays at three eighths of what one document of its length would cost.
SEQUENCE_TOKENS, SEQUENCE_DOCUMENTS, PIECE_TOKENS = 2048, 24, 1024
SEQUENCE_COST = 3 * PIECE_TOKENS**2 // 2


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labels that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return boosting.good_documents(docs, boosting.fitted(docs, labels))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id."""
    return sketch_dedup.first_of_each(docs, SHINGLE_WORDS, SIMILAR_PERCENT)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in their texts are replaced by a mark."""
    return randomness.without_secrets(docs)


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of each document in sequences under every capacity; a document taken twice is packed twice."""
    return packing.packed(docs, SEQUENCE_TOKENS, SEQUENCE_DOCUMENTS, SEQUENCE_COST, PIECE_TOKENS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_copies", dedup_stage),
    ("secrets", secrets_stage),
    ("mixture", mixture_stage),
    ("packing", packing_stage),
]

#: Trees, sketches and tokens are not SQL; tests/llm/test_pipeline.py compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), name)
    return docs
