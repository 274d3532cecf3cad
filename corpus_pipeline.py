"""Corpus preparation in stages, each over all that the stage before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from ledgerloom.llm.decontamination import without_passages
from ledgerloom.llm.frames import table
from ledgerloom.llm.jaccard_join import one_of_each_class
from ledgerloom.llm.packing import pack, word_count
from ledgerloom.llm.pii import without_pii
from ledgerloom.llm.toxicity import without_toxic
from ledgerloom.session import stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier rejects."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of copies and near copies."""
    return one_of_each_class(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold benchmark passages."""
    return without_passages(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask personal data."""
    return without_pii(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length buckets and batches of what is left."""
    return pack(docs, word_count(F.col("text")), tie=F.xxhash64("text"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("pii", pii),
    ("packing", packing),
]

#: SQL can't express the classifier or the bucket boundaries; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet and read again.

    Stages keep nulls, repeated rows and further columns as their operators say; empty tables pass.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
