"""A cleaning pipeline over `documents`: language, quality, near-duplicates, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir); what it returns is written as Parquet and read again as the next one's docs. All
but the last return the columns of documents. The last one's rows are the packed pieces.

Edge cases: null and empty texts, and texts without letters, go in the first stage; null ids, languages and sources are kept
and travel on; repeated rows get one decision, and the third stage keeps one row of them; of equal ids in a group the
first row stays; extra columns pass all stages but the last, whatever their names; empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pulsemill.llm import curve_packing, decontamination, language_id, quality_classifier, simhash_dedup
from pulsemill.llm.common import stored, table, workspace


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without an identifiable language."""
    return language_id.kept(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality classifier rejects; it learns from the labelled ones among them."""
    return quality_classifier.kept(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the smallest id of each group of near-duplicates."""
    return simhash_dedup.keep_one(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold ten consecutive words of a benchmark item."""
    return decontamination.kept(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences along the curve."""
    return curve_packing.pack(docs)


STAGES = [
    ("language", language),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("benchmark_passages", benchmark_passages),
    ("packing", packing),
]

#: Trained models and tokenizers can't be expressed in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with workspace(spark):  # what a stage needs on its way goes with it
            docs = stored(stage(spark, docs, sf_dir), f"stage-{name}", outer=True)
    return STAGES[-1][1](spark, docs, sf_dir)
