"""A corpus pipeline of five stages: each takes (spark, docs, sf_dir), and its result is written and read again for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import _base, exact_dedup, lang_id, near_dedup, packing, quality


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose main language is known and holds at least half of the words with letters.

    Null and empty texts, and texts without letters, go: they have no language. Repeated rows fare alike, all columns stay, an empty table gives none.
    """
    return lang_id.keep_identified(docs)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on what this stage is given, holds for good with a chance of half or more.

    Null and blank texts go: they have no score. Repeated rows fare alike, all columns stay, an empty table gives none.
    """
    return quality.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each set of equal texts, byte for byte: the one of the least doc_id.

    Null texts and null ids are equal to nothing and stay; of repeated rows one stays. All columns stay, an empty table gives none.
    """
    return exact_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of near copies: the one of the least doc_id.

    Texts without words, and rows with a null id, are groups of their own and stay; repeated rows all stay, or all go. All columns stay, an empty table gives none.
    """
    return near_dedup.keep_one(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where the ids that the byte BPE gives for each document lie in the windows of three context sizes.

    Null and empty texts have no ids and no rows. Repeated rows are packed as often as they come, told apart by ``copy``. An empty table gives no rows.
    """
    return packing.pack(docs, length=packing.token_lengths("text"))


STAGES = [("language", language), ("quality", good), ("exact_dedup", exact), ("near_dedup", near), ("packing", packed)]
#: Viterbi labels, trained weights and packing are beyond SQL; tests/llm/test_stages.py holds each stage's decisions against a version without Spark.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = _base.materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
