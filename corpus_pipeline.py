"""Corpus pipeline: quality rules, near-duplicates, repeated passages, source mix, tokens.

Each stage takes (spark, docs, sf_dir), works on everything its predecessor kept, and returns a DataFrame that is
written as Parquet and read again as the next one's docs. All but the last return the columns of ``documents``.
NULL texts have no words and are rejected by the first stage; an empty table passes through every stage. Rows that share an id are rows
of their own to the quality rules and the mix; to the near-duplicate stage they are one document, all or none of which stays, and they never
remove each other's passages. Texts of any length are worked on whole; NULLs in other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparqa.llm import bpe, minhash, mix, quality, suffix
from sparqa.llm.common import stored, table
from sparqa.llm.queries import vocabulary_path
from sparqa.session import ship_package


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that every quality rule passes."""
    ship_package(spark)
    return quality.quality_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8)."""
    ship_package(spark)
    return minhash.drop_near_duplicates(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document with a smaller id holds as well."""
    ship_package(spark)
    return suffix.remove_repeats(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The blocks that the mix draws, as pieces of documents; repeats are rows of their own."""
    ship_package(spark)
    return mix.mixed_documents(docs, block_words=PIPELINE_BLOCK_WORDS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of every piece."""
    ship_package(spark)
    return bpe.report(docs, vocabulary_path())


#: Words in a block of the mix; a training sequence.
PIPELINE_BLOCK_WORDS = 512

STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("tokens", tokens),
]

#: Drawing by hash and BPE are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
