"""The registered queries of the operators: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparqa.llm import ann, bpe, html, kdtree, license, minhash, mix, periodic, quality, spelling, suffix, tokencount, warc
from sparqa.llm.common import table
from sparqa.session import ship_package


def vocabulary_path() -> str:
    """The byte-level BPE file; installed on every machine like the libraries."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_balanced_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op2_warc_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(table(spark, sf_dir, "pages"))


def op3_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"))


def op4_block_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.report(table(spark, sf_dir, "documents"))


def op5_layout_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.report(table(spark, sf_dir, "documents"))


def op7_kd_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.report(table(spark, sf_dir, "documents"))


def op8_bpe_pair_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.report(table(spark, sf_dir, "documents"), vocabulary_path())


def op9_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(table(spark, sf_dir, "documents"), license.known_table(spark))


def op10_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.report(table(spark, sf_dir, "documents"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.report(table(spark, sf_dir, "documents"), vocabulary_path())


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.report(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def _shipped(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, sf_dir)
    run.__name__ = fn.__name__
    return run


QUERIES = {f.__name__: _shipped(f) for f in (
    op1_balanced_posting_lists, op2_warc_writer, op3_quality_cascade, op4_block_mix, op5_layout_text, op6_suffix_array_dedup,
    op7_kd_tree_shards, op8_bpe_pair_index, op9_license_digests, op10_circulant_minhash, op11_periodic_runs, op12_token_counts,
    op13_spelling_variants, pipeline)}
