"""Inputs of the registered queries, derived by Spark from the driver's tables.

Each function takes ``(spark, sf_dir)`` and returns a lazy DataFrame over whole tables.
The mapping follows FIXTURES.md section 3 (question/answer pairs from conversations,
a scored result table from documents joined with labels, and so on).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparqa.session import spread

# The experiment grid of the reference (name, model family, use_rag, suffix).
EXPERIMENTS = [
    ("llama_with_rag", "llama", True, "llama_with_rag"),
    ("llama_without_rag", "llama", False, "llama_without_rag"),
    ("gpt_oss_with_rag", "gpt_oss", True, "gpt_oss_with_rag"),
    ("gpt_oss_without_rag", "gpt_oss", False, "gpt_oss_without_rag"),
]
METRICS = ["context_precision", "context_recall", "faithfulness", "answer_relevancy"]
BERT_METRICS = ["bertscore_precision", "bertscore_recall", "bertscore_f1"]


#: Row numbers a conversation has in ``row_id``: more turns than one can hold.
QA_ROW = 1 << 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document texts ``(doc_id, text)``, spread over the cores when the file is one split."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as questions ``(qid, question)``."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"),
                                                    F.col("text").alias("question"))


def qa_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(row_id, question, answer)``: a user turn and the next turn when it is the assistant's, else NULL.

    An equi-join on ``(conv_id, turn + 1)`` rather than a window over a conversation,
    so one huge conversation does not land in one task.
    """
    c = table(spark, sf_dir, "conversations")
    u = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    a = c.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return u.join(a, ["conv_id", "turn"], "left").select(
        (F.col("conv_id") * QA_ROW + F.col("turn")).alias("row_id"), "question", "answer")


def experiment_configs(spark: SparkSession) -> DataFrame:
    """The four-row config table, in the reference's order (``ord``)."""
    return spark.createDataFrame(
        [(i, n, m, r, s) for i, (n, m, r, s) in enumerate(EXPERIMENTS)],
        "ord int, name string, generator_model string, use_rag boolean, output_suffix string")


def config_array():
    """The same grid as an array literal, for ``explode`` (no join needed)."""
    return F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(n).alias("experiment"),
                              F.lit(m).alias("generator_model"), F.lit(r).alias("use_rag"),
                              F.lit(s).alias("output_suffix"))
                     for i, (n, m, r, s) in enumerate(EXPERIMENTS)])


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page-text stand-in ``(doc_id, page_no, text)``: conversation = document, turn = page."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page_no"), "text")


def scored_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored result table with natural gaps (documents left-joined with labels)."""
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels")
    j = d.join(lab, "doc_id", "left")
    return j.select(
        F.col("doc_id").alias("row_id"),
        F.col("text").alias("question"),
        F.col("source").alias("answer"),
        F.col("lang").alias("experiment"),
        F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.concat(F.col("source"), F.lit(": "), F.col("text")))
         .alias("generated_answer"),
        F.when(F.col("doc_id") % 5 == 0, F.lit("[]"))
         .otherwise(F.concat(F.lit("['"), F.col("source"), F.lit("', '"), F.col("lang"), F.lit("']")))
         .alias("retrieved_contexts"),
        F.col("quality").cast("double").alias("context_precision"),
        F.when(F.col("doc_id") % 7 == 0, F.lit(None).cast("double"))
         .otherwise((F.col("n_chars") % 100) / 100.0).alias("context_recall"),
        F.col("toxic").cast("double").alias("faithfulness"),
        F.when(F.col("doc_id") % 11 == 0, F.lit(None).cast("double"))
         .otherwise((F.col("n_chars") % 10) / 10.0).alias("answer_relevancy"),
    )


def second_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second scoring run of the same rows; metrics recomputed from the key, some still NULL."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("row_id"),
        F.col("text").alias("question"),
        F.col("source").alias("answer"),
        F.col("lang").alias("experiment"),
        ((F.col("doc_id") % 4) / 4.0).alias("context_precision"),
        F.when(F.col("doc_id") % 13 == 0, F.lit(None).cast("double"))
         .otherwise((F.col("doc_id") % 9) / 9.0).alias("context_recall"),
        ((F.col("doc_id") % 2) * 1.0).alias("faithfulness"),
        F.when(F.col("doc_id") % 17 == 0, F.lit(None).cast("double"))
         .otherwise((F.col("doc_id") % 5) / 5.0).alias("answer_relevancy"),
    )


def template_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1-D4 input: questions in the clinical template, one per document.

    ``question = 'Pasien dengan <source> dan diagnosis medis: <lang>. Jelaskan <type>?'``
    with the type chosen by ``doc_id % 8``; the reference answer is the whole document, stripped.
    """
    from sparqa.functions.text import strip
    from sparqa.operators.insight import QUESTION_TYPES

    d = table(spark, sf_dir, "documents")
    names = F.array(*[F.lit(n) for n, _ in QUESTION_TYPES])
    return d.select(
        F.col("doc_id").alias("row_id"),
        F.concat(F.lit("Pasien dengan "), F.col("source"), F.lit(" dan diagnosis medis: "), F.col("lang"),
                 F.lit(". Jelaskan "), F.element_at(names, (F.col("doc_id") % 8 + 1).cast("int")),
                 F.lit("?")).alias("question"),
        F.coalesce(strip(F.col("text")), F.lit("")).alias("answer"))


def entity_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C6 entity table ``(surface, label)``: capitalised words of the benchmark, and such words with the word after them."""
    b = table(spark, sf_dir, "benchmark")

    def found(pattern: str) -> DataFrame:
        return b.select(F.explode(F.regexp_extract_all("text", F.lit(pattern), 0)).alias("surface"))
    names = found(r"\p{Lu}\p{L}+")
    names = names.withColumn("label", F.when(F.length("surface") < 4, F.lit("SHORT")).otherwise(F.lit("NAME")))
    return names.unionByName(found(r"\p{Lu}\p{L}+ \p{L}+").withColumn("label", F.lit("PHRASE")))


def keyed_results(df: DataFrame) -> DataFrame:
    """A result table whose merge keys (question, answer, experiment) are unique together, each of them NULL in some rows."""
    i, mark = F.col("row_id"), F.concat(F.lit(" #"), F.col("row_id").cast("string"))
    return df.withColumns({
        "question": F.when(i % 9 == 0, F.lit(None).cast("string")).when(i % 10 == 0, F.concat("question", mark)).otherwise(F.col("question")),
        "answer": F.when((i % 10 == 0) & (i % 9 != 0), F.lit(None).cast("string")).otherwise(F.concat("answer", mark)),
        "experiment": F.when(i % 8 == 0, F.lit(None).cast("string")).otherwise(F.col("experiment"))})


def earlier_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as they were before: a tenth not there yet, a seventh with another text, and some that are gone now."""
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    old = d.where(i % 10 != 3).select("doc_id", F.when(i % 7 == 0, F.concat(F.lit("Draft. "), "text")).otherwise(F.col("text")).alias("text"))
    return old.unionByName(d.where(i % 11 == 0).select((i + 10 ** 9).alias("doc_id"), "text"))


def document_versions(spark: SparkSession, sf_dir: str, version: int) -> DataFrame:
    """Versions of the documents as a stream brings them: 1 for all, 2 for two thirds with their final text, some without one."""
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    v = F.lit(version).cast("bigint").alias("version")
    if version == 1:
        return d.select("doc_id", v, F.concat(F.lit("Draft. "), "text").alias("text"))
    return d.where(i % 3 != 0).select("doc_id", v, F.when(i % 13 != 0, F.col("text")).alias("text"))
