"""Question-level insight (D1-D4): template parsing, question type, RAG deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparqa.functions.text import col_of

# The question template and the eight question types (name, keyword).
TEMPLATE_PATTERN = r"^Pasien dengan (.*?) dan diagnosis medis: (.*?)\. (.*)\?$"
QUESTION_TYPES = [
    ("Skrining Gizi", "skrining gizi"),
    ("Status Gizi", "status gizi"),
    ("Data Biokimia", "biokimia"),
    ("Diagnosis Gizi (PES)", "diagnosis gizi"),
    ("Tujuan Diet", "tujuan diet"),
    ("Prinsip Diet", "prinsip diet"),
    ("Syarat Diet", "syarat diet"),
    ("Pedoman Diet", "pedoman diet"),
]
UNKNOWN_TYPE = "Lainnya"


def parse_question(q: Column | str) -> Column:
    """``struct<assessment, diagnosis, ask>`` from the template (NULLs when it does not fit)."""
    c = col_of(q)
    fits = c.rlike(TEMPLATE_PATTERN)
    return F.struct(*[F.when(fits, F.regexp_extract(c, TEMPLATE_PATTERN, i + 1)).alias(n)
                      for i, n in enumerate(["assessment", "diagnosis", "ask"])])


def question_type(q: Column | str) -> Column:
    """First of the eight types whose keyword occurs (case-insensitive); else Lainnya."""
    low = F.lower(col_of(q))
    out = None
    for name, kw in QUESTION_TYPES:
        cond = F.instr(low, kw) > 0
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out.otherwise(F.lit(UNKNOWN_TYPE))


def rag_delta(scored: DataFrame, type_col: str = "question_type", model_col: str = "generator_model",
              rag_col: str = "use_rag", score_col: str = "bertscore_f1") -> DataFrame:
    """D3: mean score with minus without retrieval, per question type and model.

    A pivot on the two ``use_rag`` values (given explicitly, so no extra pass).
    """
    p = scored.groupBy(type_col, model_col).pivot(rag_col, [True, False]).agg(F.avg(score_col))
    return p.select(type_col, model_col, F.col("true").alias("mean_with_rag"),
                    F.col("false").alias("mean_without_rag"),
                    (F.col("true") - F.col("false")).alias("rag_delta"))


def retrieval_quality(scored: DataFrame, type_col: str = "question_type", model_col: str = "generator_model",
                      rag_col: str = "use_rag", score_col: str = "bertscore_f1") -> DataFrame:
    """D3 + D4 from one pass: per (type, model) the RAG delta, next to the mean context
    precision / recall of the type's retrieval rows.

    One grouped aggregate over the scored rows keeps sums and counts; the per-type means
    are window sums over that small result (types x models rows), so the scored rows are
    read once and nothing joins back.
    """
    rag = F.col(rag_col)
    g = scored.groupBy(type_col, model_col).agg(
        F.avg(F.when(rag, F.col(score_col))).alias("mean_with_rag"),
        F.avg(F.when(~rag, F.col(score_col))).alias("mean_without_rag"),
        F.sum(F.when(rag, F.col("context_precision"))).alias("_cp_s"),
        F.count(F.when(rag, F.col("context_precision"))).alias("_cp_n"),
        F.sum(F.when(rag, F.col("context_recall"))).alias("_cr_s"),
        F.count(F.when(rag, F.col("context_recall"))).alias("_cr_n"))
    w = Window.partitionBy(type_col)
    return g.select(
        type_col, model_col, "mean_with_rag", "mean_without_rag",
        (F.col("mean_with_rag") - F.col("mean_without_rag")).alias("rag_delta"),
        (F.sum("_cp_s").over(w) / F.sum("_cp_n").over(w)).alias("mean_context_precision"),
        (F.sum("_cr_s").over(w) / F.sum("_cr_n").over(w)).alias("mean_context_recall"))
