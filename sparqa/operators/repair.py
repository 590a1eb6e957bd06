"""Repair of missing metrics, keyed merge and failure diagnosis (Q1-Q12).

Missing = SQL NULL or NaN. Rows are matched by key (``row_id`` or the merge keys),
never by position.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparqa.functions.text import strip
from sparqa.sources.results import REPAIR_REQUIRED, require_columns

METRICS = ["context_precision", "context_recall", "faithfulness", "answer_relevancy"]
# Default target metrics of a repair run (context_precision is not one).
DEFAULT_TARGETS = ["context_recall", "faithfulness", "answer_relevancy"]
MERGE_KEYS = ["question", "answer", "experiment"]
# Context cells that count as "no contexts" in the diagnosis.
EMPTY_CONTEXT_CELLS = ["[]", "", "nan"]


def missing(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isNull() | F.isnan(c)


def prepare(df: DataFrame, targets: list[str] = DEFAULT_TARGETS) -> DataFrame:
    """Q1 + Q2: required columns checked; absent target metrics added as all-missing."""
    require_columns(df, REPAIR_REQUIRED, "Repair input")
    for m in targets:
        if m not in df.columns:
            df = df.withColumn(m, F.lit(None).cast("double"))
    return df


def nan_counts(df: DataFrame, targets: list[str] = DEFAULT_TARGETS) -> DataFrame:
    """Q3: one pass: total rows, target rows (any target missing), missing count per target."""
    any_missing = F.lit(False)
    for m in targets:
        any_missing = any_missing | missing(m)
    return df.agg(F.count(F.lit(1)).alias("total_rows"),
                  F.count_if(any_missing).alias("target_rows"),
                  *[F.count_if(missing(m)).alias(f"missing_{m}") for m in targets])


def select_targets(df: DataFrame, targets: list[str] = DEFAULT_TARGETS) -> DataFrame:
    """Q4: rows with any target metric missing (a pushed-down filter)."""
    cond = F.lit(False)
    for m in targets:
        cond = cond | missing(m)
    return df.where(cond)


def repair(df: DataFrame, rescore: Callable[[DataFrame], DataFrame], key: str = "row_id",
           targets: list[str] = DEFAULT_TARGETS) -> DataFrame:
    """Q5 + Q6: re-score only the target rows (always as RAG) and overwrite all four
    metrics on them, even values that existed, even with missing ones.

    ``rescore`` maps the target rows to ``(key, <metrics it computed>)``. With no target
    rows the join side is empty and the input comes back unchanged (Q5).
    """
    df = prepare(df, targets)
    tgt = select_targets(df, targets)
    new = rescore(tgt)
    present = [m for m in METRICS if m in new.columns]
    new = new.select(key, *[F.col(m).alias(f"{m}__new") for m in present]) \
             .withColumn("__hit", F.lit(True))
    j = df.join(new, on=key, how="left")
    for m in present:
        j = j.withColumn(m, F.when(F.col("__hit"), F.col(f"{m}__new")).otherwise(F.col(m)))
    return j.drop("__hit", *[f"{m}__new" for m in present])


def duplicate_keys(df: DataFrame, keys: list[str] = MERGE_KEYS) -> DataFrame:
    """Q7: key groups seen more than once (NULL keys group together, as in pandas)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def check_unique(df: DataFrame, keys: list[str] = MERGE_KEYS, name: str = "input") -> None:
    if not duplicate_keys(df, keys).isEmpty():
        raise ValueError(f"Duplicate keys {keys} in {name}; fix the key columns first.")


def merge_metrics(main: DataFrame, source: DataFrame, keys: list[str] = MERGE_KEYS,
                  metrics: list[str] = METRICS, check: bool = True) -> DataFrame:
    """Q8 + Q9: left join on the keys with NULL-safe equality; fill missing metrics of
    ``main`` from ``source``; left rows are all kept.

    NULL-safe key equality (``<=>``) is still planned as an equi-join (sort-merge or
    broadcast hash), not a nested loop.
    """
    if check:
        check_unique(source, keys, "source")
        check_unique(main, keys, "main")
    src = source.select(*[F.col(k).alias(f"{k}__k") for k in keys],
                        *[F.col(m).alias(f"{m}__src") for m in metrics])
    cond = None
    for k in keys:
        c = main[k].eqNullSafe(src[f"{k}__k"])
        cond = c if cond is None else cond & c
    j = main.join(src, on=cond, how="left")
    for m in metrics:
        j = j.withColumn(m, F.coalesce(F.nanvl(F.col(m), F.lit(None).cast("double")), F.col(f"{m}__src")))
    return j.drop(*[f"{k}__k" for k in keys], *[f"{m}__src" for m in metrics])


def null_counts(df: DataFrame) -> DataFrame:
    """Q10: missing count of every column in one pass, then unpivoted to (column, n_missing)."""
    aggs = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        cond = c.isNull()
        if f.dataType.typeName() in ("double", "float"):
            cond = cond | F.isnan(c)
        aggs.append(F.count_if(cond).alias(f.name))
    wide = df.agg(*aggs)
    return wide.unpivot([], [f"`{c}`" for c in df.columns], "column", "n_missing")


def diagnose_missing(df: DataFrame, metric: str = "answer_relevancy",
                     contexts_col: str = "retrieved_contexts",
                     answer_col: str = "generated_answer") -> DataFrame:
    """Q11: among rows missing ``metric``: total, empty context cells, blank answers."""
    rows = df.where(missing(metric))
    ctx = F.coalesce(F.col(contexts_col).cast("string"), F.lit("nan"))
    return rows.agg(F.count(F.lit(1)).alias("n_missing"),
                    F.count_if(ctx.isin(EMPTY_CONTEXT_CELLS)).alias("n_empty_contexts"),
                    F.count_if(strip(F.coalesce(F.col(answer_col), F.lit(""))) == "").alias("n_blank_answers"))


def sample_failed(df: DataFrame, n: int = 10, metric: str = "answer_relevancy",
                  order_col: str = "row_id", cols: list[str] | None = None) -> DataFrame:
    """Q12: the first ``n`` rows missing ``metric`` (a top-n report by row order)."""
    return df.where(missing(metric)).orderBy(order_col).limit(n).select(*(cols or [order_col, "question"]))
