"""Judge-style metrics.

The judge decides verdicts; the metrics are aggregations of verdicts. The native
judge is the deterministic token-containment stand-in, evaluated inside each row (no
shuffle; the texts' tokens come from array expressions, the verdicts from sets in Arrow batches). A model-backed judge plugs in via
``run_judge`` (Arrow batches through ``mapInPandas``) and its per-row metrics are
attached back by key (T10).

Stand-in rules (fixed):
- statements: split on '.', strip, drop empties;
- a statement is supported by a text when at least half of the statement's
  distinct tokens occur in the text (a statement without tokens is supported);
- context_precision: v_k = 1 when context k supports some reference statement;
  sum_k(precision@k * v_k) / sum_k(v_k), 0 when no context is relevant;
- context_recall: share of reference statements supported by all contexts; NULL if none;
- faithfulness: share of answer statements supported by all contexts; NULL if none;
- answer_relevancy: 0 for a blank (evasive) answer, else the mean cosine between the
  question and the first 3 answer statements (the "generated-back questions");
  NULL when the answer has no statement.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparqa.functions.hashvec import cosine
from sparqa.functions.text import is_blank, statements, tokens
from sparqa.operators.embed import Embedder, embedding_array_udf, embedding_udf, hash_embedder

METRICS = ["context_precision", "context_recall", "faithfulness", "answer_relevancy"]
RAG_METRICS = METRICS
PLAIN_METRICS = ["answer_relevancy"]

JUDGE_COLUMNS = {"question": "user_input", "retrieved_contexts": "retrieved_contexts",
                 "generated_answer": "response", "answer": "reference"}


def judge_input(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rename to the judge's input shape (user_input, retrieved_contexts, response, reference)."""
    keys = keys or []
    return df.select(*keys, *[F.col(s).alias(d) for s, d in JUDGE_COLUMNS.items()])


def metrics_for(use_rag: Column | bool) -> Column:
    """T4: names of the metrics a run computes (RAG: four; plain: answer_relevancy)."""
    ur = F.lit(use_rag) if isinstance(use_rag, bool) else use_rag
    return F.when(ur, F.array(*[F.lit(m) for m in RAG_METRICS])) \
            .otherwise(F.array(*[F.lit(m) for m in PLAIN_METRICS]))


def require_contexts(df: DataFrame, use_rag: bool = True) -> None:
    """A RAG judge run needs the retrieved_contexts column."""
    if use_rag and "retrieved_contexts" not in df.columns:
        raise ValueError("RAG judge run requires a 'retrieved_contexts' column")


VERDICTS = T.StructType([T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("cp", "cr", "f")])


def row_verdicts(contexts: list[str | None], reference: list[str], answer: list[str]) -> tuple[list, list, list]:
    """The verdicts of a row: contexts and statements come as their tokens joined by spaces.

    Every text becomes a set once, so the work is linear in the row. What a missing context would support is unknown.
    """
    texts = [None if c is None else set(c.split(" ")) for c in contexts]
    whole = None if any(t is None for t in texts) else set().union(*texts)
    ref, ans = [[set(s.split(" ")) if s else set() for s in sts] for sts in (reference, answer)]

    def supported(s: set, text: set) -> bool:
        return 2 * len(s & text) >= len(s)
    cp = [(None if ref else 0) if t is None else int(any(supported(s, t) for s in ref)) for t in texts]
    cr, f = [[None if whole is None else int(supported(s, whole)) for s in sts] for sts in (ref, ans)]
    return cp, cr, f


@F.pandas_udf(VERDICTS)
def _verdicts(contexts: pd.Series, reference: pd.Series, answer: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([row_verdicts(*r) for r in zip(contexts, reference, answer, strict=True)], columns=VERDICTS.names)


def _joined(texts: Column) -> Column:
    """Each text as its tokens joined by spaces (a token holds none)."""
    return F.transform(texts, lambda s: F.when(s.isNotNull(), F.concat_ws(" ", tokens(s))))


def with_verdicts(df: DataFrame, question: str = "question", answer: str = "generated_answer",
                  reference: str = "answer", contexts: str = "retrieved_contexts") -> DataFrame:
    """T9 (native judge): add verdict arrays ``_v_cp``, ``_v_cr``, ``_v_f``, decided row by row in Arrow batches."""
    empty = F.array().cast("array<string>")
    v = _verdicts(_joined(F.coalesce(F.col(contexts), empty)), _joined(statements(F.col(reference))), _joined(statements(F.col(answer))))
    return df.withColumn("_v", v).select("*", *[F.col(f"_v.{n}").alias(f"_v_{n}") for n in VERDICTS.names]).drop("_v")


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0), lambda a, b: a + b)


def _mean_or_null(arr: Column) -> Column:
    return F.when(F.size(arr) > 0, _sum(arr).cast("double") / F.size(arr))


def native_judge(df: DataFrame, question: str = "question", answer: str = "generated_answer",
                 reference: str = "answer", contexts: str = "retrieved_contexts",
                 use_rag: Column | bool = True, embedder: Embedder = hash_embedder) -> DataFrame:
    """T5-T8 (+T4): the four metric columns, computed in-row. Plain runs get only answer_relevancy.

    Vectors for answer_relevancy come from the (pluggable) embedder in Arrow batches:
    one vector per question and per back-question, each computed once.
    """
    d = with_verdicts(df, question, answer, reference, contexts).withColumns({
        "_qv": embedding_udf(embedder)(F.coalesce(F.col(question), F.lit(""))),
        "_gv": embedding_array_udf(embedder)(statements(F.col(answer)))})
    n_rel = _sum(F.col("_v_cp"))
    prec_at = F.transform("_v_cp", lambda v, i: v * _sum(F.slice(F.col("_v_cp"), 1, i + 1)).cast("double")
                          / (i + 1))
    cp = F.when(n_rel > 0, F.aggregate(prec_at, F.lit(0.0), lambda a, b: a + b) / n_rel).otherwise(F.lit(0.0))
    sims = F.transform("_gv", lambda v: cosine(F.col("_qv"), v))
    ar = F.when(is_blank(F.col(answer)), F.lit(0.0)) \
          .otherwise(F.when(F.size(sims) > 0,
                            F.aggregate(sims, F.lit(0.0), lambda a, b: a + b) / F.size(sims)))
    ur = F.lit(use_rag) if isinstance(use_rag, bool) else F.col(use_rag) if isinstance(use_rag, str) else use_rag
    out = d.withColumns({
        "context_precision": F.when(ur, cp),
        "context_recall": F.when(ur, _mean_or_null(F.col("_v_cr"))),
        "faithfulness": F.when(ur, _mean_or_null(F.col("_v_f"))),
        "answer_relevancy": ar})
    return out.drop("_v_cp", "_v_cr", "_v_f", "_qv", "_gv")


def verdict_table(df: DataFrame, keys: list[str], **cols) -> DataFrame:
    """T9 output as a long table ``(keys, metric, idx, verdict)`` (one explode, no union)."""
    d = with_verdicts(df, **cols)

    def tag(arr: str, name: str) -> Column:
        return F.transform(arr, lambda v, i: F.struct(F.lit(name).alias("metric"), i.alias("idx"),
                                                      v.alias("verdict")))

    allv = F.concat(tag("_v_cp", "context_precision"), tag("_v_cr", "context_recall"),
                    tag("_v_f", "faithfulness"))
    return d.select(*keys, F.explode(allv).alias("v")).select(*keys, "v.metric", "v.idx", "v.verdict")


JudgeFn = Callable[[pd.DataFrame], pd.DataFrame]

# Rows of a judge call by default, and in a repair run.
JUDGE_BATCH = 32
REPAIR_BATCH = 1


def first_fit(lengths: list[int], batch_size: int = JUDGE_BATCH, budget: int | None = None) -> list[int]:
    """The batch of each row: the first one with a place and with room under ``budget``; a row longer than that is a batch of its own.

    A row that fits nowhere opens a batch. Full batches are passed over at once.
    """
    used: list[int] = []
    rows: list[int] = []
    out, first = [], 0
    for n in lengths:
        i = first
        while i < len(used) and (rows[i] >= batch_size or budget is not None and used[i] + n > budget):
            i += 1
        if i == len(used):
            used.append(0)
            rows.append(0)
        used[i] += n
        rows[i] += 1
        out.append(i)
        while first < len(used) and (rows[first] >= batch_size or budget is not None and used[first] > budget):
            first += 1
    return out


def judge_tokens(question: str = "user_input", contexts: str = "retrieved_contexts", answer: str = "response", reference: str = "reference") -> Column:
    """What a row costs a judge: the tokens of its texts."""
    size = lambda c: F.size(tokens(F.coalesce(c, F.lit(""))))
    ctx = F.aggregate(F.coalesce(contexts, F.array().cast("array<string>")), F.lit(0), lambda n, c: n + size(c))
    return (size(F.col(question)) + size(F.col(answer)) + size(F.col(reference)) + ctx).cast("int")


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _first_fit(lengths: pd.Series, batch_size: pd.Series, budget: pd.Series) -> pd.Series:
    return pd.Series([first_fit([int(x) for x in v], int(s), None if pd.isna(b) else int(b)) for v, s, b in zip(lengths, batch_size, budget, strict=True)])


def batch_plan(df: DataFrame, group: str, order: list[str], length: Column, batch_size: int = JUDGE_BATCH, budget: int | None = None) -> DataFrame:
    """(group, *order, length, batch): the judge batches of every group of rows, packed in the order of ``order``.

    For judges that take whole groups (a conversation) in one session; a group's rows are its bound.
    """
    rows = F.array_sort(F.collect_list(F.struct(*order, length.alias("length"))))
    per = df.groupBy(group).agg(rows.alias("rows"))
    fit = _first_fit(F.col("rows.length"), F.lit(batch_size), F.lit(budget).cast("int"))
    per = per.select(group, F.explode(F.arrays_zip("rows", fit.alias("batch"))).alias("r"))
    return per.select(group, *[F.col(f"r.rows.{c}").alias(c) for c in order], F.col("r.rows.length").alias("length"), F.col("r.batch").alias("batch"))


def run_judge(df: DataFrame, keys: list[str], judge: JudgeFn | None = None, use_rag: bool = True,
              factory: Callable[[], JudgeFn] | None = None, batch_size: int = JUDGE_BATCH, token_budget: int | None = None) -> DataFrame:
    """T9 with a pluggable judge: Arrow batches of judge input -> metric columns per row.

    ``judge`` receives ``user_input, retrieved_contexts, response, reference`` and returns
    the metric columns it computed. A failing batch is retried row by row; a failing row
    gets missing metrics, as judge failures do. ``factory`` builds the judge (e.g. loads a
    model or opens a client) once per task instead. A call gets ``batch_size`` rows at most, and with ``token_budget`` no more
    tokens than that in all unless a single row has more: rows are packed first-fit inside an Arrow batch.
    """
    require_contexts(df, use_rag)
    wanted = RAG_METRICS if use_rag else PLAIN_METRICS
    inp = judge_input(df, keys)
    inp = inp.withColumn("_cost", judge_tokens() if token_budget is not None else F.lit(0))
    schema = T.StructType([inp.schema[k] for k in keys]
                          + [T.StructField(m, T.DoubleType()) for m in wanted])
    judge_cols = list(JUDGE_COLUMNS.values())

    def call(fn: JudgeFn, pdf: pd.DataFrame) -> pd.DataFrame:
        out = fn(pdf[judge_cols].reset_index(drop=True))
        return pd.DataFrame({m: (out[m] if m in out else [None] * len(pdf)) for m in wanted})

    def run(batches):
        fn = factory() if factory is not None else judge
        for arrow in batches:
            at = pd.Series(first_fit(arrow["_cost"].tolist(), batch_size, token_budget), index=arrow.index)
            for _, pdf in arrow.groupby(at):
                try:
                    res = call(fn, pdf)
                except Exception:
                    parts = []
                    for i in range(len(pdf)):
                        try:
                            parts.append(call(fn, pdf.iloc[i:i + 1]))
                        except Exception:
                            parts.append(pd.DataFrame({m: [None] for m in wanted}))
                    res = pd.concat(parts, ignore_index=True)
                res = res.astype("float64")
                yield pd.concat([pdf[keys].reset_index(drop=True), res.reset_index(drop=True)], axis=1)

    return inp.mapInPandas(run, schema)


def attach_metrics(df: DataFrame, metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Overwrite those of the four metric columns that the judge output has.

    A keyed left join replaces the reference's positional assignment.
    """
    present = [m for m in METRICS if m in metrics.columns]
    base = df.drop(*present)
    return base.join(metrics.select(*keys, *present), on=keys, how="left")


def judge_means(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """T11 (rule M3): means with missing counted as 0, for the metric columns present."""
    present = [m for m in METRICS if m in df.columns]
    return df.groupBy(*(by or [])).agg(
        *[F.avg(F.coalesce(F.nanvl(F.col(m), F.lit(None).cast("double")), F.lit(0.0))).alias(f"{m}_mean")
          for m in present])
