"""Retrieval, context assembly, prompts and batch answering."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparqa.functions.text import col_of, strip
from sparqa.operators.embed import Embedder, embed, hash_embedder
from sparqa.operators.knn import DEFAULT_TOP_K, knn_topk

# Per-context cut and joiner of the assembled context, payload default.
CONTEXT_CUT = 800
CONTEXT_JOINER = " "
MISSING_TEXT = "Text not found"

# Default templates (ours; users pass their own). Placeholders: {context}, {question}.
RAG_TEMPLATE = ("Answer only from the context below. If the answer is not in it, say so.\n\n"
                "Context:\n{context}\n\nQuestion:\n{question}\n\nAnswer:\n")
PLAIN_TEMPLATE = "Answer the question briefly and clearly.\n\nQuestion:\n{question}\n\nAnswer:\n"

Responder = Callable[[Sequence[str]], Sequence[str]]


def retrieve(questions: DataFrame, points: DataFrame, k: int = DEFAULT_TOP_K,
             q_key: str = "qid", q_text: str = "question",
             embedder: Embedder = hash_embedder, p_keys: list[str] | None = None) -> DataFrame:
    """G1: embed each question as a document and take the cosine top-k points.

    Returns long form ``(q_key, rank, *p_keys, text, score)``. Payload text is looked up
    only for the hits, by a join whose strategy Spark picks from measured bytes. Points are
    told apart by ``point_id`` where stored (it covers the text), so points that share
    ``p_keys`` keep their own texts; a point stored twice yields one text per (question, rank).
    """
    p_keys = list(p_keys or ["doc_id", "pos"])
    own = p_keys + [c for c in ["point_id"] if c in points.columns and c not in p_keys]
    qv = embed(questions.select(q_key, q_text), q_text, "embedding", embedder)
    hits = knn_topk(qv, points, k, q_key, own, "embedding", "embedding")
    out = points.select(*own, "text").join(hits, on=own, how="inner").dropDuplicates([q_key, "rank"])
    return out.select(q_key, "rank", *p_keys,
                      F.coalesce(F.col("text"), F.lit(MISSING_TEXT)).alias("text"), "score")


def contexts_by_question(hits: DataFrame, q_key: str = "qid", text_col: str = "text",
                         out_col: str = "retrieved_contexts") -> DataFrame:
    """G2 + G3: rank-ordered ``array<string>`` per question (at most k per group)."""
    return hits.groupBy(q_key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", text_col))),
                    lambda h: h[text_col]).alias(out_col))


def build_context(contexts: Column | str, cut: int = CONTEXT_CUT,
                  joiner: str = CONTEXT_JOINER) -> Column:
    """First ``cut`` characters of each context, joined in rank order."""
    return F.array_join(F.transform(F.coalesce(col_of(contexts), F.array().cast("array<string>")),
                                    lambda c: F.substring(c, 1, cut)), joiner)


def fill_template(template: str, **values: Column) -> Column:
    """One-pass placeholder substitution (a value containing '{x}' is not re-expanded)."""
    pieces: list[Column] = []
    rest = template
    while rest:
        hits = [(rest.find("{" + k + "}"), k) for k in values if ("{" + k + "}") in rest]
        if not hits:
            pieces.append(F.lit(rest))
            break
        at, name = min(hits)
        if at:
            pieces.append(F.lit(rest[:at]))
        pieces.append(F.coalesce(values[name], F.lit("")))
        rest = rest[at + len(name) + 2:]
    return F.concat(*pieces) if pieces else F.lit("")


def build_prompt(question: Column | str, context: Column | str, use_rag: Column | bool,
                 rag_template: str = RAG_TEMPLATE, plain_template: str = PLAIN_TEMPLATE) -> Column:
    """G5 + G6 + G7: grounded or plain prompt chosen per row by ``use_rag``."""
    q, c = col_of(question), col_of(context)
    ur = F.lit(use_rag) if isinstance(use_rag, bool) else col_of(use_rag)
    return F.when(ur, fill_template(rag_template, context=c, question=q)) \
            .otherwise(fill_template(plain_template, question=q))


def standin_answer(contexts: Column | str) -> Column:
    """Extractive stand-in responder: the whole assembled context ("" without one)."""
    return strip(build_context(contexts))


def _respond(responder: Responder, vals: list[str]) -> list[str]:
    """One batch; if the batch fails, each row is retried alone and a failing row answers ""."""
    try:
        outs = list(responder(vals))
        if len(outs) != len(vals):
            raise ValueError("responder returned a different number of answers")
    except Exception:
        outs = []
        for p in vals:
            try:
                outs.append(responder([p])[0])
            except Exception:
                outs.append("")
    return ["" if o is None else str(o).strip() for o in outs]


def responder_udf(responder: Responder | None = None, factory: Callable[[], Responder] | None = None):
    """G8 with a pluggable model: Arrow batches of prompts; a failing row answers "".

    With ``factory`` (e.g. a client or model loader) the responder is built once per task
    and reused for all of the task's batches (iterator UDF).
    """
    if factory is not None:
        @F.pandas_udf(T.StringType())
        def _answer_iter(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = factory()
            for prompts in batches:
                yield pd.Series(_respond(model, prompts.fillna("").astype(str).tolist()))

        return _answer_iter

    @F.pandas_udf(T.StringType())
    def _answer(prompts: pd.Series) -> pd.Series:
        return pd.Series(_respond(responder, prompts.fillna("").astype(str).tolist()))

    return _answer


def answer_by_model(df: DataFrame, responders: dict[str, Responder], model_col: str = "generator_model",
                    prompt_col: str = "prompt", out_col: str = "generated_answer",
                    factories: dict[str, Callable[[], Responder]] | None = None) -> DataFrame:
    """G8 for a grid: each row is answered by the responder of its own model.

    One ``mapInPandas`` pass; inside an Arrow batch the rows are grouped by model and
    each responder gets only its rows (a failing row answers "", as in ``responder_udf``).
    ``factories`` build a model's responder (a client, a loaded model) when a task first meets the model.
    A model without a responder is an error.
    """
    schema = T.StructType(df.schema.fields + [T.StructField(out_col, T.StringType())])

    def run(batches):
        made = dict(responders or {})
        for pdf in batches:
            answers = pd.Series([""] * len(pdf), index=pdf.index, dtype=object)
            for model, part in pdf.groupby(model_col, dropna=False):
                if model not in made and model in (factories or {}):
                    made[model] = factories[model]()
                fn = made.get(model)
                if fn is None:
                    raise ValueError(f"no responder is given for the model {model!r}")
                answers.loc[part.index] = _respond(fn, part[prompt_col].fillna("").astype(str).tolist())
            yield pdf.assign(**{out_col: answers})

    return df.mapInPandas(run, schema)


def generate_answers(df: DataFrame, prompt_col: str = "prompt", contexts_col: str = "retrieved_contexts",
                     out_col: str = "generated_answer", responder: Responder | None = None,
                     factory: Callable[[], Responder] | None = None) -> DataFrame:
    """Batch answering. Without a responder the native extractive stand-in runs."""
    if responder is None and factory is None:
        return df.withColumn(out_col, standin_answer(contexts_col))
    return df.withColumn(out_col, responder_udf(responder, factory)(F.col(prompt_col)))


def answer_questions(questions: DataFrame, points: DataFrame | None, *, use_rag: bool = True,
                     k: int = DEFAULT_TOP_K, q_key: str = "qid", q_text: str = "question",
                     embedder: Embedder = hash_embedder, responder: Responder | None = None,
                     rag_template: str = RAG_TEMPLATE, plain_template: str = PLAIN_TEMPLATE,
                     cut: int = CONTEXT_CUT, factory: Callable[[], Responder] | None = None) -> DataFrame:
    """G9 + G10 over a question table: answer, rank-ordered contexts, prompt. ``factory`` builds the responder once per task.

    Without retrieval the context list is ``[]`` (never NULL) and no search runs.
    """
    empty = F.array().cast("array<string>")
    if use_rag:
        if points is None:
            raise ValueError("retrieval needs a collection")
        hits = retrieve(questions, points, k, q_key, q_text, embedder)
        ctx = contexts_by_question(hits, q_key)
        base = questions.join(ctx, on=q_key, how="left") \
                        .withColumn("retrieved_contexts", F.coalesce("retrieved_contexts", empty))
    else:
        base = questions.withColumn("retrieved_contexts", empty)
    base = base.withColumn("context", build_context("retrieved_contexts", cut)) \
               .withColumn("prompt", build_prompt(q_text, "context", use_rag, rag_template, plain_template))
    return generate_answers(base, "prompt", "retrieved_contexts", "generated_answer", responder, factory)
