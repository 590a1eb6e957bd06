"""Token-matching scores (T1, T2): greedy max-cosine matching of token vectors.

P = mean over candidate tokens of the best cosine to any reference token, R the
same from the reference side, F1 = 2PR / (P + R). Uniform token weights, no
baseline rescaling. Token vectors come from the pluggable ``token_embedder``
(default: the md5 stand-in), tokens from the native ``tokens`` expression.

Every row is scored inside its own task by a blocked numpy matmul over the row's
distinct tokens: no token pair is ever emitted as a row and nothing shuffles.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparqa.functions.text import col_of, tokens
from sparqa.operators.embed import py_token_vector

_BLOCK = 2048
SCORE_TYPE = T.StructType([T.StructField("precision", T.DoubleType()),
                           T.StructField("recall", T.DoubleType()),
                           T.StructField("f1", T.DoubleType())])


def _unit_rows(toks, vec_of: Callable[[str], np.ndarray], cache: dict):
    uniq = Counter(toks)
    for t in uniq:
        if t not in cache:
            cache[t] = vec_of(t)
    m = np.array([cache[t] for t in uniq])
    n = np.sqrt((m * m).sum(axis=1))
    return m / np.where(n == 0, 1.0, n)[:, None], np.fromiter(uniq.values(), np.float64, len(uniq))


def match_scores(cand, ref, vec_of: Callable[[str], np.ndarray] = py_token_vector,
                 cache: dict | None = None) -> tuple[float, float, float]:
    """(P, R, F1) of one candidate/reference token list; 0s when a side has no tokens."""
    if cand is None or ref is None or len(cand) == 0 or len(ref) == 0:
        return 0.0, 0.0, 0.0
    cache = {} if cache is None else cache
    cm, cc = _unit_rows(cand, vec_of, cache)
    rm, rc = _unit_rows(ref, vec_of, cache)
    best_c = np.full(len(cm), -np.inf)
    best_r = np.full(len(rm), -np.inf)
    for i in range(0, len(cm), _BLOCK):
        for j in range(0, len(rm), _BLOCK):
            s = cm[i:i + _BLOCK] @ rm[j:j + _BLOCK].T
            best_c[i:i + _BLOCK] = np.maximum(best_c[i:i + _BLOCK], s.max(axis=1))
            best_r[j:j + _BLOCK] = np.maximum(best_r[j:j + _BLOCK], s.max(axis=0))
    p = float((best_c * cc).sum() / cc.sum())
    r = float((best_r * rc).sum() / rc.sum())
    f = 2 * p * r / (p + r) if (p + r) != 0 else 0.0
    return p, r, f


def _scores_udf(vec_of: Callable[[str], np.ndarray]):
    @F.pandas_udf(SCORE_TYPE)
    def _score(cand: pd.Series, ref: pd.Series) -> pd.DataFrame:
        cache: dict = {}
        rows = [match_scores(c, r, vec_of, cache) for c, r in zip(cand, ref)]
        return pd.DataFrame(rows, columns=["precision", "recall", "f1"])
    return _score


def token_match(candidate: Column | str, reference: Column | str,
                vec_of: Callable[[str], np.ndarray] = py_token_vector) -> Column:
    """T1 as a struct column ``{precision, recall, f1}``."""
    return _scores_udf(vec_of)(tokens(col_of(candidate)), tokens(col_of(reference)))


def bertscore(df: DataFrame, candidate: str = "generated_answer", reference: str = "answer",
              vec_of: Callable[[str], np.ndarray] = py_token_vector) -> DataFrame:
    """Add ``bertscore_precision``, ``bertscore_recall``, ``bertscore_f1``."""
    s = token_match(F.coalesce(F.col(candidate), F.lit("")),
                    F.coalesce(F.col(reference), F.lit("")), vec_of)
    return df.withColumn("_bs", s).select(
        "*", F.col("_bs.precision").alias("bertscore_precision"),
        F.col("_bs.recall").alias("bertscore_recall"),
        F.col("_bs.f1").alias("bertscore_f1")).drop("_bs")


def bertscore_means(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """T2 (rule M4): plain means of the three scores, per group."""
    aggs = [F.avg(c).alias(f"{c}_mean") for c in
            ("bertscore_precision", "bertscore_recall", "bertscore_f1")]
    return scored.groupBy(*(by or [])).agg(*aggs)
