"""Embedding.

An embedder is a batch function ``list[str] -> 2-D array-like`` (one row per text).
It runs inside Arrow-batched pandas UDFs, next to the data, with no shuffle.
The default ``hash_embedder`` is the deterministic stand-in for a model (see
``functions.hashvec``); a model-backed embedder plugs in with the same shape.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparqa.functions.hashvec import BYTE_OFFSET, HASH_DIM

Embedder = Callable[[Sequence[str]], "np.ndarray | list"]

_TOKEN_RE = None
_ASCII_TOKEN_RE = re.compile("[a-z0-9]+")


def _token_re():
    global _TOKEN_RE
    if _TOKEN_RE is None:
        import regex
        _TOKEN_RE = regex.compile(r"[\p{L}\p{N}]+")
    return _TOKEN_RE


def py_tokens(text: str | None) -> list[str]:
    """Python twin of ``functions.text.tokens`` (used inside Python workers)."""
    if not text:
        return []
    low = text.lower()
    return (_ASCII_TOKEN_RE if low.isascii() else _token_re()).findall(low)


def py_token_vector(tok: str) -> np.ndarray:
    d = hashlib.md5(tok.encode("utf-8")).digest()
    return np.frombuffer(d, dtype=np.uint8).astype(np.float64) - BYTE_OFFSET


class _Vocabulary(dict):
    """Token -> its row in ``digests``; a token that is not there is added."""

    def __init__(self):
        super().__init__()
        self.digests = bytearray()

    def __missing__(self, tok: str) -> int:
        self.digests += hashlib.md5(tok.encode("utf-8")).digest()
        n = self[tok] = len(self)
        return n


#: Tokens a worker keeps at most between calls, and texts whose token rows are held at once.
_VOCABULARY_MAX = 1 << 17
_TEXTS_AT_ONCE = 1024
_vocabulary = _Vocabulary()


def hash_embedder(texts: Sequence[str]) -> np.ndarray:
    """Stand-in model: sum of md5 token vectors, 16 DOUBLE components.

    Token occurrences are mapped to a bounded vocabulary of digests that the worker keeps, and each text's
    digests are summed as integers with one ``reduceat`` (exact in any order).
    """
    global _vocabulary
    out = np.zeros((len(texts), HASH_DIM), dtype=np.float64)
    for lo in range(0, len(texts), _TEXTS_AT_ONCE):
        if len(_vocabulary) > _VOCABULARY_MAX:
            _vocabulary = _Vocabulary()
        some = texts[lo:lo + _TEXTS_AT_ONCE]
        ids: list[int] = []
        counts = np.zeros(len(some), dtype=np.int64)
        for i, t in enumerate(some):
            toks = py_tokens(t)
            counts[i] = len(toks)
            ids.extend(map(_vocabulary.__getitem__, toks))
        if ids:
            rows = np.frombuffer(_vocabulary.digests, dtype=np.uint8).reshape(-1, HASH_DIM)[ids].astype(np.int32)
            starts, has = np.concatenate(([0], np.cumsum(counts)[:-1])), counts > 0
            out[lo:lo + len(some)][has] = np.add.reduceat(rows, starts[has], axis=0) - BYTE_OFFSET * counts[has][:, None]
    return out


def embedding_udf(embedder: Embedder = hash_embedder, dtype: str = "double",
                  factory: Callable[[], Embedder] | None = None):
    """B1/B2: Arrow-batched scalar UDF ``text -> array<dtype>`` around ``embedder``.

    ``dtype="float"`` applies the float32 cast of B5 on the way out. With ``factory``
    (e.g. a function that loads a model) the UDF is an iterator UDF: the embedder is built
    once per task and reused for all of the task's batches.
    """
    elem = T.FloatType() if dtype == "float" else T.DoubleType()
    np_dtype = np.float32 if dtype == "float" else np.float64

    if factory is not None:
        @F.pandas_udf(T.ArrayType(elem))
        def _embed_iter(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = factory()
            for texts in batches:
                vals = texts.fillna("").astype(str).tolist()
                yield pd.Series(list(np.asarray(model(vals), dtype=np_dtype)))

        return _embed_iter

    @F.pandas_udf(T.ArrayType(elem))
    def _embed(texts: pd.Series) -> pd.Series:
        vals = texts.fillna("").astype(str).tolist()
        mat = np.asarray(embedder(vals), dtype=np_dtype)
        return pd.Series(list(mat))

    return _embed


def embedding_array_udf(embedder: Embedder = hash_embedder):
    """``array<string> -> array<array<double>>``: one embedder call per Arrow batch."""

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
    def _embed_lists(lists: pd.Series) -> pd.Series:
        flat, sizes = [], []
        for v in lists:
            items = [] if v is None else ["" if x is None else str(x) for x in v]
            flat.extend(items)
            sizes.append(len(items))
        mat = np.asarray(embedder(flat), dtype=np.float64) if flat else np.zeros((0, 0))
        out, at = [], 0
        for n in sizes:
            out.append([row for row in mat[at:at + n]])
            at += n
        return pd.Series(out)

    return _embed_lists


def embed(df: DataFrame, text_col: str = "text", out_col: str = "embedding",
          embedder: Embedder = hash_embedder, dtype: str = "double",
          factory: Callable[[], Embedder] | None = None) -> DataFrame:
    """B1: add an embedding column; rows stay where they are (no shuffle)."""
    return df.withColumn(out_col, embedding_udf(embedder, dtype, factory)(F.col(text_col)))


def to_float32(vec: Column | str) -> Column:
    """float32 cast of stored and query vectors."""
    c = F.col(vec) if isinstance(vec, str) else vec
    return F.transform(c, lambda x: x.cast("float"))


def embed_records(df: DataFrame, text_col: str = "text", out_col: str = "record",
                  embedder: Embedder = hash_embedder) -> DataFrame:
    """``struct<text, embedding>`` per row."""
    e = embedding_udf(embedder)(F.col(text_col))
    return df.withColumn(out_col, F.struct(F.col(text_col).alias("text"), e.alias("embedding")))


def embedding_dim(df: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """Dimension check over a whole vector table: min/max size and row count."""
    return df.agg(F.min(F.size(vec_col)).alias("min_dim"),
                  F.max(F.size(vec_col)).alias("max_dim"),
                  F.count(F.lit(1)).alias("n_vectors"))


def probe_dimension(spark, embedder: Embedder = hash_embedder, probe: str = "dimension probe") -> int:
    """B4 for a model: embed one probe text once (driver-side, one row)."""
    return int(np.asarray(embedder([probe])).shape[1])
