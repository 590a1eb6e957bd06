"""Deterministic hash embedding: the native stand-in for an embedding model.

Token vector: the 16 bytes of md5(token), each minus 127.5. A text vector is the
sum of its token vectors, kept unnormalised in DOUBLE. Every component is a
multiple of 0.5 and every dot product a multiple of 0.25, so sums are exact in
any order and any engine; cosine divides by ``sqrt(n1) * sqrt(n2)`` only when
scoring. A text without tokens has the zero vector and scores 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparqa.functions.text import col_of, tokens

# Fixed values of the stand-in.
HASH_DIM = 16
BYTE_OFFSET = 127.5


def text_vector(text: Column | str) -> Column:
    """In-row text vector (higher-order function; for short texts such as questions).

    Tables of texts go through the Arrow-batched embedder (``operators.embed.embed``),
    which computes each distinct token's vector once per batch; both give equal vectors.
    """
    hashes = F.transform(tokens(F.coalesce(col_of(text), F.lit(""))), lambda t: F.md5(t))
    zero = F.array_repeat(F.lit(0.0), HASH_DIM)

    def add(acc, h):
        vec = F.transform(F.sequence(F.lit(0), F.lit(HASH_DIM - 1)),
                          lambda i: F.conv(F.substring(h, i * 2 + 1, 2), 16, 10).cast("double")
                          - F.lit(BYTE_OFFSET))
        return F.zip_with(acc, vec, lambda a, b: a + b)

    return F.aggregate(hashes, zero, add)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """dot / (sqrt(|a|^2) * sqrt(|b|^2)); 0 when either side is the zero vector."""
    den = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.try_divide(dot(a, b), F.when(den != 0, den)), F.lit(0.0))
