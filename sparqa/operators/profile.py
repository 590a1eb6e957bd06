"""Profiling (P1-P4): shape, columns, non-null counts, describe(include='all')."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def _q(name: str) -> str:
    return f"`{name}`"


def shape(df: DataFrame) -> DataFrame:
    """One row ``(n_rows, n_columns)``."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(df.columns)).alias("n_columns"))


def columns(df: DataFrame) -> DataFrame:
    """``(position, column, type)`` from the schema (no data scanned)."""
    spark = df.sparkSession
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "position int, column string, type string")


def info(df: DataFrame) -> DataFrame:
    """Non-null count and type per column (one aggregate pass, then unpivot)."""
    wide = df.agg(*[F.count(F.col(_q(c))).alias(c) for c in df.columns])
    long = wide.unpivot([], [_q(c) for c in df.columns], "column", "non_null")
    types = columns(df).select("column", "type", "position")
    return long.join(F.broadcast(types), "column").select("position", "column", "non_null", "type")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def _spots(n: int, probs: list[float]):
    out = []
    for p in probs:
        pos = (n - 1) * p
        lo = int(pos // 1)
        out.append((lo, min(lo + 1, n - 1), pos - lo))
    return out


def _interpolate(got: dict, spots) -> list[float]:
    res = []
    for lo, hi, frac in spots:
        a, b = got[lo], got[hi]
        res.append(a if frac == 0 else a + (b - a) * frac)
    return res


#: Accuracy of the sketch that proposes brackets, and the values of a bracket that are read back instead of cut again. Neither changes a result.
SKETCH = 10_000
LEAF_VALUES = 10_000


def _number(df: DataFrame, c: str) -> Column:
    x = F.col(_q(c)).cast("double")
    return F.when(~F.isnan(x), x)


def _within(x: Column, lo: float | None, hi: float | None) -> Column:
    """``x`` where it lies strictly between the ends; None is no end."""
    ok = x.isNotNull()
    if lo is not None:
        ok = ok & (x > F.lit(lo))
    if hi is not None:
        ok = ok & (x < F.lit(hi))
    return F.when(ok, x)


def values_at_ranks(df: DataFrame, ranks: dict[str, list[int]], counts: dict[str, int]) -> dict[str, dict[int, float]]:
    """The values at the given ranks (0 = least) of several columns, missing values left out: exact, no sort.

    Every rank has a bracket of values. A pass proposes for all brackets of all columns at once two values around the rank
    (a mergeable sketch), the next counts what lies below, at and between them; the rank is one of the two, or
    the bracket becomes what is strictly between or beside them, some thousand times smaller. Brackets of few values are read back.
    """
    out: dict[str, dict[int, float]] = {c: {} for c in ranks}
    # (column, rank) -> (lower end, upper end, values up to the lower end, values inside)
    todo = {(c, r): (None, None, 0, counts[c]) for c, rs in ranks.items() for r in rs if 0 <= r < counts[c]}
    while todo:
        leaves = sorted({(c, *todo[c, r]) for c, r in todo if todo[c, r][3] <= LEAF_VALUES}, key=str)
        if leaves:
            pairs = F.array(*[F.struct(F.lit(i).alias("i"), _within(_number(df, c), lo, hi).alias("v")) for i, (c, lo, hi, *_) in enumerate(leaves)])
            rows = df.select(F.explode(pairs).alias("p")).select("p.*").where("v IS NOT NULL").groupBy("i", "v").count().toArrow()
            leaf_of, value, count = (rows[c].to_numpy() for c in ("i", "v", "count"))
            for i, leaf in enumerate(leaves):
                mine = np.flatnonzero(leaf_of == i)
                mine = mine[np.argsort(value[mine], kind="stable")]
                upto = leaf[3] + np.cumsum(count[mine])
                for c, r in todo:
                    if c == leaf[0] and todo[c, r] == leaf[1:]:
                        out[c][r] = float(value[mine[np.searchsorted(upto, r, "right")]])
            todo = {k: b for k, b in todo.items() if b[3] > LEAF_VALUES}
            continue
        keys = sorted(todo)
        around = []
        for c, r in keys:
            lo, hi, below, inside = todo[c, r]
            p = (r - below + 0.5) / inside
            x = _within(_number(df, c), lo, hi)
            around.append(F.percentile_approx(x, [max(0.0, p - 2 / SKETCH), min(1.0, p + 2 / SKETCH)], SKETCH))
        ends = [list(x) for x in df.agg(*[a.alias(f"q{i}") for i, a in enumerate(around)]).first()]
        marks = []
        for i, (c, r) in enumerate(keys):
            x = _within(_number(df, c), *todo[c, r][:2])
            a, b = (F.lit(e) for e in ends[i])
            marks += [F.count_if(w).alias(f"n{i}_{j}") for j, w in enumerate((x < a, x == a, (x > a) & (x < b), (x == b) & (a < b)))]
        seen = df.agg(*marks).first()
        for i, (c, r) in enumerate(keys):
            lo, hi, below, inside = todo[c, r]
            a, b = ends[i]
            under, at_a, mid, at_b = (seen[f"n{i}_{j}"] for j in range(4))
            k = r - below
            if k < under:
                todo[c, r] = (lo, a, below, under)
            elif k < under + at_a:
                out[c][r] = a
                del todo[c, r]
            elif k < under + at_a + mid:
                todo[c, r] = (a, b, below + under + at_a, mid)
            elif k < under + at_a + mid + at_b:
                out[c][r] = b
                del todo[c, r]
            else:
                todo[c, r] = (b, hi, below + under + at_a + mid + at_b, inside - under - at_a - mid - at_b)
    return out


def multi_quantiles(df: DataFrame, cols: list[str], probs: list[float],
                    counts: dict[str, int] | None = None) -> dict[str, list[float | None]]:
    """Exact linear-interpolation quantiles (pandas / ``quantile_cont`` rule) of many columns (see ``values_at_ranks``).

    ``df`` is read in several passes and must be the same in each.
    """
    if not cols:
        return {}
    if counts is None:
        row = df.agg(*[F.count(_number(df, c)) for c in cols]).first()
        counts = dict(zip(cols, row, strict=True))
    spots = {c: _spots(counts[c], probs) for c in cols if counts.get(c)}
    need = {c: sorted({r for lo, hi, _ in s for r in (lo, hi)}) for c, s in spots.items()}
    got = values_at_ranks(df, need, counts)
    return {c: (_interpolate(got[c], spots[c]) if c in spots else [None] * len(probs)) for c in cols}


def exact_quantiles(df: DataFrame, col: str, probs: list[float]) -> list[float | None]:
    """Exact quantiles of one column (see ``multi_quantiles``)."""
    return multi_quantiles(df, [col], probs)[col]


def describe_numeric(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """P4 numeric part: count, mean, sample std, min, 25/50/75 % (linear), max per column.

    One aggregate pass for the moments and extremes of every column, a few more for the
    exact quantiles of all columns. The result has one row per column.
    """
    cols = cols or numeric_columns(df)
    if not cols:
        return df.sparkSession.createDataFrame(
            [], "column string, count double, mean double, std double, min double, "
                "p25 double, p50 double, p75 double, max double")
    aggs = []
    for c in cols:
        x = F.col(_q(c)).cast("double")
        x = F.when(~F.isnan(x), x)
        aggs += [F.count(x).alias(f"{c}__count"), F.avg(x).alias(f"{c}__mean"),
                 F.stddev_samp(x).alias(f"{c}__std"), F.min(x).alias(f"{c}__min"),
                 F.max(x).alias(f"{c}__max")]
    wide = df.agg(*aggs).first()
    counts = {c: int(wide[f"{c}__count"]) for c in cols}
    qs = multi_quantiles(df, cols, [0.25, 0.5, 0.75], counts)
    rows = [(c, float(counts[c]), wide[f"{c}__mean"], wide[f"{c}__std"], wide[f"{c}__min"],
             qs[c][0], qs[c][1], qs[c][2], wide[f"{c}__max"]) for c in cols]
    return df.sparkSession.createDataFrame(
        rows, "column string, count double, mean double, std double, min double, "
              "p25 double, p50 double, p75 double, max double")


def describe_text(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """P4 text part: count, unique, top (most frequent; tie -> smallest), freq per column.

    Value frequencies come from one grouped count over the unpivoted (column, value)
    pairs with map-side partial aggregation; the top value is a ``max_by`` per column.
    """
    cols = cols or text_columns(df)
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, count bigint, unique bigint, top string, "
                                                   "freq bigint")
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"),
                                                  F.col(_q(c)).cast("string").alias("value"))
                                         for c in cols])).alias("kv")).select("kv.column", "kv.value")
    freq = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    # one aggregate per column over the distinct-value counts (NULL kept as its own group
    # so an all-missing column still appears); the top value has the largest count, ties
    # to the smallest value: min_by(value, (is_null, -n, value))
    nn = F.col("value").isNotNull()
    per = freq.groupBy("column").agg(
        F.coalesce(F.sum(F.when(nn, F.col("n"))), F.lit(0)).alias("count"),
        F.count("value").alias("unique"),
        F.min_by("value", F.struct((~nn).cast("int"), -F.col("n"), F.col("value"))).alias("top"),
        F.max(F.when(nn, F.col("n"))).alias("freq"))
    return per.select("column", "count", "unique", "top", "freq")
