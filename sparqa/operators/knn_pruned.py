"""Exact cosine top-k (V8) that rules out blocks of points before they meet a query.

1. A bounded number of pivots is drawn from the points. Every point belongs to the pivot of least angle; a pivot's block
   is known by its count and its radius, the largest angle of a member.
2. A query is first scored against its nearest blocks, as few as hold k points. The k-th score found is a lower bound on its k-th best.
3. A block whose members are all at a larger angle (angle to the pivot less the radius) than that score stands for cannot hold
   a better point: only the other blocks are visited. Ties count as reachable, and a tolerance covers the rounding of angles.

Same rows, order and ties as ``knn_topk``. It pays where vectors form clusters; where all angles are alike every block is reachable, and
``knn_topk`` does the same with less. Blocks that lie near one another share a group of bounded bytes, a block above that takes several
groups, and queries are dealt in parts of bounded bytes: neither a hot pivot nor many queries of one block fill a task. A query travels
once to each group that it visits, with the numbers of the blocks, however many these are. A zero vector scores 0 with everything: zero points are a block of their own, zero queries
get the first k points by key. Vectors with a NaN take no part.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparqa.operators.collection import scratch_path
from sparqa.operators.knn import DEFAULT_MAX_BLOCK_BYTES, DEFAULT_TOP_K, Block, _as_matrix, _merge, _sortable

#: Pivots at most (a matrix of them travels with the tasks), and points a pivot is wanted for.
MAX_PIVOTS = 1024
PIVOT_POINTS = 256
#: Radians that an angle may be off by rounding, many times over.
ANGLE_SLACK = 1e-6
ZERO_BLOCK = -1
#: Vectors whose angles to all pivots are held at once.
_ROWS = 1024


def _unit(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and norms; a zero vector stays zero."""
    n = np.sqrt((m * m).sum(1))
    return m / np.where(n > 0, n, 1.0)[:, None], n


def _angles(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ pivots.T, -1.0, 1.0))


def _stored(df: DataFrame, name: str) -> DataFrame:
    df.write.parquet(path := scratch_path(df.sparkSession, name))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _plain(df: DataFrame, keys: list[str], vec: str) -> DataFrame:
    """(keys, _v): vectors in double precision, a missing one without components; those with a NaN are left out."""
    v = F.coalesce(F.transform(vec, lambda x: x.cast("double")), F.array().cast("array<double>"))
    return df.select(*keys, v.alias("_v")).where(~F.exists("_v", lambda x: F.coalesce(F.isnan(x), F.lit(True))))


def _assigned(points: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``points`` with ``_pivot`` and ``_angle``."""
    schema = T.StructType(points.schema.fields + [T.StructField("_pivot", T.IntegerType()), T.StructField("_angle", T.DoubleType())])

    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), _ROWS):
                pdf = batch.iloc[lo:lo + _ROWS]
                unit, norm = _unit(_as_matrix(pdf["_v"].tolist(), pivots.shape[1]))
                a = _angles(unit, pivots)
                best = a.argmin(1)
                yield pdf.assign(_pivot=np.where(norm > 0, best, ZERO_BLOCK).astype("int32"), _angle=np.where(norm > 0, a[np.arange(len(a)), best], 0.0))
    return points.mapInPandas(run, schema)


def _nearest_blocks(a: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """Which blocks each row visits first: the nearest, as few as hold k points."""
    order = np.argsort(a, axis=1, kind="stable")
    held = np.cumsum(counts[order], axis=1) - counts[order]
    first = np.zeros(a.shape, bool)
    np.put_along_axis(first, order, held < k, 1)
    return first & (counts > 0)


def _groups(pivots: np.ndarray, sizes: dict[int, int], most: int) -> dict[int, tuple[int, int]]:
    """(first group, groups) of each block: neighbours share a group of ``most`` points, a larger block has groups of its own."""
    left = np.ones(len(pivots), bool)
    chain, at = [], 0
    for _ in range(len(pivots)):
        left[at] = False
        chain.append(at)
        at = int(np.where(left, pivots @ pivots[at], -np.inf).argmax())
    out, group, held = {}, -1, most
    for p in [*chain, ZERO_BLOCK]:
        n = sizes.get(p, 0)
        if held + n > most or p == ZERO_BLOCK:
            group, held = group + 1, 0
        parts = max(1, math.ceil(n / most))
        out[p] = (group, parts)
        held += n
        group += parts - 1
        if parts > 1:
            held = most
    return out


def _visits(queries: DataFrame, q_key: str, pivots: np.ndarray, counts: np.ndarray, radius: np.ndarray, zeros: int, k: int, groups: dict[int, tuple[int, int]],
            again: bool) -> DataFrame:
    """(q_key, _v, _kth, _group, _blocks, _n): the groups of the first blocks of each query, or (``again``, with ``_kth``) of all that it can reach.

    ``_blocks``: the numbers of the blocks, as bytes; ``_n``: how many of them this row is the first of.
    """
    schema = T.StructType([queries.schema[q_key], queries.schema["_v"], T.StructField("_kth", T.DoubleType()), T.StructField("_group", T.IntegerType()),
                           T.StructField("_blocks", T.BinaryType()), T.StructField("_n", T.IntegerType())])
    blocks = np.array([*range(len(pivots)), ZERO_BLOCK], "int32")
    first = np.array([groups[p][0] for p in blocks.tolist()])
    last = first + np.array([groups[p][1] for p in blocks.tolist()]) - 1
    within = [np.nonzero((first <= g) & (g <= last))[0] for g in range(last.max() + 1)]

    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), _ROWS):
                pdf = batch.iloc[lo:lo + _ROWS]
                unit, _ = _unit(_as_matrix(pdf["_v"].tolist(), pivots.shape[1]))
                a = _angles(unit, pivots)
                kth = pdf["_kth"].to_numpy(float) if again else np.full(len(pdf), np.nan)
                if again:
                    reach = np.where(np.isnan(kth), np.pi, np.arccos(np.clip(np.nan_to_num(kth, nan=-1.0), -1.0, 1.0)))
                    visit = (counts > 0) & (a - radius <= reach[:, None] + ANGLE_SLACK)
                else:
                    visit = _nearest_blocks(a, counts, k)
                visit = np.concatenate([visit, ((np.isnan(kth) | (kth <= ANGLE_SLACK)) & (zeros > 0) & again)[:, None]], 1)
                keys, vecs = pdf[q_key].to_numpy(), pdf["_v"].to_numpy()
                for g, here in enumerate(within):
                    some = visit[:, here]
                    rows = np.nonzero(some.any(1))[0]
                    if len(rows):
                        yield pd.DataFrame({q_key: keys[rows], "_v": vecs[rows], "_kth": kth[rows], "_group": np.int32(g),
                                            "_blocks": [blocks[here[some[i]]].tobytes() for i in rows], "_n": some[rows][:, first[here] == g].sum(1).astype("int32")})
    return queries.mapInPandas(run, schema)


def _scored(visits: DataFrame, points: DataFrame, k: int, q_key: str, p_keys: list[str], groups: dict[int, tuple[int, int]], query_parts: int,
            fields: list[T.StructField]) -> DataFrame:
    """The k best points of each query in each group it visits, by (group, part of the queries); those under its ``_kth`` are left out."""
    where = F.broadcast(points.sparkSession.createDataFrame([(p, *g) for p, g in groups.items()], "_pivot int, _first int, _parts int"))  # MAX_PIVOTS + 1 rows
    left = visits.drop("_n").withColumn("_qp", F.pmod(F.xxhash64(q_key), F.lit(query_parts)).cast("int"))
    right = (points.join(where, "_pivot").withColumn("_group", (F.col("_first") + F.pmod(F.xxhash64(*p_keys), F.col("_parts"))).cast("int"))
             .withColumn("_qp", F.explode(F.sequence(F.lit(0), F.lit(query_parts - 1)))).drop("_first", "_parts", "_angle"))

    def run(pts: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        if not len(pts) or not len(qs):
            return pd.DataFrame({c: [] for c in [q_key, *p_keys, "score"]})
        dim = max(map(len, [*pts["_v"], *qs["_v"]]))
        qm, pm, keys = _as_matrix(qs["_v"].tolist(), dim), _as_matrix(pts["_v"].tolist(), dim), [_sortable(pts[c].to_numpy()) for c in p_keys]
        floor = qs["_kth"].fillna(-np.inf).to_numpy(float)
        asked = [np.frombuffer(b, "int32") for b in qs["_blocks"]]
        row, block = np.repeat(np.arange(len(qs)), [len(b) for b in asked]), np.concatenate(asked)
        score, best = np.full((len(qs), k), -np.inf), [np.zeros((len(qs), k), x.dtype) for x in keys]
        of = pts["_pivot"].to_numpy()
        for p in np.unique(of):
            rows = row[block == p]
            if len(rows):
                found = Block([x[of == p] for x in keys], pm[of == p], k).search(qm[rows], k, floor[rows])
                if found is not None:
                    score[rows], merged = _merge((score[rows], [x[rows] for x in best]), found, k)
                    for x, m in zip(best, merged, strict=True):
                        x[rows] = m
                    floor[rows] = np.maximum(floor[rows], score[rows, -1])
        ok = np.isfinite(score) & (score >= qs["_kth"].fillna(-np.inf).to_numpy(float)[:, None] - ANGLE_SLACK)
        res = pd.DataFrame({c: x[ok] for c, x in zip(p_keys, best, strict=True)})
        res.insert(0, q_key, qs[q_key].to_numpy()[np.nonzero(ok)[0]])
        res["score"] = score[ok]
        return res
    return right.groupBy("_group", "_qp").cogroup(left.groupBy("_group", "_qp")).applyInPandas(run, T.StructType(fields))


def knn_topk_pruned(queries: DataFrame, points: DataFrame, k: int = DEFAULT_TOP_K, q_key: str = "qid", p_keys: list[str] | None = None,
                    q_vec: str = "embedding", p_vec: str = "embedding", max_pivots: int = MAX_PIVOTS, pivot_points: int = PIVOT_POINTS,
                    max_block_bytes: int = DEFAULT_MAX_BLOCK_BYTES, stats: dict | None = None) -> DataFrame:
    """V8 batch, as ``knn_topk``: ``(q_key, *p_keys, score, rank)``; blocks out of reach are never scored.

    Query keys are unique; a NULL key takes no part. ``stats`` (optional) receives ``cells`` (queries times blocks) and ``scored`` of them.
    """
    p_keys = list(p_keys or ["point_id"])
    fields = [T.StructField(q_key, queries.schema[q_key].dataType)] + [points.schema[c] for c in p_keys] + [T.StructField("score", T.DoubleType())]
    spark = queries.sparkSession
    out_schema = T.StructType([*fields, T.StructField("rank", T.IntegerType())])
    order = [F.col("score").desc(), *[F.col(c).asc() for c in p_keys]]

    def ranked(df: DataFrame) -> DataFrame:
        return df.withColumn("rank", F.row_number().over(Window.partitionBy(q_key).orderBy(*order))).where(F.col("rank") <= k)
    if k is None or k <= 0:
        return spark.createDataFrame([], out_schema)
    pts = _plain(points, p_keys, p_vec)
    qs = _stored(_plain(queries.where(F.col(q_key).isNotNull()), [q_key], q_vec), "knn-queries")
    some = F.exists("_v", lambda x: x != 0)
    n = pts.where(some).count()
    wanted = min(max_pivots, max(1, n // pivot_points))
    drawn = pts.where(some).orderBy(F.xxhash64(*p_keys), *p_keys).select("_v").limit(wanted).collect()
    if drawn:
        pivots, _ = _unit(np.array([r["_v"] for r in drawn]))
        pts = _stored(_assigned(pts, pivots), "knn-points")
        blocks = {r["_pivot"]: r for r in pts.groupBy("_pivot").agg(F.count(F.lit(1)).alias("n"), F.max("_angle").alias("r")).collect()}
        sizes = {p: r["n"] for p, r in blocks.items()}
        counts = np.array([sizes.get(i, 0) for i in range(len(pivots))])
        radius = np.array([blocks[i]["r"] if i in blocks else 0.0 for i in range(len(pivots))])
        seeing = qs.where(some)
        row_bytes, tasks = 8 * pivots.shape[1] + 64, int(spark.conf.get("spark.sql.shuffle.partitions"))
        limit, n_q = max(1, max_block_bytes // row_bytes), seeing.count()
        groups = _groups(pivots, sizes, min(limit, math.ceil(sum(sizes.values()) / math.ceil(math.sqrt(tasks)))))
        args = (pivots, counts, radius, sizes.get(ZERO_BLOCK, 0), k, groups)
        score = (k, q_key, p_keys, groups, max(1, math.ceil(n_q / limit), math.ceil(min(tasks, n_q) / len(groups))), fields)
        first = _stored(_visits(seeing, q_key, *args, False), "knn-visits")
        best = _stored(ranked(_scored(first, pts, *score)), "knn-first").drop("rank")
        kth = best.groupBy(q_key).agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("_kth"))
        more = _stored(_visits(seeing.join(kth, q_key, "left"), q_key, *args, True), "knn-visits")
        if stats is not None:
            n = lambda v: v.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
            stats.update(cells=n_q * len(sizes), scored=n(first) + n(more))
        found = ranked(_scored(more, pts, *score))  # the first blocks are in reach and come again
    else:
        seeing, found = qs, spark.createDataFrame([], out_schema)
    # a zero query, or any query where all points are zero, scores 0 with every point
    level = qs.where(~some) if drawn else seeing
    lowest = pts.select(*p_keys).orderBy(*p_keys).limit(k)  # k rows
    flat = ranked(level.select(q_key).crossJoin(F.broadcast(lowest)).withColumn("score", F.lit(0.0)))
    return found.select(*[f.name for f in out_schema]).unionByName(flat.select(*[f.name for f in out_schema]))
