"""Approximate nearest neighbours with balanced posting lists.

*Fit.* Centroids are the means of the leaves of a balanced bisection of a bounded sample: each split is at the median along
the line between two 2-means centres, so lists hold about equally many vectors. Many lists are fitted in two levels: a small sample
gives coarse cells, and tasks bisect each cell's share of a sample of ``FIT_ROWS`` vectors a list, enough that a sampled vector hardly moves its own
centroid. A graph links each centroid to its nearest ones; it lives in memory and is bounded by ``MAX_LISTS``.

*Index.* Every vector goes to its nearest list and, if it lies near a boundary, to further ones: those not much farther than
the nearest. Lists are split over cells by their measured size, so a list of any size is searched by many tasks.

*Search.* A best-first walk of the graph finds a query's nearest centroids; those within a ratio of the nearest distance
are probed (more, until the lists hold enough vectors). A query whose walk ends before that ratio is measured against
all centroids, so no number of lists cuts its choice. Distances inside a list are exact, in double precision.

Of equal vectors only the k + 1 smallest ids can be among anyone's k nearest (ties go to the smaller id), so only
these are indexed: nothing a search could return is left out.

Edge cases: vectors that are NULL, empty, zero, of another length than most, or that hold a NULL or non-finite component
take no part, nor do rows without an id; repeated rows count once; fewer candidates than k are all returned; no
vectors give an empty result; extra columns are ignored. Where components are so large or small that squares would leave the
range of doubles, vectors are scaled for the search, and each distance by its own largest difference.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparqa.llm.common import stored

#: Bound on the rows that one fit is made on in the driver, sampled vectors a list (MAX_LISTS times as many at most are fitted on in tasks),
#: wanted vectors per list, bound on the lists, coarse cells of a fit in two levels.
SAMPLE_ROWS = 20_000
FIT_ROWS = 64
LIST_ROWS = 512
MAX_LISTS = 16_384
COARSE = 128
#: Boundary vectors: most lists of one vector, and how much farther than the nearest centroid.
REPLICAS = 4
REPLICA_RATIO = 1.10
#: Probes: how much farther than the nearest centroid, and lists that a walk keeps before all centroids are measured.
PROBE_RATIO = 1.15
BEAM = 128
DEGREE = 16
#: Posted vectors of a cell.
CELL_ROWS = 1024
#: Largest components between these need no scaling.
PLAIN_RANGE = (1e-100, 1e100)


def fit(x: np.ndarray, n_lists: int, seed: int = 3) -> np.ndarray:
    """Centroids of the leaves of a balanced bisection of ``x`` into ``n_lists`` parts."""
    rng = np.random.default_rng(seed)
    out, todo = [], [(np.arange(len(x)), n_lists)]
    while todo:
        rows, k = todo.pop()
        part = x[rows]
        if k <= 1 or len(rows) < 2:
            out.append(part.mean(0))
            continue
        c = part[rng.choice(len(rows), 2, replace=False)]
        for _ in range(6):
            near = ((part - c[0]) ** 2).sum(1) <= ((part - c[1]) ** 2).sum(1)
            if near.all() or not near.any():
                break
            c = np.stack([part[near].mean(0), part[~near].mean(0)])
        order = np.argsort(part @ (c[1] - c[0]), kind="stable")
        cut = len(rows) * (k // 2) // k
        todo += [(rows[order[:cut]], k // 2), (rows[order[cut:]], k - k // 2)]
    return np.unique(np.stack(out), axis=0)


class Graph:
    """Centroids, each linked to its nearest and to some others far away."""

    def __init__(self, centroids: np.ndarray, degree: int = DEGREE, seed: int = 5, scale: float = 1.0):
        self.c = np.ascontiguousarray(centroids, np.float64)
        self.scale = scale  # vectors are divided by it before they are compared with the centroids
        n = len(self.c)
        rng = np.random.default_rng(seed)
        k = min(degree, n - 1)
        links = np.empty((n, k + 4 if n > 1 else 0), np.int64)
        for lo in range(0, n if k > 0 else 0, 1024):
            d = ((self.c[lo:lo + 1024] ** 2).sum(1)[:, None] + (self.c ** 2).sum(1) - 2 * self.c[lo:lo + 1024] @ self.c.T)
            d[np.arange(len(d)), np.arange(lo, lo + len(d))] = np.inf
            links[lo:lo + 1024, :k] = np.argpartition(d, k - 1, axis=1)[:, :k]
        if n > 1:
            links[:, k:] = rng.integers(0, n, (n, 4))
        self.links = links
        self.entry = np.unique(rng.integers(0, n, min(n, 16)))

    def walk(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(lists, distances) of each query's nearest centroids, ``beam`` at most, by best-first search of all queries at
        once; places that stay empty hold -1 and infinity."""
        n, width = len(self.c), min(beam, len(self.c))
        ids = np.full((len(q), width), -1)
        dist = np.full((len(q), width), np.inf)
        done = np.zeros((len(q), width), bool)
        start = self.entry[:width]
        ids[:, :len(start)] = start
        dist[:, :len(start)] = np.sqrt(((q[:, None] - self.c[start]) ** 2).sum(2))
        if n == 1:
            return ids, dist
        rows = np.arange(len(q))
        seen = np.zeros((len(q), n), bool)
        seen[:, start] = True
        while True:
            open_ = np.where(done, np.inf, dist)
            at = open_.argmin(1)
            live = np.isfinite(open_[rows, at])
            if not live.any():
                order = np.argsort(dist, axis=1, kind="stable")
                return np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
            r = rows[live]
            done[r, at[live]] = True
            near = np.sort(self.links[ids[r, at[live]]], axis=1)
            fresh = ~seen[r[:, None], near]
            fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
            seen[r[:, None], near] = True
            d = np.sqrt(((q[r][:, None] - self.c[near]) ** 2).sum(2))
            d[~fresh] = np.inf
            all_d = np.concatenate([dist[r], d], 1)
            keep = np.argpartition(all_d, width - 1, axis=1)[:, :width]
            ids[r] = np.take_along_axis(np.concatenate([ids[r], np.where(fresh, near, -1)], 1), keep, 1)
            dist[r] = np.take_along_axis(all_d, keep, 1)
            done[r] = np.take_along_axis(np.concatenate([done[r], ~fresh], 1), keep, 1)


    def all(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lists, distances) of every centroid, the nearest first."""
        d = np.sqrt(np.maximum((q ** 2).sum(1)[:, None] + (self.c ** 2).sum(1) - 2 * q @ self.c.T, 0))
        order = np.argsort(d, axis=1, kind="stable")
        return order, np.take_along_axis(d, order, 1)


def _vectors(column, scale: float = 1.0) -> np.ndarray:
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(a, pa.ChunkedArray):
        a = pa.concat_arrays(a.chunks)
    x = np.asarray(a.flatten(), np.float64).reshape(len(a), -1)
    return x if scale == 1.0 else x / scale


def _chosen(lists: np.ndarray, keep: np.ndarray) -> pa.ListArray:
    """The kept ``lists`` of each row."""
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(keep.sum(1))).astype(np.int32)), pa.array(lists[keep].astype(np.int32)))


def valid(df: DataFrame, key: str, vec: str) -> DataFrame:
    """(vec_id, v) of the rows that take part, repeated rows once; single precision is kept as it is."""
    v = F.col(vec).cast("array<float>" if df.schema[vec].dataType.simpleString() == "array<float>" else "array<double>")
    fine = (F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
            & F.exists(v, lambda x: x != 0.0))
    rows = df.select(F.col(key).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))
    rows = stored(rows.distinct(), "ann-rows")
    dims = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    return rows.filter(F.size("v") == (dims[0]["d"] if dims else 0))


def _sampled(useful: DataFrame, n: int, rows: int) -> DataFrame:
    """About ``rows`` of the ``n`` rows, the same for the same rows."""
    share = min(1.0, rows / n)
    return useful.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("vec_id", "v")


def _centroids(useful: DataFrame, n: int, n_lists: int, scale: float) -> np.ndarray:
    sample = _sampled(useful, n, SAMPLE_ROWS).toArrow().sort_by("vec_id")
    x = _vectors(sample["v"], scale) if sample.num_rows else _vectors(useful.limit(1).toArrow()["v"], scale)
    if n_lists * FIT_ROWS <= len(x) or n_lists <= COARSE:
        return fit(x, n_lists)
    coarse = Graph(fit(x, COARSE))
    wide = _sampled(useful, n, n_lists * FIT_ROWS)
    kind = useful.schema["v"].dataType.simpleString()

    def deal(batches):
        for t in batches:
            cell = np.concatenate([coarse.all(_vectors(t.column("v").slice(lo, 4096), scale))[0][:, 0] for lo in range(0, t.num_rows, 4096)]) if t.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), t.column("vec_id"), t.column("v")], ["cell", "vec_id", "v"])
    dealt = stored(wide.mapInArrow(deal, f"cell int, vec_id long, v {kind}"), "ann-fit")
    per_list = dealt.count() / n_lists

    def fit_cell(t: pa.Table) -> pa.Table:
        t = t.sort_by("vec_id")
        c = fit(_vectors(t["v"], scale), max(1, round(t.num_rows / per_list)))
        return pa.table({"cell": pa.array([t["cell"][0].as_py()] * len(c), pa.int32()), "c": pa.array(c.tolist(), pa.list_(pa.float64()))})
    found = dealt.groupBy("cell").applyInArrow(fit_cell, "cell int, c array<double>").toArrow()  # one row a list
    return np.unique(_vectors(found["c"]), axis=0)


def build(rows: DataFrame, k: int) -> tuple[DataFrame, Graph | None]:
    """The postings (list, vec_id, v) of ``rows`` (vec_id, v), and the graph of the lists."""
    rank = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    useful = stored(rows.withColumn("_r", rank).filter(F.col("_r") <= k + 1).drop("_r"), "ann-useful")
    n = useful.count()
    kind = rows.schema["v"].dataType.simpleString()
    if not n:
        return useful.sparkSession.createDataFrame([], f"list int, vec_id long, v {kind}"), None
    scale = useful.agg(F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))))).first()[0]
    scale = 1.0 if PLAIN_RANGE[0] <= scale <= PLAIN_RANGE[1] else scale
    graph = Graph(_centroids(useful, n, max(1, min(MAX_LISTS, n // LIST_ROWS)), scale), scale=scale)

    def post(batches):
        for t in batches:
            for lo in range(0, t.num_rows, 1024):
                part = t.slice(lo, 1024)
                v = _vectors(part.column("v"), graph.scale)
                lists, dist = graph.walk(v, 4 * REPLICAS)
                lists, dist = lists[:, :REPLICAS], dist[:, :REPLICAS]
                keep = np.isfinite(dist) & (dist <= REPLICA_RATIO * dist[:, :1])
                yield pa.RecordBatch.from_arrays([_chosen(lists, keep), part.column("vec_id"), part.column("v")], ["lists", "vec_id", "v"])
    # a vector is stored once with its lists
    posted = stored(useful.mapInArrow(post, f"lists array<int>, vec_id long, v {kind}"), "ann-postings")
    return posted.select(F.explode("lists").alias("list"), "vec_id", "v"), graph


def _probe(graph: Graph, counts: dict[int, int], enough: int):
    size = np.array([counts.get(i, 0) for i in range(len(graph.c))])
    beam = max(1, min(BEAM, len(graph.c)))

    def run(batches):
        for t in batches:
            for lo in range(0, t.num_rows, 1024):
                part = t.slice(lo, 1024)
                v = _vectors(part.column("v"), graph.scale)
                lists, dist, keep = chosen(*graph.walk(v, beam))
                # the walk ended inside the ratio, or before it met enough vectors or all it asked for
                short = keep[:, -1] | ~np.isfinite(dist[:, -1]) if beam < len(graph.c) else ~np.isfinite(dist).all(1)
                done = np.flatnonzero(~short)
                yield from out(part, done, lists[done], keep[done])
                short = np.flatnonzero(short)
                for i in range(0, len(short), 128):
                    rows = short[i:i + 128]
                    lists, _, keep = chosen(*graph.all(v[rows]))
                    yield from out(part, rows, lists, keep)

    def chosen(lists: np.ndarray, dist: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        have = np.cumsum(size[lists], axis=1) - size[lists]
        return lists, dist, np.isfinite(dist) & ((dist <= PROBE_RATIO * dist[:, :1]) | (have < enough))

    def out(part: pa.RecordBatch, rows: np.ndarray, lists: np.ndarray, keep: np.ndarray):
        if len(rows):
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays([_chosen(lists, keep), part.column("vec_id").take(at), part.column("v").take(at)], ["lists", "query_id", "q"])
    return run


def _distances(a: np.ndarray, b: np.ndarray, scale: float) -> np.ndarray:
    """Euclidean distances row by row."""
    if scale == 1.0:
        return np.sqrt(((a - b) ** 2).sum(1))
    d = np.abs(a - b)
    top = d.max(1)
    ok = (top > 0) & np.isfinite(top)
    unit = d / np.where(ok, top, 1.0)[:, None]
    return np.where(ok, top * np.sqrt((np.where(ok[:, None], unit, 0.0) ** 2).sum(1)), top)


def _nearest(k: int, scale: float):
    def run(queries: pa.Table, posted: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not queries.num_rows or not posted.num_rows:
            return schema.empty_table()
        q_list, q_id, q = queries["list"].to_numpy(), queries["query_id"].to_numpy(), _vectors(queries["q"])
        p_list, p_id, p = posted["list"].to_numpy(), posted["vec_id"].to_numpy(), _vectors(posted["v"])
        order = np.argsort(p_list, kind="stable")
        p_list, p_id, p = p_list[order], p_id[order], p[order]
        raw_q, raw_p, q, p = q, p, q / scale, p / scale
        norm = (p ** 2).sum(1)
        out = []
        for l in np.unique(q_list):
            a, b = np.searchsorted(p_list, [l, l + 1])
            mine = np.flatnonzero(q_list == l)
            for lo in range(0, len(mine), 256):
                part = mine[lo:lo + 256]
                if a == b:
                    continue
                d = norm[a:b] - 2 * q[part] @ p[a:b].T
                d[q_id[part][:, None] == p_id[a:b]] = np.inf
                kth = np.partition(d, min(k, b - a) - 1, axis=1)[:, min(k, b - a) - 1]
                i, j = np.nonzero((d <= kth[:, None] + 1e-9 * (1 + np.abs(kth[:, None]))) & np.isfinite(d))
                exact = _distances(raw_q[part[i]], raw_p[a + j], scale)
                out.append((q_id[part[i]], p_id[a + j], exact))
        if not out:
            return schema.empty_table()
        i, j, d = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.lexsort([j, d, i])
        i, j, d = i[order], j[order], d[order]
        first = np.ones(len(i), bool)  # a vector met in two lists counts once
        first[1:] = (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        i, j, d = i[first], j[first], d[first]
        head = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
        rank = np.arange(len(i)) - np.repeat(head, np.diff(np.append(head, len(i))))
        keep = rank < k
        return pa.table([pa.array(i[keep]), pa.array(j[keep]), pa.array(d[keep])], schema=schema)
    return run


def search(queries: DataFrame, postings: DataFrame, graph: Graph, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest posted vectors of each query (vec_id, v), its own id left out."""
    per = postings.groupBy("list").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["list"]: r["n"] for r in per.collect()}  # a number per list, at most MAX_LISTS
    total = sum(counts.values())
    kind = queries.schema["v"].dataType.simpleString()
    probes = stored(queries.mapInArrow(_probe(graph, counts, 4 * REPLICAS * (k + 1)), f"lists array<int>, query_id long, q {kind}"), "ann-probes")
    probes = probes.select(F.explode("lists").alias("list"), "query_id", "q")
    cells = max(1, -(-total // CELL_ROWS))
    per = F.broadcast(per.withColumn("_parts", F.ceil(F.col("n") / CELL_ROWS).cast("int")).drop("n"))
    cell = lambda part: F.pmod(F.xxhash64(F.floor(F.col("list") * F.lit(cells) / F.lit(len(graph.c))), part), F.lit(cells)).cast("int")
    right = postings.join(per, "list").withColumn("cell", cell(F.pmod(F.xxhash64("vec_id"), F.col("_parts")))).drop("_parts")
    left = (probes.join(per, "list").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
            .withColumn("cell", cell(F.col("_part").cast("long"))).select("cell", "list", "query_id", "q").distinct())
    found = left.groupBy("cell").cogroup(right.select("cell", "list", "vec_id", "v").toDF("cell", "list", "vec_id", "v").groupBy("cell")).applyInArrow(
        _nearest(k, graph.scale), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).withColumn("rank", F.row_number().over(best))
            .filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def nearest(df: DataFrame, k: int = 10, key: str = "vec_id", vec: str = "embedding", every: int = 100) -> DataFrame:
    """The k nearest neighbours of the rows whose id is divisible by ``every``, among all rows."""
    rows = valid(df, key, vec)
    postings, graph = build(rows, k)
    if graph is None:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return search(rows.filter(F.col("vec_id") % every == 0), postings, graph, k)
