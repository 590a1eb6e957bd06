import numpy as np
from pyspark.sql import functions as F

from sparqa.operators.knn import knn_single, knn_topk


def _brute(q, p, k):
    out = {}
    for qi, qv in q.items():
        sc = []
        for pi, pv in p.items():
            den = np.sqrt(qv @ qv) * np.sqrt(pv @ pv)
            sc.append((-(qv @ pv / den if den else 0.0), pi))
        out[qi] = [pi for _, pi in sorted(sc)[:k]]
    return out


def _frames(spark, q, p):
    qd = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in q.items()], "qid long, embedding array<double>")
    pd_ = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in p.items()],
                                "point_id long, embedding array<double>").repartition(3)
    return qd, pd_


def test_matches_brute_force_and_blocks(spark):
    rng = np.random.default_rng(7)
    q = {i: rng.normal(size=8) for i in range(13)}
    p = {i: rng.normal(size=8) for i in range(200)}
    qd, pdf = _frames(spark, q, p)
    exp = _brute(q, p, 4)
    for block in (1 << 20, 200):  # one block, then many query blocks
        hits = knn_topk(qd, pdf, 4, max_block_bytes=block).collect()
        got = {}
        for r in sorted(hits, key=lambda r: (r.qid, r["rank"])):
            got.setdefault(r.qid, []).append(r.point_id)
        assert got == exp


def test_ties_zero_vector_and_k_larger_than_collection(spark):
    q = {0: np.array([1.0, 0.0]), 1: np.array([0.0, 0.0])}
    p = {5: np.array([2.0, 0.0]), 3: np.array([1.0, 0.0]), 9: np.array([0.0, 1.0])}
    qd, pdf = _frames(spark, q, p)
    rows = knn_topk(qd, pdf, 10).orderBy("qid", "rank").collect()
    assert [(r.qid, r.point_id, round(r.score, 9)) for r in rows] == [
        (0, 3, 1.0), (0, 5, 1.0), (0, 9, 0.0), (1, 3, 0.0), (1, 5, 0.0), (1, 9, 0.0)]


def test_empty_collection_and_k_zero(spark):
    qd, pdf = _frames(spark, {0: np.array([1.0, 0.0])}, {1: np.array([1.0, 0.0])})
    assert knn_topk(qd, pdf.limit(0), 3).count() == 0
    assert knn_topk(qd, pdf, 0).count() == 0
    assert knn_topk(qd.limit(0), pdf, 3).count() == 0


def test_single_query_path(spark):
    rng = np.random.default_rng(3)
    p = {i: rng.normal(size=5) for i in range(50)}
    _, pdf = _frames(spark, {0: np.ones(5)}, p)
    got = [r.point_id for r in knn_single(np.ones(5), pdf, 3).collect()]
    assert got == _brute({0: np.ones(5)}, p, 3)[0]


def test_plan_has_no_cross_join(spark):
    rng = np.random.default_rng(1)
    qd, pdf = _frames(spark, {i: rng.normal(size=4) for i in range(3)}, {i: rng.normal(size=4) for i in range(30)})
    plan = knn_topk(qd, pdf, 2)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = knn_topk(qd, pdf, 2)._jdf.queryExecution().executedPlan().toString()
        assert "WindowGroupLimit" in plan and "MapInPandas" in plan
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert F is not None


def test_heavy_duplicates_keep_exact_tie_order(spark):
    # a third of the points are the same vector: ties everywhere, resolved by key
    rng = np.random.default_rng(11)
    p = {i: (np.array([1.0, 2.0, 3.0]) if i % 3 == 0 else rng.normal(size=3)) for i in range(300)}
    q = {0: np.array([1.0, 2.0, 3.0]), 1: rng.normal(size=3), 2: np.array([-1.0, -2.0, -3.0])}
    qd, pdf = _frames(spark, q, p)
    got = {}
    for r in sorted(knn_topk(qd, pdf, 5).collect(), key=lambda r: (r.qid, r["rank"])):
        got.setdefault(r.qid, []).append(r.point_id)
    assert got == _brute(q, p, 5)
    assert got[0] == [0, 3, 6, 9, 12]


def test_retrieval_scores_ordered_and_bounded(spark):
    from sparqa.plans import queries as Q
    hits = Q.QUERIES["retrieve_topk"](spark, "/root/testdata/sf0.001").collect()
    by_q = {}
    for r in hits:
        assert -1.0 - 1e-12 <= r.score <= 1.0 + 1e-12
        by_q.setdefault(r.qid, []).append((r["rank"], r.score))
    for lst in by_q.values():
        scores = [s for _, s in sorted(lst)]
        assert scores == sorted(scores, reverse=True)
        assert [rk for rk, _ in sorted(lst)] == list(range(1, len(lst) + 1))


def test_retrieve_with_duplicate_points(spark):
    from sparqa.operators.answer import retrieve

    def emb(texts):
        return np.array([[1.0, float(len(t) % 3)] for t in texts])

    pts = spark.createDataFrame([(1, 0, "aaa", [1.0, 0.0]), (2, 0, "bb", [0.0, 1.0])],
                                "doc_id long, pos int, text string, embedding array<double>")
    dup = pts.unionByName(pts.where("doc_id = 1"))  # the same point appended twice
    q = spark.createDataFrame([(7, "xyz")], "qid long, question string")
    rows = sorted((r["rank"], r.doc_id, r.text) for r in retrieve(q, dup, 3, embedder=emb).collect())
    assert rows == [(1, 1, "aaa"), (2, 1, "aaa"), (3, 2, "bb")]


def test_embedding_helpers(spark):
    from sparqa.operators.embed import embedding_dim, probe_dimension, to_float32
    df = spark.createDataFrame([([0.5, 1.0],), ([2.0, 3.0, 4.0],)], "e array<double>")
    r = embedding_dim(df, "e").first()
    assert (r.min_dim, r.max_dim, r.n_vectors) == (2, 3, 2)
    assert probe_dimension(spark) == 16
    assert df.select(to_float32("e").alias("f")).schema["f"].dataType.simpleString() == "array<float>"


def test_points_that_share_keys_keep_their_texts(spark):
    from sparqa.operators.answer import retrieve
    from sparqa.operators.collection import to_points
    from sparqa.operators.embed import embed
    chunks = spark.createDataFrame([(1, 0, "apple banana"), (1, 0, "zebra yak"), (1, 0, "zebra yak")], "doc_id long, pos int, chunk string")
    points = to_points(embed(chunks, "chunk"))
    qs = spark.createDataFrame([(5, "zebra yak")], "qid long, question string")
    got = [(r.rank, r.text, round(r.score, 6)) for r in retrieve(qs, points, 3).orderBy("rank").collect()]
    assert [g[:2] for g in got] == [(1, "zebra yak"), (2, "zebra yak"), (3, "apple banana")]
    assert got[0][2] == 1.0 > got[2][2]


def test_grid_of_many_blocks_and_empty_sides(spark):
    rng = np.random.default_rng(4)
    pts = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(60)]
    df = spark.createDataFrame(pts, "point_id long, embedding array<double>").repartition(5)
    qs = df.withColumnRenamed("point_id", "qid")
    stats: dict = {}
    rows = lambda d: sorted((r.qid, r["rank"], r.point_id) for r in d.collect())
    many = rows(knn_topk(qs, df, 3, max_block_bytes=600, stats=stats))
    assert stats["n_blocks"] > 1 and stats["n_point_blocks"] > 1
    assert many == rows(knn_topk(qs, df, 3)) and len(many) == 180
    assert rows(knn_topk(qs.limit(0), df, 3)) == [] == rows(knn_topk(qs, df.limit(0), 3))


def test_block_search_is_exact_where_single_precision_ties():
    from sparqa.operators.knn import Block
    rng = np.random.default_rng(6)
    base = rng.normal(size=12)
    m = base + 1e-9 * rng.normal(size=(4000, 12))  # alike in single precision
    m[1000:3000] = m[7]  # far more equal vectors than places
    m[5], m[6, 2] = 0.0, np.nan
    keys = rng.permutation(4000)
    q = np.concatenate([m[7:8], base + 1e-9 * rng.normal(size=(30, 12)), -base[None], np.zeros((1, 12))])
    score, (found,) = Block([keys], m, 4).search(q, 4)
    nm, nq = np.sqrt((m * m).sum(1)), np.sqrt((q * q).sum(1))
    for i, (v, nv) in enumerate(zip(q, nq, strict=True)):
        s = np.einsum("ij,ij->i", np.repeat(v[None], 4000, 0), m) / np.where(nm * nv == 0, 1, nm * nv)
        s[6] = -np.inf
        top = np.lexsort((keys, -s))[:4]
        assert found[i].tolist() == keys[top].tolist() and np.array_equal(score[i], s[top])


def test_grid_moves_few_rows():
    from sparqa.operators.knn import _grid
    n_q, n_p = 140_000, 4_300_000
    q, p = _grid(n_q, n_p, 192, 3, 1, 25, 200)
    assert q * p >= 200 and p < 100  # one query block would bring back 3 rows for each of 200 point blocks
    assert _grid(10, 10, 192, 3, 1, 1, 200) == (1, 1) and _grid(10, 10, 192, 3, 4, 3, 2) == (4, 3)


def test_few_points_of_a_block_are_scored_one_by_one(monkeypatch):
    from sparqa.operators import knn
    rng = np.random.default_rng(5)
    points, queries, scored = rng.normal(size=(40_000, 16)), rng.normal(size=(300, 16)), []
    einsum = np.einsum
    monkeypatch.setattr(knn.np, "einsum", lambda how, a, b: scored.append(len(a)) or einsum(how, a, b))
    best, (keys,) = knn.Block([np.arange(len(points))], points, 3).search(queries, 3)
    assert sum(scored) <= 6 * len(queries)  # of 40,000 each
    s = queries @ points.T / np.linalg.norm(queries, axis=1)[:, None] / np.linalg.norm(points, axis=1)
    assert (keys == np.argsort(-s, axis=1)[:, :3]).all() and np.allclose(best, -np.sort(-s, axis=1)[:, :3])


def test_block_of_equal_proportional_and_odd_vectors():
    from sparqa.operators import knn
    rng = np.random.default_rng(6)
    points, queries = rng.integers(-1, 2, (9_000, 3)).astype(float), rng.integers(-1, 2, (40, 3)).astype(float)
    points[::7] *= 3
    points[5, 0], points[9, 1], queries[3, 0] = np.nan, np.inf, np.nan
    live = np.isfinite(points).all(axis=1)
    for k in (1, 3, 40):
        best, (keys,) = knn.Block([np.arange(len(points))], points, k).search(queries, k)
        for q, b, got in zip(queries, best, keys):
            if np.isnan(q).any():
                assert np.isinf(b).all()
                continue
            den = np.linalg.norm(q) * np.linalg.norm(points[live], axis=1)
            s = np.where(den > 0, points[live] @ q / np.where(den > 0, den, 1), 0)
            # scores that differ by rounding only tie in exact arithmetic
            assert np.allclose(b, -np.sort(-s)[:k]) and len(set(got)) == k
            assert np.allclose(s[np.searchsorted(np.flatnonzero(live), got)], b)


def test_copies_beyond_k_are_left_out_of_a_block():
    from sparqa.operators import knn
    m = np.repeat(np.random.default_rng(8).normal(size=(50, 4)), 20, axis=0)
    kept = knn.Block._first_of_equal(m, 3)
    assert kept.tolist() == [i for i in range(1000) if i % 20 < 3]


def _odd_points(rng, n, d):
    m = rng.normal(size=(n, d))
    m[::9] = m[4]  # a hot vector
    m[1::50], m[2::60, 0], m[3::70, 1] = 0.0, np.nan, np.inf
    m[7::40] = 3 * m[8]  # proportional: equal angles
    return m


def test_leaves_find_what_the_block_finds():
    from sparqa.operators import knn
    rng = np.random.default_rng(3)
    block = knn.Block([rng.permutation(20_000)], _odd_points(rng, 20_000, 6), 3)
    q = np.concatenate([rng.normal(size=(700, 6)), block.m[:40], np.zeros((2, 6)), np.full((1, 6), np.nan)])
    for k in (1, 3, 40):
        want, (keys,) = block.search(q, k)
        for floor in (None, want[:, -1] - 0.01, np.where(np.arange(len(q)) % 2, -np.inf, want[:, -1])):
            got, (found,) = knn.Leaves(block).search(q, k, floor)
            assert np.array_equal(got, want) and np.array_equal(found[np.isfinite(got)], keys[np.isfinite(want)])


def test_leaves_out_of_reach_are_not_scored():
    from sparqa.operators import knn
    rng = np.random.default_rng(4)
    points, queries, cells = rng.normal(size=(40_000, 8)), rng.normal(size=(600, 8)), []
    leaves = knn.Leaves(knn.Block([np.arange(len(points))], points, 3))

    class Seen(np.ndarray):
        def __array_ufunc__(self, ufunc, method, *inputs, **kw):
            inputs = [np.asarray(x) for x in inputs]
            if ufunc is np.matmul:
                cells.append(inputs[0].shape[0] * inputs[1].shape[1])
            return getattr(ufunc, method)(*inputs, **kw)
    leaves.points = leaves.points.view(Seen)
    best, (keys,) = leaves.search(queries, 3)
    assert 0 < sum(cells) < 0.2 * len(points) * len(queries)  # the block's own search scores them all
    s = queries @ points.T / np.linalg.norm(queries, axis=1)[:, None] / np.linalg.norm(points, axis=1)
    assert (keys == np.argsort(-s, axis=1)[:, :3]).all()


def test_blocks_by_region_give_what_one_block_gives(spark, monkeypatch):
    from sparqa.operators import knn
    monkeypatch.setattr(knn, "_LEAST_FOR_LEAVES", (1, 1))
    monkeypatch.setattr(knn, "_LEAF_POINTS", 3)
    rng = np.random.default_rng(5)
    vec = lambda m: [None if i % 83 == 0 else [float(x) for x in v] for i, v in enumerate(m)]
    pts = spark.createDataFrame([(i % 400, f"t{i}", v) for i, v in enumerate(vec(_odd_points(rng, 900, 4)))], "a long, b string, embedding array<double>").repartition(4)
    qs = spark.createDataFrame([(None if i == 5 else i, v) for i, v in enumerate(vec(_odd_points(rng, 300, 4)))], "qid long, embedding array<double>").repartition(3)
    rows = lambda **kw: sorted(map(tuple, knn.knn_topk(qs, pts, 4, "qid", ["a", "b"], **kw).collect()))
    want, stats = rows(), {}
    assert rows(max_block_bytes=9000, stats=stats) == want and len(want) > 1000
    assert stats["n_blocks"] > 1 and stats["n_point_blocks"] > 8
    # a cell searches with the bound that a query brings from its own region
    floors = []
    searched = knn._searched
    monkeypatch.setattr(knn, "_searched", lambda block, qm, k, floor=None: floors.append(floor) or searched(block, qm, k, floor))
    q = np.array([[1.0, 0.0], [0.0, 1.0]])
    run = knn._cell_topk(1, "qid", ["p"])
    import pandas as pd
    packs = pd.DataFrame({"pb": [1], "k0": [np.array([7, 8])], "m": [np.array([[1.0, 0.1], [0.1, 1.0]]).tobytes()], "d": [2]})
    asked = pd.DataFrame({"home": [0, 1], "k0": [["x"], ["y"]], "m": [q[:1].tobytes(), q[1:].tobytes()], "d": [2, 2], "floor": [np.array([f]).tobytes() for f in (0.9, 0.2)]})
    out = run(packs, asked)
    assert out["qid"].tolist() == ["x"] and out["p"].tolist() == [7] and floors[0].tolist() == [0.9]


def test_large_search_without_points_or_vectors(spark):
    from sparqa.operators import knn
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(40)], "point_id long, embedding array<double>")
    qs = df.withColumnRenamed("point_id", "qid")
    none = spark.createDataFrame([(i, None) for i in range(9)], "point_id long, embedding array<double>")
    assert knn.knn_topk(qs, df.limit(0), 3, max_block_bytes=300).count() == 0
    assert knn.knn_topk(qs, none, 3, max_block_bytes=300).count() == knn.knn_topk(qs, none, 3).count()
