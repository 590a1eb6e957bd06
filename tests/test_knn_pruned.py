"""The pruned top-k gives the rows of the plain one, and skips what it can."""

import numpy as np
import pytest

from sparqa.operators.knn import knn_topk
from sparqa.operators.knn_pruned import knn_topk_pruned


def _frames(spark, q, p):
    row = lambda i, v: (i, None if v is None else [float(x) for x in v])
    return (spark.createDataFrame([row(i, v) for i, v in q], "qid long, embedding array<double>"),
            spark.createDataFrame([row(i, v) for i, v in p], "point_id long, embedding array<double>").repartition(3))


def _rows(df):
    return sorted((r.qid, r["rank"], r.point_id, round(r.score, 12)) for r in df.collect())


def _clustered(n, d=16, clusters=12, seed=3):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(clusters, d))
    return [c[i % clusters] + 0.03 * rng.normal(size=d) for i in range(n)]


@pytest.mark.parametrize("kind", ["clustered", "random"])
def test_same_rows_as_without_pruning(spark, kind):
    rng = np.random.default_rng(5)
    x = _clustered(900) if kind == "clustered" else [rng.normal(size=16) for _ in range(900)]
    qd, pd_ = _frames(spark, list(enumerate(x[:60])), list(enumerate(x)))
    stats: dict = {}
    got = _rows(knn_topk_pruned(qd, pd_, 5, pivot_points=20, max_block_bytes=2000, stats=stats))
    assert got == _rows(knn_topk(qd, pd_, 5)) and len(got) == 300
    assert stats["cells"] == 60 * 45
    if kind == "clustered":
        assert stats["scored"] < stats["cells"] / 3


def test_bound_is_never_wrong():
    """No point of a block that is left out is nearer than the k-th found, for angles of all kinds."""
    from sparqa.operators import knn_pruned as kp
    rng = np.random.default_rng(8)
    for turn in range(200):
        d = int(rng.integers(2, 6))
        x = rng.normal(size=(40, d)) * rng.choice([1e-8, 1.0, 1e8], size=(40, 1)) + rng.choice([0.0, 5.0])
        u, _ = kp._unit(x)
        pivots = u[:6]
        a = kp._angles(u, pivots)
        block = a.argmin(1)
        counts = np.bincount(block, minlength=6)
        radius = np.array([a[block == b, b].max() if (block == b).any() else 0 for b in range(6)])
        q, _ = kp._unit(rng.normal(size=(10, d)) + (x[:10] if turn % 2 else 0))
        qa = kp._angles(q, pivots)
        first = kp._nearest_blocks(qa, counts, 3)
        score = q @ u.T
        for i in range(10):
            seen = first[i][block]
            assert seen.sum() >= 3
            kth = np.sort(score[i][seen])[-3]
            out = ~first[i] & (qa[i] - radius > np.arccos(np.clip(kth, -1, 1)) + kp.ANGLE_SLACK)
            assert not out[block].any() or score[i][out[block]].max() < kth


def test_ties_zeros_gaps_and_few_points(spark):
    x = [(5, [2.0, 0.0]), (3, [1.0, 0.0]), (9, [0.0, 1.0]), (1, [0.0, 0.0]), (2, None), (4, [float("nan"), 1.0]), (6, [-1.0, 0.0]), (7, [1.0, 0.0]), (8, [3.0, 0.0])]
    q = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [-1.0, -1.0]), (3, None)]
    qd, pd_ = _frames(spark, q, x)
    for k, pp in ((3, 1), (6, 3), (20, 100)):
        assert _rows(knn_topk_pruned(qd, pd_, k, pivot_points=pp)) == _rows(knn_topk(qd, pd_, k)), (k, pp)
    hot = [(i, [1.0, 2.0, 3.0]) for i in range(100)] + [(100 + i, list(np.random.default_rng(i).normal(size=3))) for i in range(60)]
    qd, pd_ = _frames(spark, [(0, [1.0, 2.0, 3.0]), (1, [-1.0, 0.5, 0.0])], hot)
    assert _rows(knn_topk_pruned(qd, pd_, 4, pivot_points=8, max_block_bytes=1000)) == _rows(knn_topk(qd, pd_, 4))


def test_empty_sides(spark):
    qd, pd_ = _frames(spark, [(0, [1.0, 0.0])], [(1, [1.0, 0.0]), (2, [0.0, 0.0])])
    assert knn_topk_pruned(qd, pd_.limit(0), 3).count() == 0
    assert knn_topk_pruned(qd, pd_, 0).count() == 0
    assert knn_topk_pruned(qd.limit(0), pd_, 3).count() == 0
    zeros = pd_.where("point_id = 2")
    assert _rows(knn_topk_pruned(qd, zeros, 3)) == _rows(knn_topk(qd, zeros, 3)) == [(0, 1, 2, 0.0)]


def test_a_query_travels_once_to_a_group(spark):
    """Vectors without clusters reach every block: rows of the second visit grow with the groups, not with the blocks."""
    from sparqa.operators import knn_pruned as kp
    rng = np.random.default_rng(2)
    pivots, _ = kp._unit(rng.normal(size=(64, 8)))
    groups = kp._groups(pivots, {p: 10 for p in range(64)}, 160)
    assert len({g for g, _ in groups.values()}) == 5  # 64 blocks in 4 groups, and that of zero vectors
    qs = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=8)], None) for i in range(20)], "qid long, _v array<double>, _kth double")
    rows = kp._visits(qs, "qid", pivots, np.full(64, 10), np.full(64, 0.5), 0, 3, groups, True).collect()
    assert len(rows) == 20 * 4 and sum(r["_n"] for r in rows) == 20 * 64
    split = kp._groups(pivots[:2], {0: 25, 1: 10}, 10)
    assert split[0] == (0, 3) and split[1] == (3, 1) and split[kp.ZERO_BLOCK][0] == 4
