"""Exact cosine top-k (V8) without a cross join or a driver hop.

Plan:
1. Both sides are packed where they lie into rows of a few thousand vectors each
   (``mapInPandas``). The query packs are written once: their number and size are counted there, so nothing upstream
   runs twice. Queries of ``SENT_BYTES`` at most are sent to the points and scored where these lie: no point is
   shuffled. Otherwise the packs are dealt in turn to ``q`` query blocks and ``p`` point blocks, whose numbers follow from
   row counts and a byte bound a block.
2. Points and queries are parted by regions, halves of halves of a sample along its widest directions; regions are put together to, or dealt
   out to, blocks of bounded bytes by measured row counts. Every query is searched for in the block of its own region first: the k-th score
   found there is its bound. Then query packs are repeated for every point block and point packs for every query block; a cogroup on (query
   block, point block) scores each cell of that grid under the queries' bounds and keeps only a local top-k per query, so no pair is
   ever emitted as a row. Inside a cell points lie in leaves of a few dozen near ones (``Leaves``): a query is scored against those that
   its bound lets it reach, with BLAS matmuls in single precision, and what these cannot rule out in double precision (``Block``).
   Of the grids with a cell for every task the one that moves the fewest bytes is taken.
3. A window ``row_number() <= k`` over ``(query)`` (planned as WindowGroupLimit,
   partial before the shuffle) merges the local lists; at most k x point blocks rows per
   query cross the shuffle.

Order: score descending, then the point key columns ascending (deterministic ties).
Score = dot / (sqrt(|q|^2) * sqrt(|p|^2)); 0 for a zero vector on either side.
"""

from __future__ import annotations

import math
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparqa.operators.collection import scratch_path
from sparqa.session import spread

DEFAULT_TOP_K = 3
# Vectors of one block of either side; a task holds one query block and one point block.
DEFAULT_MAX_BLOCK_BYTES = 32 << 20
# Query vectors that are sent to the points instead of meeting them in a grid.
SENT_BYTES = 8 << 20
# Vectors in one packed row.
_PACK_ROWS = 4096
# Scores held at once inside a task (queries x points slice), and pairs of them scored exactly at once.
_MAX_SCORE_CELLS = 1 << 22
_MAX_EXACT = 1 << 17
# Queries searched for at once, and points of the first slice, from which a first bound is taken.
_QUERY_ROWS = 1024
_FIRST_POINTS = 1024
# Groups of these points whose maxima give it.
_GROUPS = 32
# So few queries need no search for equal points first.
_FEW_QUERIES = 256
# Points of a leaf, of a group that is cut into leaves, and leaves a query is first held against.
_LEAF_POINTS = 48
_LEAF_GROUP = 16384
_NEAR_LEAVES = 4
# Queries that go through the leaves together, and the least queries and points for which leaves are made.
_LEAF_QUERIES = 1 << 14
_LEAST_FOR_LEAVES = (512, 8192)
# Vectors that the regions are taken from, bytes of them at most, and halvings at most.
_SAMPLE_ROWS = 20_000
_SAMPLE_BYTES = 4 << 20
_MAX_DEPTH = 11
# Leaves are left alone where queries would still meet this share of the points.
_LEAF_SHARE = 0.4


def _as_matrix(vectors, dim: int) -> np.ndarray:
    m = np.zeros((len(vectors), dim), dtype=np.float64)
    for i, v in enumerate(vectors):
        if v is not None and len(v):
            if len(v) != dim:
                raise ValueError(f"vector dimension {len(v)} differs from query dimension {dim}")
            m[i] = np.asarray(v, dtype=np.float64)
    return m


def _sortable(a: np.ndarray) -> np.ndarray:
    """Key column as an array ``lexsort`` can order (object strings -> unicode)."""
    return a.astype(str) if a.dtype == object else a


def _norms(m: np.ndarray) -> np.ndarray:
    return np.sqrt((m * m).sum(axis=1))


def _unit32(m: np.ndarray, norms: np.ndarray) -> np.ndarray:
    return (m / np.where(norms > 0, norms, 1.0)[:, None]).astype(np.float32)


class Block:
    """Points in the order of their keys, ready to be searched: of equal vectors only the ``k`` first by key are kept, as no other can be
    among a query's ``k`` best; points with a NaN or an infinite component take no part."""

    def __init__(self, keys: list[np.ndarray], matrix: np.ndarray, k: int, distinct: bool = True):
        order = np.lexsort(tuple(reversed(keys)))
        order = order[np.isfinite(matrix).all(axis=1)[order]]
        if distinct and matrix.shape[1]:
            order = order[self._first_of_equal(matrix[order] + 0.0, k)]
        self.keys, self.m = [a[order] for a in keys], matrix[order]
        self.norms = _norms(self.m)
        self.unit = _unit32(self.m, self.norms)

    @staticmethod
    def _first_of_equal(m: np.ndarray, k: int) -> np.ndarray:
        """Rows but those after the ``k`` first of equal ones (more stay where two digests are alike)."""
        bits = np.ascontiguousarray(m).view(np.uint64)
        digest = np.zeros(len(bits), dtype=np.uint64)
        for x in bits.T:
            digest = (digest ^ x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
            digest ^= digest >> np.uint64(32)
        by = np.argsort(digest, kind="stable")
        alike = np.flatnonzero(digest[by][1:] == digest[by][:-1])
        new = np.ones(len(by), dtype=bool)
        new[alike + 1] = (bits[by[alike + 1]] != bits[by[alike]]).any(axis=1)
        nth = np.arange(len(by)) - np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))
        return np.sort(by[nth < k])

    def search(self, qm: np.ndarray, k: int, floor: np.ndarray | None = None):
        """Exactly the ``k`` best points of each row of ``qm`` under (score desc, keys asc): (scores, [key arrays]), both nq x k;
        places without a point score ``-inf``. None without points. Points scored under a query's ``floor`` may be left out.

        Scores in single precision rule out every point that is surely under the k-th best found so far; what they leave
        is scored in double precision.
        """
        if not len(self.m):
            return None
        qn, nq = _norms(qm), len(qm)
        best, at = np.full((nq, k), -np.inf), np.zeros((nq, k), dtype=np.int64)
        seen = np.isfinite(qm).all(axis=1)
        zero = np.nonzero(seen & (qn == 0))[0]
        n0 = min(k, len(self.m))
        best[zero, :n0], at[zero, :n0] = 0.0, np.arange(n0)
        slack = (qm.shape[1] + 8) * 2.4e-7  # of a score in single precision, rounded generously
        asked = np.nonzero(seen & (qn > 0))[0]
        for lo in range(0, len(asked), _QUERY_ROWS):
            some = asked[lo:lo + _QUERY_ROWS]
            low = None if floor is None else floor[some] - 1e-9
            self._scan(qm[some], qn[some], some, k, slack, low, best, at)
        return best, [a[at] for a in self.keys]

    def _scan(self, qm, qn, rows, k, slack, low, best, at) -> None:
        """Slices in single precision. Of a slice, the maximum of a query's scores is compared first: only queries it can change have
        their points looked at one by one. ``top`` holds scores of k different points, so its least is a bound at any time."""
        unit, step = _unit32(qm, qn), max(1, _MAX_SCORE_CELLS // 4 // len(rows))
        low32 = np.full(len(rows), -np.inf, dtype=np.float32) if low is None else (low - slack).astype(np.float32)
        top = np.full((len(rows), k), -np.inf, dtype=np.float32)
        held = np.empty(len(rows) * min(step, len(self.m)), dtype=np.float32)
        found, n_found, lo = [], 0, 0
        while lo < len(self.m):
            hi = min(len(self.m), lo + (step if lo else min(step, _FIRST_POINTS)))
            s = np.matmul(unit, self.unit[lo:hi].T, out=held[:len(rows) * (hi - lo)].reshape(len(rows), hi - lo))
            if not lo and hi > k:
                top = _high_scores(s, k)
                np.maximum(low32, top.min(axis=1) - np.float32(2 * slack), out=low32)
            peak = s.max(axis=1)
            some = np.flatnonzero(peak >= low32)
            if len(some):
                near = s[some]
                cells = np.flatnonzero(near >= low32[some, None])
                r, c = np.divmod(cells, hi - lo)
                found.append((some[r], c + lo, near.ravel()[cells]))
                n_found += len(cells)
                if lo:
                    mine, least = top[some], top[some].argmin(axis=1)
                    mine[np.arange(len(some)), least] = np.maximum(mine[np.arange(len(some)), least], peak[some])
                    top[some] = mine
                    low32[some] = np.maximum(low32[some], mine.min(axis=1) - np.float32(2 * slack))
            if n_found >= _MAX_EXACT:
                self._settle(qm, qn, rows, k, found, low32, best, at)
                np.maximum(low32, (best[rows, -1] - slack).astype(np.float32), out=low32)
                found, n_found = [], 0
            lo = hi
        if found:
            self._settle(qm, qn, rows, k, found, low32, best, at)

    def _settle(self, qm, qn, rows, k, found, low32, best, at) -> None:
        """Scores the points found in double precision, but those that the bound has risen above, and keeps each query's best."""
        q, p, s = (np.concatenate(x) for x in zip(*found))
        still = s >= low32[q]
        q, p = q[still], p[still]
        for i in range(0, len(q), _MAX_EXACT):
            r, c = q[i:i + _MAX_EXACT], p[i:i + _MAX_EXACT]
            den = qn[r] * np.where(self.norms[c] == 0, 1.0, self.norms[c])
            exact = np.einsum("ij,ij->i", qm[r], self.m[c]) / den
            exact[np.isnan(exact)] = -np.inf
            mine = np.nonzero(np.bincount(r, minlength=len(rows)))[0]
            own = np.concatenate([np.repeat(mine, k), r])
            score = np.concatenate([best[rows[mine]].ravel(), exact])
            place = np.concatenate([at[rows[mine]].ravel(), c])
            order = np.lexsort((place, -score, own))
            starts = np.searchsorted(own[order], mine)
            first = order[starts[:, None] + np.arange(k)]
            best[rows[mine]], at[rows[mine]] = score[first], place[first]


class Leaves:
    """The points of a block in small groups of near ones. A leaf is known by its centre and by the largest angle to it of its members and of
    the nearer half of them; a query whose angle to the centre, less that angle, is above the angle of its bound has nothing to find there.

    Same results as ``Block.search``: what the angles leave is scored as there.
    """

    def __init__(self, block: Block):
        self.block = block
        unit = block.unit
        of, centre = self._near_ones(unit)
        exact = centre.astype(np.float64)
        length = _norms(exact)
        cos = np.einsum("ij,ij->i", exact[of], unit.astype(np.float64)) / np.where(length > 0, length, 1.0)[of]
        angle = np.arccos(np.clip(cos, -1.0, 1.0)) + 1e-6
        self.order = np.lexsort((-angle, of))  # a leaf's members from the outermost inwards
        n = np.bincount(of, minlength=len(centre))
        held = np.flatnonzero(n)
        self.start = (np.cumsum(n) - n)[held]
        self.end, self.half = self.start + n[held], self.start + (n[held] + 1) // 2
        self.points = np.ascontiguousarray(unit[self.order])
        self.centre = _unit32(exact, length)[held]
        outer, inner = angle[self.order][self.start], angle[self.order][np.minimum(self.half, len(self.order) - 1)]
        inner = np.where(self.half < self.end, inner, outer)
        wide = outer > np.pi / 2  # such a leaf is always looked at
        self.outer = [np.where(wide, x, f(outer)).astype(np.float32) for f, x in ((np.cos, 0.0), (np.sin, 1.0))]
        self.inner = [np.where(wide, x, f(inner)).astype(np.float32) for f, x in ((np.cos, 0.0), (np.sin, 1.0))]
        # (centre, cos, sin) of a leaf times (query, -cos, sin) of a bound is negative where the leaf is out of reach
        self.reach = np.concatenate([np.where(wide[:, None], 0.0, self.centre), self.outer[0][:, None], self.outer[1][:, None]], axis=1).astype(np.float32)

    @staticmethod
    def _near_ones(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(leaf of each point, centres): halves along the widest direction, then a few rounds of moving centres."""
        of, centres, n_leaves, todo = np.zeros(len(unit), dtype=np.int64), [], 0, [np.arange(len(unit))]
        while todo:
            some = todo.pop()
            x = unit[some]
            if len(some) > _LEAF_GROUP:
                y = x[::max(1, len(some) // 2048)].astype(np.float64)
                y -= y.mean(axis=0)
                along = x @ np.linalg.eigh(y.T @ y)[1][:, -1].astype(np.float32)
                by = np.argpartition(along, len(some) // 2)
                todo += [some[by[:len(some) // 2]], some[by[len(some) // 2:]]]
                continue
            c = x[::_LEAF_POINTS].copy()
            for last in (False, False, True):
                mine = np.concatenate([(x[lo:lo + 2048] @ c.T).argmax(axis=1) for lo in range(0, len(x), 2048)])
                if not last:
                    by = np.argsort(mine, kind="stable")
                    first = np.flatnonzero(np.diff(mine[by], prepend=-1))
                    total = np.add.reduceat(x[by], first, axis=0)
                    c[mine[by][first]] = _unit32(total, _norms(total))
            of[some] = mine + n_leaves
            centres.append(c)
            n_leaves += len(c)
        return of, np.concatenate(centres)

    def search(self, qm: np.ndarray, k: int, floor: np.ndarray | None = None):
        """As ``Block.search``."""
        block, nq, qn = self.block, len(qm), _norms(qm)
        best, at = np.full((nq, k), -np.inf), np.zeros((nq, k), dtype=np.int64)
        slack = (qm.shape[1] + 8) * 2.4e-7
        live = np.isfinite(qm).all(axis=1) & (qn > 0)
        low = np.full(nq, -np.inf, dtype=np.float32) if floor is None else (floor - 1e-9 - slack).astype(np.float32)
        asked, plain = np.flatnonzero(live), np.flatnonzero(~live)
        if len(asked):
            unit = _unit32(qm[asked], qn[asked])
            new = np.flatnonzero(np.isneginf(low[asked]))
            for lo in range(0, len(new), 512):
                low[asked[new[lo:lo + 512]]] = self._first_bound(unit[new[lo:lo + 512]], k, slack)
            some = np.arange(0, len(asked), max(1, len(asked) // 256))
            ways = self._ways(unit[some], low[asked[some]])
            if ((self.reach @ ways >= -4 * slack) * (self.end - self.start)[:, None]).mean() * len(self.start) > _LEAF_SHARE * len(self.points):
                plain = np.arange(nq)
            else:
                for lo in range(0, len(asked), _LEAF_QUERIES):
                    rows = asked[lo:lo + _LEAF_QUERIES]
                    self._scan(qm[rows], qn[rows], unit[lo:lo + _LEAF_QUERIES], rows, k, slack, low[rows], best, at)
        keys = [a[at] for a in block.keys]
        if len(plain):
            found = block.search(qm[plain], k, None if floor is None else floor[plain])
            best[plain] = found[0]
            for a, b in zip(keys, found[1], strict=True):
                a[plain] = b
        return best, keys

    def _first_bound(self, unit: np.ndarray, k: int, slack: float) -> np.ndarray:
        """A score that k points of the leaves nearest to each query reach."""
        n_near, width = min(_NEAR_LEAVES, len(self.start)), max(2 * _LEAF_POINTS, k)
        d = unit @ self.centre.T
        near = np.argpartition(d, len(self.start) - n_near, axis=1)[:, len(self.start) - n_near:]
        place = self.start[near][:, :, None] + np.arange(width)
        s = np.einsum("qlpd,qd->qlp", self.points[np.minimum(place, len(self.points) - 1)], unit)
        s[place >= self.end[near][:, :, None]] = -np.inf
        s = s.reshape(len(unit), -1)
        return np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] - np.float32(2 * slack)

    @staticmethod
    def _ways(unit: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Columns (query, -cos, sin) of the bounds; a query without a bound above 0 reaches every leaf."""
        cos = np.clip(low, 0.0, 1.0)
        free = cos <= 0
        return np.concatenate([np.where(free[:, None], 0.0, unit).T, -cos[None], np.sqrt(1 - cos * cos)[None]]).astype(np.float32)

    def _scan(self, qm, qn, unit, rows, k, slack, low32, best, at) -> None:
        block, ways = self.block, self._ways(unit, low32)
        top = np.full((len(rows), k), -np.inf, dtype=np.float32)
        margin, step, dim = np.float32(-4 * slack), max(1, _MAX_SCORE_CELLS // 4 // len(rows)), unit.shape[1]
        found, n_found = [], 0

        def note(some: np.ndarray, u: np.ndarray, lo: int, hi: int) -> int:
            """Points ``lo`` to ``hi`` that reach the bounds of the queries ``some``."""
            s = self.points[lo:hi] @ u.T
            peak = s.max(axis=0)
            hit = np.flatnonzero(peak >= low32.take(some))
            if not len(hit):
                return 0
            q, near, peak = some[hit], s[:, hit], peak[hit]
            p, c = np.nonzero(near >= low32[q])
            found.append((q[c], self.order[lo + p], near[p, c]))
            mine, least = top[q], top[q].argmin(axis=1)
            mine[np.arange(len(q)), least] = np.maximum(mine[np.arange(len(q)), least], peak)
            top[q] = mine
            low32[q] = np.maximum(low32[q], mine.min(axis=1) - np.float32(2 * slack))
            return len(p)

        for first in range(0, len(self.start), step):
            if first:
                ways = self._bounds(ways, unit, low32)
            g = self.reach[first:first + step] @ ways
            for i, row in enumerate(g, first):
                some = np.flatnonzero(row >= margin)
                if not len(some):
                    continue
                u = unit.take(some, axis=0)
                n_found += note(some, u, self.start[i], self.half[i])
                if self.half[i] < self.end[i]:
                    cos, sin = self.outer[0][i] - self.inner[0][i], self.outer[1][i] - self.inner[1][i]
                    sub = np.flatnonzero(row.take(some) - cos * ways[dim].take(some) - sin * ways[dim + 1].take(some) >= margin)
                    if len(sub):
                        n_found += note(some.take(sub), u.take(sub, axis=0), self.half[i], self.end[i])
                if n_found >= _MAX_EXACT:
                    block._settle(qm, qn, rows, k, found, low32, best, at)
                    np.maximum(low32, (best[rows, -1] - slack).astype(np.float32), out=low32)
                    found.clear()
                    n_found = 0
        if found:
            block._settle(qm, qn, rows, k, found, low32, best, at)

    def _bounds(self, ways: np.ndarray, unit: np.ndarray, low32: np.ndarray) -> np.ndarray:
        """``ways`` under the bounds of now."""
        if (ways[-2] >= 0).any():
            return self._ways(unit, low32)
        np.negative(np.minimum(low32, 1.0), out=ways[-2])
        np.sqrt(1 - ways[-2] * ways[-2], out=ways[-1])
        return ways


def _high_scores(s: np.ndarray, k: int) -> np.ndarray:
    """``k`` scores of each row: the largest of the maxima of groups of columns."""
    groups = min(s.shape[1], max(_GROUPS, 4 * k))
    wide = s.shape[1] // groups
    peaks = s[:, :groups * wide].reshape(len(s), groups, wide).max(axis=2)
    return np.partition(peaks, groups - k, axis=1)[:, groups - k:]


def _merge(best, cand, k: int):
    """Merge two (scores, keys) candidate sets row-wise, keeping the k best."""
    s = np.concatenate([best[0], cand[0]], axis=1)
    ks = [np.concatenate([a, b], axis=1) for a, b in zip(best[1], cand[1])]
    order = np.lexsort(tuple(reversed(ks)) + (-s,), axis=-1)[:, :k]
    return np.take_along_axis(s, order, axis=1), [np.take_along_axis(a, order, axis=1) for a in ks]


def _packs(df: DataFrame, keys: list[str], vec: str, block: str) -> DataFrame:
    """Rows ``(block, k0.., m, d)``: up to ``_PACK_ROWS`` vectors as one binary matrix, numbered in turn."""
    schema = T.StructType([T.StructField(block, T.IntegerType())]
                          + [T.StructField(f"k{i}", T.ArrayType(df.schema[c].dataType)) for i, c in enumerate(keys)]
                          + [T.StructField("m", T.BinaryType()), T.StructField("d", T.IntegerType())])

    def run(batches):
        turn = TaskContext.get().partitionId()
        for pdf in batches:
            for lo in range(0, len(pdf), _PACK_ROWS):
                part = pdf.iloc[lo:lo + _PACK_ROWS]
                vecs = part[vec].tolist()
                dim = next((len(v) for v in vecs if v is not None and len(v)), 0)
                row = {block: turn, "m": _as_matrix(vecs, dim).tobytes(), "d": dim}
                row.update({f"k{i}": part[c].tolist() for i, c in enumerate(keys)})
                yield pd.DataFrame([row])
                turn += 1

    return df.select(*keys, vec).mapInPandas(run, schema)


def _result(q, best, q_key: str, p_keys: list[str]) -> pd.DataFrame:
    score, ks = best
    ok = np.isfinite(score)
    res = pd.DataFrame({c: a[ok] for c, a in zip(p_keys, ks)})
    res.insert(0, q_key, [q.k0[i] for i in np.nonzero(ok)[0]])
    res["score"] = score[ok]
    return res


class Regions:
    """Halves of halves of a sample along its widest directions: near vectors are in one region or in regions of near numbers."""

    def __init__(self, sample: np.ndarray, wanted: int):
        depth = min(_MAX_DEPTH, max(0, math.ceil(math.log2(max(1, wanted)))), max(0, int(math.log2(max(1, len(sample) // 8)))))
        self.count = 1 << depth
        self.along, self.cut = np.zeros((self.count - 1, sample.shape[1])), np.zeros(self.count - 1)
        unit = sample / np.where((n := _norms(sample)) > 0, n, 1.0)[:, None]
        held = [unit]
        for i in range(self.count - 1):
            x = held[i]
            if len(x):
                y = x - x.mean(axis=0)
                self.along[i] = np.linalg.eigh(y.T @ y)[1][:, -1]
            by = x @ self.along[i]
            self.cut[i] = np.median(by) if len(x) else 0.0
            held += [x[by <= self.cut[i]], x[by > self.cut[i]]]
            held[i] = x[:0]

    def of(self, m: np.ndarray) -> np.ndarray:
        """The region of each row; rows of another length are in the first."""
        node = np.zeros(len(m), dtype=np.int64)
        if self.count > 1 and m.shape[1] == self.along.shape[1]:
            with np.errstate(all="ignore"):
                unit = m / np.where((n := _norms(m)) > 0, n, 1.0)[:, None]
                for _ in range(self.count.bit_length() - 1):
                    node = 2 * node + 1 + (np.einsum("ij,ij->i", unit, self.along[node]) > self.cut[node])
            node -= self.count - 1
        return node


def _regions(points: DataFrame, vec: str, n_p: int, dim: int, wanted: int) -> Regions:
    """Regions of a sample of bounded bytes."""
    rows = max(256, min(_SAMPLE_ROWS, _SAMPLE_BYTES // (8 * max(1, dim))))
    some = points.select(vec).where(F.size(vec) == dim)
    drawn = [r[0] for r in (some.sample(rows / n_p, seed=7) if n_p > rows else some).collect()]
    m = _as_matrix(drawn, dim) if dim else np.zeros((0, 0))
    return Regions(m[np.isfinite(m).all(axis=1)], wanted if dim else 1)


def _by_region(packs: DataFrame, n_keys: int, regions: Regions) -> DataFrame:
    """``packs`` (turn, keys, m, d) parted by region: ``region`` is added."""
    schema = T.StructType([T.StructField("region", T.IntegerType()), *packs.schema.fields])
    turn_col = packs.columns[0]

    def run(batches):
        for pdf in batches:
            for p in pdf.itertuples(index=False):
                n = len(p.k0)
                m = np.frombuffer(p.m, dtype=np.float64).reshape(n, p.d) if p.d else np.zeros((n, 0))
                of = regions.of(m)
                by = np.argsort(of, kind="stable")
                ends = [*np.flatnonzero(np.diff(of[by])) + 1, n]
                out, lo = [], 0
                for hi in ends:
                    some = by[lo:hi]
                    row = {"region": int(of[some[0]]), turn_col: p[0]}
                    row.update({f"k{i}": [p[1 + i][j] for j in some] for i in range(n_keys)})
                    out.append(row | {"m": m[some].tobytes(), "d": p.d})
                    lo = hi
                yield pd.DataFrame(out)
    return packs.mapInPandas(run, schema)


def _dealt(counts: dict[int, int], n_regions: int, most: int) -> list[tuple[int, int, int]]:
    """(region, first block, blocks): neighbours share a block of ``most`` rows, a larger region has blocks of its own."""
    out, block, held = [], 0, 0
    for r in range(n_regions):
        n = counts.get(r, 0)
        if held and held + n > most:
            block, held = block + 1, 0
        parts = max(1, math.ceil(n / most))
        out.append((r, block, parts))
        block, held = block + parts - 1, held + n
    return out


def _block_of(points: pd.DataFrame, dim: int, k: int, n_p_keys: int) -> Block:
    keys = [_sortable(np.concatenate(points[f"k{i}"].tolist())) for i in range(n_p_keys)]
    return Block(keys, np.concatenate([_matrix(p.m, p.d, len(p.k0), dim) for p in points.itertuples()]), k)


def _searched(block: Block, qm: np.ndarray, k: int, floor: np.ndarray | None = None):
    least_q, least_p = _LEAST_FOR_LEAVES
    return (Leaves(block) if len(qm) >= least_q and len(block.m) >= least_p else block).search(qm, k, floor)


def _home_topk(k: int, p_keys: list[str], key_types: list):
    """Each query's k best in the block of its own region, beside the query: packs ``(home, k0, m, d, floor, hit, key.., score)``; ``floor`` is
    the k-th score, ``hit`` the row of the pack."""

    def run(points: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries):
            dim = int(max(queries["d"].max(), points["d"].max() if len(points) else 0))
            names = [x for q in queries["k0"] for x in q]
            qm = np.concatenate([_matrix(q.m, q.d, len(q.k0), dim) for q in queries.itertuples()])
            best = _searched(_block_of(points, dim, k, len(p_keys)), qm, k) if dim and len(points) else None
            score, keys = best or (np.full((len(qm), k), -np.inf), [])
            for lo in range(0, len(qm), _QUERY_ROWS):
                s = score[lo:lo + _QUERY_ROWS]
                hit, place = np.nonzero(np.isfinite(s))
                row = {"home": int(queries["block"].iloc[0]), "k0": names[lo:lo + _QUERY_ROWS], "m": qm[lo:lo + _QUERY_ROWS].tobytes(), "d": dim,
                       "floor": s[:, -1].tobytes(), "hit": hit.tolist(), "score": s[hit, place].tolist()}
                row.update({f"p{i}": keys[i][lo:lo + _QUERY_ROWS][hit, place].tolist() if keys else [] for i in range(len(p_keys))})
                out.append(row)
        return pd.DataFrame(out, columns=[f.name for f in schema])

    schema = T.StructType([T.StructField("home", T.IntegerType()), T.StructField("k0", T.ArrayType(key_types[0])), T.StructField("m", T.BinaryType()),
                           T.StructField("d", T.IntegerType()), T.StructField("floor", T.BinaryType()), T.StructField("hit", T.ArrayType(T.IntegerType())),
                           T.StructField("score", T.ArrayType(T.DoubleType()))]
                          + [T.StructField(f"p{i}", T.ArrayType(t)) for i, t in enumerate(key_types[1:])])
    return run, schema


def _cell_topk(k: int, q_key: str, p_keys: list[str]):
    """Top-k of one cell of the grid: the queries of a block that are not at home among its points, but what is under their ``floor``."""

    def run(points: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if len(points) and len(queries):
            queries = queries[queries["home"] != points["pb"].iloc[0]]
        dim = int(max(queries["d"].max(), points["d"].max())) if len(queries) and len(points) else 0
        best = None
        if dim:
            floor = np.concatenate([np.frombuffer(f, dtype=np.float64) for f in queries["floor"]])
            best = _searched(_block_of(points, dim, k, len(p_keys)), np.concatenate([_matrix(q.m, q.d, len(q.k0), dim) for q in queries.itertuples()]), k, floor)
        if best is None:
            return pd.DataFrame({c: [] for c in [q_key, *p_keys, "score"]})
        score = np.where(best[0] >= floor[:, None] - 1e-9, best[0], -np.inf)
        return _result(SimpleNamespace(k0=[x for q in queries["k0"] for x in q]), (score, best[1]), q_key, p_keys)

    return run


def _sent_topk(sent: list, dim: int, k: int, q_key: str, p_keys: list[str], vec: str):
    """Top-k of every query over the points of a task, as they come."""

    def run(batches):
        queries = [SimpleNamespace(k0=k0, m=m, d=d) for k0, m, d in sent]
        n_q = sum(len(q.k0) for q in queries)
        best: list = [None] * len(queries)
        for pdf in batches:
            if not len(pdf):
                continue
            vecs = pdf[vec].tolist()
            own = next((len(v) for v in vecs if v is not None and len(v)), 0)
            if dim and own and own != dim:
                raise ValueError(f"vector dimension {own} differs from query dimension {dim}")
            d = dim or own or 1
            block = Block([_sortable(pdf[c].to_numpy()) for c in p_keys], _as_matrix(vecs, d), k, n_q > _FEW_QUERIES)
            for i, q in enumerate(queries):
                cand = block.search(_matrix(q.m, q.d, len(q.k0), d), k, None if best[i] is None else best[i][0][:, -1])
                if cand is not None:
                    best[i] = cand if best[i] is None else _merge(best[i], cand, k)
        for q, b in zip(queries, best):
            if b is not None:
                yield _result(q, b, q_key, p_keys)

    return run


def _matrix(data: bytes, d: int, n: int, dim: int) -> np.ndarray:
    """A packed matrix; a pack without any vector reads as zeros."""
    if not d:
        return np.zeros((n, dim))
    if d != dim:
        raise ValueError(f"vector dimension {d} differs from query dimension {dim}")
    return np.frombuffer(data, dtype=np.float64).reshape(n, d)


def _grid(n_q: int, n_p: int, row_bytes: int, k: int, least_q: int, least_p: int, tasks: int) -> tuple[int, int]:
    """Query and point blocks: at least as many as given, a cell for every task where the packs allow it, and few bytes moved."""
    most_q, most_p = (max(least, math.ceil(n / _PACK_ROWS)) for least, n in ((least_q, n_q), (least_p, n_p)))
    grids = [(qb, min(most_p, max(least_p, math.ceil(tasks / qb)))) for qb in range(least_q, min(most_q, max(least_q, tasks)) + 1)]
    moved = lambda g: n_p * row_bytes * g[0] + n_q * (row_bytes + 96 * k) * g[1]
    return min(grids, key=lambda g: (-min(tasks, g[0] * g[1]), moved(g)))


def knn_topk(queries: DataFrame, points: DataFrame, k: int = DEFAULT_TOP_K,
             q_key: str = "qid", p_keys: list[str] | None = None,
             q_vec: str = "embedding", p_vec: str = "embedding",
             max_block_bytes: int = DEFAULT_MAX_BLOCK_BYTES, stats: dict | None = None) -> DataFrame:
    """V8 batch: ``(q_key, *p_keys, score, rank)`` with rank 1..k per query.

    Query keys are unique; a NULL key takes no part. Query vectors are computed once, when this is called. Where they are sent,
    points are read lazily; else the points are written by region and every query is searched for in its own region when this is called. ``stats`` (optional) receives ``n_queries``,
    ``n_blocks`` and ``n_point_blocks``.
    """
    p_keys = list(p_keys or ["point_id"])
    fields = ([T.StructField(q_key, queries.schema[q_key].dataType)] + [points.schema[c] for c in p_keys]
              + [T.StructField("score", T.DoubleType())])
    spark = queries.sparkSession
    if k is None or k <= 0:
        return spark.createDataFrame([], T.StructType([*fields, T.StructField("rank", T.IntegerType())]))
    qsel = queries.select(q_key, q_vec).where(F.col(q_key).isNotNull())
    packs = _packs(qsel, [q_key], q_vec, "qb")
    packs.write.parquet(path := scratch_path(spark, "knn-queries"))
    qp = spark.read.schema(packs.schema).parquet(path)
    n_q, q_bytes, dim = qp.agg(F.coalesce(F.sum(F.size("k0")), F.lit(0)), F.coalesce(F.sum(F.length("m")), F.lit(0)), F.coalesce(F.max("d"), F.lit(0))).first()
    if q_bytes + 64 * n_q <= min(SENT_BYTES, max_block_bytes):
        sent = [(list(r["k0"]), bytes(r["m"]), r["d"]) for r in qp.collect()]  # SENT_BYTES at most
        if stats is not None:
            stats.update(n_queries=n_q, n_blocks=1, n_point_blocks=0)
        cand = spread(points.select(*p_keys, p_vec)).mapInPandas(_sent_topk(sent, dim, k, q_key, p_keys, p_vec), T.StructType(fields))
    else:
        n_p = points.select(p_keys[0]).count()
        row_bytes = 8 * max(1, dim) + 64
        least_q, least_p = (max(1, math.ceil(n * row_bytes / max_block_bytes)) for n in (n_q, n_p))
        n_qb, n_pb = _grid(n_q, n_p, row_bytes, k, least_q, least_p, int(spark.conf.get("spark.sql.shuffle.partitions")))
        if stats is not None:
            stats.update(n_queries=n_q)
        limit = max(1, max_block_bytes // row_bytes)
        regions = _regions(points, p_vec, n_p, dim, 4 * n_pb)

        def parted(packs: DataFrame, n_keys: int, name: str) -> tuple[DataFrame, dict[int, int]]:
            by = _by_region(packs, n_keys, regions)
            by.write.parquet(path := scratch_path(spark, name))
            by = spark.read.schema(by.schema).parquet(path)
            return by, {r[0]: r[1] for r in by.groupBy("region").agg(F.sum(F.size("k0"))).collect()}  # a row for each region

        pp, in_region = parted(_packs(points, p_keys, p_vec, "pb"), len(p_keys), "knn-points")
        qh, asked = parted(qp, 1, "knn-homes")
        dealt = _dealt(in_region, regions.count, min(limit, max(1, math.ceil(n_p / n_pb))))
        n_pb = dealt[-1][1] + dealt[-1][2]
        homes = [0.0] * n_pb
        for r, first, parts in dealt:
            for b in range(first, first + parts):
                homes[b] += asked.get(r, 0) / parts
        where = F.broadcast(spark.createDataFrame(dealt, "region int, _first int, _parts int"))  # 2 ** _MAX_DEPTH rows at most
        parts_of = F.broadcast(spark.createDataFrame([(b, max(1, math.ceil(n / limit))) for b, n in enumerate(homes)], "block int, _q int"))
        pg = pp.join(where, "region").withColumn("block", (F.col("_first") + F.pmod("pb", "_parts")).cast("int")).drop("region", "_first", "_parts", "pb")
        qg = (qh.join(where, "region").withColumn("block", (F.col("_first") + F.pmod("qb", "_parts")).cast("int")).join(parts_of, "block")
              .withColumn("part", F.pmod(F.xxhash64("qb", "region"), F.col("_q")).cast("int")).select("block", "part", "k0", "m", "d"))
        every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        run, schema = _home_topk(k, p_keys, [f.dataType for f in fields[:-1]])
        first = (pg.join(parts_of, "block").withColumn("part", every(F.col("_q"))).drop("_q").groupBy("block", "part")
                 .cogroup(qg.groupBy("block", "part")).applyInPandas(run, schema))
        first.write.parquet(path := scratch_path(spark, "knn-first"))
        first = spark.read.schema(schema).parquet(path)
        hits = [f"p{i}" for i in range(len(p_keys))]
        cand = (first.select("k0", F.explode(F.arrays_zip("hit", *hits, "score")).alias("h"))
                .select(F.element_at("k0", F.col("h.hit") + 1).alias(q_key), *[F.col(f"h.{h}").alias(c) for h, c in zip(hits, p_keys)], F.col("h.score").alias("score")))
        if stats is not None:
            stats.update(n_blocks=n_qb, n_point_blocks=n_pb)
        if n_pb > 1:
            qg = (first.withColumn("qb", F.pmod(F.xxhash64("home", "m"), F.lit(n_qb)).cast("int")).withColumn("pb", every(F.lit(n_pb)))
                  .select("qb", "pb", "home", "k0", "m", "d", "floor"))
            pg = pg.withColumnRenamed("block", "pb").withColumn("qb", every(F.lit(n_qb)))
            cand = cand.unionByName(pg.groupBy("qb", "pb").cogroup(qg.groupBy("qb", "pb")).applyInPandas(_cell_topk(k, q_key, p_keys), T.StructType(fields)))
    w = Window.partitionBy(q_key).orderBy(F.col("score").desc(), *[F.col(c).asc() for c in p_keys])
    return cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn_single(query_vector, points: DataFrame, k: int = DEFAULT_TOP_K,
               p_keys: list[str] | None = None, p_vec: str = "embedding") -> DataFrame:
    """V8 for one query vector given on the driver: ``orderBy(score desc, keys).limit(k)``.

    Planned as TakeOrderedAndProject (a k-row heap per partition, then one merge), so
    the collection is scanned once and never sorted or shuffled.
    """
    from sparqa.functions.hashvec import cosine

    p_keys = list(p_keys or ["point_id"])
    q = F.array(*[F.lit(float(x)) for x in query_vector])
    vec = F.transform(F.col(p_vec), lambda x: x.cast("double"))
    scored = points.select(*p_keys, cosine(q, vec).alias("score"))
    return scored.orderBy(F.col("score").desc(), *[F.col(c).asc() for c in p_keys]).limit(k)
