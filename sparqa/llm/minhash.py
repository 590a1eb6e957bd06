"""Near-duplicate documents by circulant MinHash, with exact verification.

Signature: a first permutation of the 32-bit shingle space breaks its order; the second one, shifted by
k places, gives coordinate k, for all k. Bands of coordinates are bucket keys.

Verification without pairs: documents with equal shingle sets are one node. In each bucket every node is compared
exactly with one pivot. The Jaccard distance is a metric, so two nodes can only be linked (distance at most
t) if their distances to the pivot differ by at most t: the bucket falls into overlapping strata of
width t, which become the next buckets. A bucket is done when all of it lies in one component. What the largest
component of a bucket leaves out is finally held against all of the bucket, block by block, once that is
little enough; until then pivots cut it further. There marks are compared, not sets: a mark holds the parity of the number of shingles
in each of a few cells, so two marks differ in no more cells than their sets in shingles, and a pair whose marks differ too much is not
linked. What is left is compared exactly: first the likeliest pair of a node and a component, then, after components have been joined, all.
Every candidate pair is thus decided exactly or ruled out by the metric or by the marks.

Edge cases: NULL, empty and blank texts have no shingles and link with nothing; texts shorter than a shingle are one
shingle; a NULL id counts as larger than every id and is never the component id if another exists; rows that
repeat an id are one document, all or none of which stay; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparqa.llm.common import stored
from sparqa.llm.components import components
from sparqa.llm.hashing import mix, odd, release, released, text_buffer

BANDS, ROWS = 32, 5
THRESHOLD = 80  # per cent
CHUNK = 1 << 19
#: Pairs that one verification task group holds.
CELL_PAIRS = 2000
#: Nodes of a bucket, at most, that all others are compared with in a round.
PIVOTS = 8
#: Buckets with up to this many open comparisons of marks are finished block by block; larger ones are cut by pivots first.
FINISH_PAIRS = 200_000_000
BLOCK_X, BLOCK_M = 512, 1024
#: Comparisons and rows of a task group of these.
CELL_COMPARES, CELL_ROWS = 1_000_000, 4_000
#: Cells of a mark: at least two a shingle, a power of two between these.
LEAST_MARK, MOST_MARK = 256, 1 << 18

_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 2 ** 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of the base and of its inverse, grown on demand once per worker."""
    up = down = np.zeros(0, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, CHUNK * 2)
            cls.up, cls.down = _powers(_BASE, size), _powers(_BASE_INV, size)
        return cls.up, cls.down


def word_hashes(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, hash) of each word of ``text``, A-Z lowered."""
    text = _LOWER[text]
    solid = ~_GAP[text]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], solid, [False]])))
    lo, hi = edge[::2], edge[1::2]
    up, down = _Powers.get(len(text) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((text.astype(np.uint64) + np.uint64(1)) * up[:len(text)])])
    return lo, mix((total[hi] - total[lo]) * down[lo] + (hi - lo).astype(np.uint64))


def shingle_sets(column, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text in turn."""
    buf, offs = text_buffer(column)
    times = odd(21, 1)[0]
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + CHUNK, "right")) - 1)
        # a gap between texts keeps their words apart
        gap = np.full(1, 32, np.uint8)
        text = np.concatenate([x for r in range(i, j) for x in (buf[offs[r]:offs[r + 1]], gap)])
        begin = offs[i:j + 1] - offs[i] + np.arange(j - i + 1)
        lo, w = word_hashes(text)
        cut = np.searchsorted(lo, begin)
        h = w * times
        for k in range(1, size):
            if len(w) > k:
                h = mix(h[:len(w) - k] + w[k:]) * times
        for r in range(i, j):
            a, b = int(cut[r - i]), int(cut[r - i + 1])
            if b - a >= size:
                yield r, np.unique(h[a:b - size + 1])
            elif b > a:
                x = w[a:a + 1] * times
                for k in range(a + 1, b):
                    x = mix(x + w[k:k + 1]) * times
                yield r, mix(x + np.uint64(b - a))
            else:
                yield r, h[:0]
        i = j


def _second(x: np.ndarray) -> np.ndarray:
    """The second permutation, of 32-bit integers; in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def signatures(items: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Signature matrix (sets x k) of the sets that start at ``first`` in ``items``; none is empty."""
    base = (mix(items) >> np.uint64(32)).astype(np.uint32)  # first permutation
    out = np.empty((len(first), k), np.uint32)
    for shift in range(k):
        out[:, shift] = np.minimum.reduceat(_second(base + np.uint32(shift)), first)
    return out


def _sketch(size: int, bands: int, rows: int):
    weave = odd(31, rows)

    def run(batches):
        for t in batches:
            ids, sets = t.column("doc_id"), []
            for _, s in shingle_sets(t.column("text"), size):
                sets.append(s)
            n = np.array([len(s) for s in sets], np.int64)
            f1, f2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            keys = np.zeros((len(n), bands), np.uint64)
            full = np.flatnonzero(n)
            at = 0
            while at < len(full):  # some sets at a time: arrays of a few MB
                sizes = np.cumsum(n[full[at:]])
                to = at + max(1, int(np.searchsorted(sizes, CHUNK // 4, "right")))
                part = full[at:to]
                items = np.concatenate([sets[p] for p in part])
                first = np.cumsum(n[part]) - n[part]
                f1[part] = np.add.reduceat(mix(items + np.uint64(1)), first)
                f2[part] = np.add.reduceat(mix(items ^ np.uint64(0x5555555555555555)), first)
                sig = signatures(items, first, bands * rows).astype(np.uint64).reshape(len(part), bands, rows)
                keys[part] = mix((sig * weave).sum(2) + mix(np.arange(bands, dtype=np.uint64)))
                at = to
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * bands), pa.array(keys.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(n), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), lists],
                                             ["doc_id", "n", "f1", "f2", "bands"])
            del sets, keys, lists
            release()
    return run


def _sets(size: int):
    def run(batches):
        for t in batches:
            sets = [s for _, s in shingle_sets(t.column("text"), size)]
            f = lambda c: [int(mix(c(s)).sum(dtype=np.uint64).astype(np.int64)) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [t.column("node"), t.column("f1"), pa.array(f(lambda s: s + np.uint64(1)), pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                ["node", "f1", "_f", "items"])
            del sets
            release()
    return run


def _compare(threshold: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        pivots = {p: np.frombuffer(s.as_py(), np.uint64) for p, s in zip(right["pivot"].to_pylist(), right["items"], strict=True)}
        out: list[list] = [[], [], [], []]
        for p, node, raw in zip(left["pivot"].to_pylist(), left["node"].to_pylist(), left["items"], strict=True):
            a, b = np.frombuffer(raw.as_py(), np.uint64), pivots[p]
            small, large = (a, b) if len(a) < len(b) else (b, a)
            both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
            either = len(a) + len(b) - both
            out[0].append(p)
            out[1].append(node)
            out[2].append(100 * both >= threshold * either)
            # a hair wider than the threshold, so that rounding never parts a linked pair
            out[3].append(int((1 - both / either) / ((100 - threshold) / 100 + 1e-9)))
        return pa.table({"pivot": pa.array(out[0], pa.int64()), "node": pa.array(out[1], pa.int64()),
                         "linked": pa.array(out[2], pa.bool_()), "stratum": pa.array(out[3], pa.int32())})
    return run


def _measured(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """(pivot, node, linked, stratum) of the distinct ``pairs`` (pivot, node), compared on full sets."""
    pairs = stored(pairs, "near-pairs")
    n_cells = max(1, -(-pairs.count() // CELL_PAIRS))
    per = pairs.groupBy("pivot").agg(F.count(F.lit(1)).alias("_n"))
    # a pivot with many partners is dealt to several cells
    cells = pairs.join(per, "pivot").withColumn(
        "cell", F.pmod(F.xxhash64("pivot", F.pmod(F.xxhash64("node"), F.ceil(F.col("_n") / CELL_PAIRS))), F.lit(n_cells)).cast("int")).drop("_n")
    left = cells.join(sets, "node").select("cell", "pivot", "node", "items")
    right = cells.select("cell", "pivot").distinct().join(sets.withColumnRenamed("node", "pivot"), "pivot")
    right = right.select("cell", "pivot", "items").toDF("cell", "pivot", "items")  # a cogroup needs columns of its own
    return stored(left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(
        released(_compare(threshold)), "pivot long, node long, linked boolean, stratum int"), "near-measured")


def mark(items: np.ndarray) -> np.ndarray:
    """Parities of the counts of ``items`` in cells, as words; half as many cells are one half of the words XOR the other."""
    cells = min(MOST_MARK, max(LEAST_MARK, 1 << (2 * max(1, len(items)) - 1).bit_length()))
    at = (mix(items ^ np.uint64(0xC2B2AE3D27D4EB4F)) & np.uint64(cells - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=cells) & 1).astype(np.uint8), bitorder="little").view(np.uint64)


def _folded(marks: np.ndarray, words: int) -> np.ndarray:
    """Marks (sets x words) in fewer words."""
    return np.bitwise_xor.reduce(marks.reshape(len(marks), -1, words), axis=1)


def _marks(batches):
    for t in batches:
        sets = [np.frombuffer(s.as_py(), np.uint64) for s in t.column("items")]
        yield pa.RecordBatch.from_arrays([t.column("node"), pa.array([len(s) for s in sets], pa.int64()), pa.array([mark(s).tobytes() for s in sets], pa.binary())],
                                         ["node", "n", "mark"])


def _possible(threshold: int, best: bool):
    """Pairs of different components inside each (bucket, block, block) of a cell whose marks don't rule them out; with ``best`` the likeliest
    of each left node and right component."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
        lk = list(zip(*(left[c].to_pylist() for c in ("bucket", "bx", "bm")), strict=True)) if left.num_rows else []
        rk = list(zip(*(right[c].to_pylist() for c in ("bucket", "bx", "bm")), strict=True)) if right.num_rows else []
        of: dict[tuple, list[int]] = {}
        for i, k in enumerate(rk):
            of.setdefault(k, []).append(i)
        if not lk or not rk:
            return pa.table({"pivot": pa.array(out[0][0]), "node": pa.array(out[1][0])})
        (l_node, l_comp, l_n), (r_node, r_comp, r_n) = ([t[c].to_numpy() for c in ("node", "comp", "n")] for t in (left, right))
        l_mark, r_mark = ([np.frombuffer(m.as_py(), np.uint64) for m in t["mark"]] for t in (left, right))
        now, by_words = None, {}
        for i, k in sorted(enumerate(lk), key=lambda x: x[1]):
            if k not in of:
                continue
            if k != now:
                now, by_words, folds = k, {}, {}
                for j in of[k]:
                    by_words.setdefault(len(r_mark[j]), []).append(j)
                by_words = {w: (np.array(js), np.stack([r_mark[j] for j in js])) for w, js in by_words.items()}
            mine, n = l_mark[i], int(l_n[i])
            near, differ = [], []
            for w, (js, marks) in by_words.items():
                words = min(w, len(mine))
                if (w, words) not in folds:
                    folds[w, words] = marks if w == words else _folded(marks, words)
                own = mine if len(mine) == words else _folded(mine[None], words)[0]
                d = np.bitwise_count(folds[w, words] ^ own).sum(axis=1, dtype=np.int64)
                m = r_n[js]
                ok = ((100 + threshold) * d <= (100 - threshold) * (m + n)) & (100 * np.minimum(m, n) >= threshold * np.maximum(m, n)) & (r_comp[js] != l_comp[i])
                near.append(js[ok])
                differ.append(d[ok])
            near, differ = np.concatenate(near), np.concatenate(differ)
            if best and len(near):
                near = near[np.lexsort((near, differ))]
                near = near[np.unique(r_comp[near], return_index=True)[1]]
            out[0].append(np.minimum(l_node[i], r_node[near]))
            out[1].append(np.maximum(l_node[i], r_node[near]))
        return pa.table({"pivot": pa.array(np.concatenate(out[0])), "node": pa.array(np.concatenate(out[1]))})
    return run


def _finished(state: DataFrame, near: DataFrame, marks: DataFrame, sets: DataFrame, threshold: int, best: bool) -> DataFrame:
    """Links across components in the buckets ``near``: what lies outside the largest component against the whole bucket, block by
    block; all of them, or with ``best`` the likeliest only."""
    rows = state.join(near, "bucket").withColumn("_bx", F.ceil(F.col("x") / BLOCK_X).cast("int")).withColumn("_bm", F.ceil(F.col("m") / BLOCK_M).cast("int"))
    compares, moved = near.agg(F.sum(F.col("m") * F.col("x")), F.sum(F.col("m") * F.ceil(F.col("x") / BLOCK_X) + F.col("x") * F.ceil(F.col("m") / BLOCK_M))).first()
    n_cells = max(1, -(-compares // CELL_COMPARES), -(-moved // CELL_ROWS))
    cell = F.pmod(F.xxhash64("bucket", "bx", "bm"), F.lit(n_cells)).cast("int")
    part = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    cols = ["cell", "bucket", "bx", "bm", "node", "comp", "n", "mark"]
    rows = rows.join(marks, "node")
    left = rows.filter("comp <> top").withColumn("bx", part("_bx")).withColumn("bm", every("_bm")).withColumn("cell", cell).select(cols)
    right = rows.withColumn("bm", part("_bm")).withColumn("bx", every("_bx")).withColumn("cell", cell).select(cols).toDF(*cols)
    pairs = left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(released(_possible(threshold, best)), "pivot long, node long")
    return _measured(pairs.distinct(), sets, threshold).filter("linked").select("pivot", "node")


def _opened(members: DataFrame, comp: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members with their components, the buckets of several components): what a bucket's largest component leaves out must be held
    against all of the bucket."""
    state = stored(members.join(comp, "node"), "near-state")
    live = stored(state.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("_c")).groupBy("bucket")
                  .agg(F.sum("_c").alias("m"), F.max_by("comp", "_c").alias("top"), F.max("_c").alias("_most"))
                  .filter("m > _most").select("bucket", "m", "top", (F.col("m") - F.col("_most")).alias("x")), "near-live")
    return state, live


def _merge(comp: DataFrame, links: DataFrame) -> DataFrame:
    """Components after ``links`` (pivot, node) are added; ``comp`` is (node, comp)."""
    a, b = comp.select(F.col("node").alias("pivot"), F.col("comp").alias("a")), comp.select("node", F.col("comp").alias("b"))
    edges = links.join(a, "pivot").join(b, "node").select("a", "b").filter("a <> b").distinct()
    moved = components(edges).select(F.col("node").alias("comp"), F.col("comp").alias("_new"))
    return stored(comp.join(moved, "comp", "left").select("node", F.coalesce("_new", "comp").alias("comp")), "near-comp")


def near_duplicates(docs: DataFrame, shingle: int = 5, threshold: int = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = stored(docs.mapInArrow(_sketch(shingle, bands, rows), "doc_id long, n long, f1 long, f2 long, bands array<long>"), "near-sketch")
    nodes = stored(sketch.filter("n > 0").groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("least"), F.first("bands").alias("bands"))
                   .withColumn("node", F.monotonically_increasing_id()), "near-nodes")
    every = nodes.select("node", F.explode("bands").alias("bucket"))
    full = every.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    members = stored(every.join(full, "bucket"), "near-members")
    comp = stored(members.select("node").distinct().withColumn("comp", F.col("node")), "near-comp")
    wanted = comp.join(nodes.select("node", "f1", "least"), "node").select("node", "f1", "least")
    texts = docs.filter("doc_id is not null").join(wanted.withColumnRenamed("least", "doc_id"), "doc_id").select("node", "f1", "text")
    # a class whose ids are all NULL has no id to find its text by: it is found by its sketch
    lost = wanted.filter("least is null")
    if lost.limit(1).count():
        nameless = docs.filter("doc_id is null").select("text").distinct()
        found = nameless.withColumn("doc_id", F.lit(None).cast("long")).withColumn("node", F.lit(None).cast("long")).withColumn("f1", F.lit(None).cast("long"))
        keyed = stored(found.select("node", "f1", "text").mapInArrow(_sets(shingle), "node long, f1 long, _f long, items binary"), "near-nameless")
        extra = lost.join(keyed.select(F.col("_f").alias("f1"), "items"), "f1").select("node", "items")
    else:
        extra = None
    sets = texts.mapInArrow(_sets(shingle), "node long, f1 long, _f long, items binary").filter("f1 = _f").select("node", "items")
    sets = stored((sets if extra is None else sets.unionByName(extra)).dropDuplicates(["node"]), "near-sets")
    first_round, marks = True, None
    while True:
        state, live = _opened(members, comp)
        if not first_round:
            near = live.filter(F.col("m") * F.col("x") <= FINISH_PAIRS)
            if near.limit(1).count():
                if marks is None:
                    marks = stored(sets.mapInArrow(_marks, "node long, n long, mark binary"), "near-marks")
                comp = _merge(comp, _finished(state, near, marks, sets, threshold, True))
                state, near = _opened(members.join(near.select("bucket"), "bucket"), comp)
                if near.limit(1).count():
                    comp = _merge(comp, _finished(state, near, marks, sets, threshold, False))
            live = live.filter(F.col("m") * F.col("x") > FINISH_PAIRS)
        if not live.limit(1).count():
            break
        # small components give the pivots; the first one of a bucket deals it out into strata
        sizes = comp.groupBy("comp").agg(F.count(F.lit(1)).alias("_size"))
        best = (members.join(live.select("bucket"), "bucket").join(comp, "node").join(sizes, "comp")
                .withColumn("_sub", F.pmod(F.xxhash64("node"), F.lit(1 if first_round else PIVOTS)))
                .groupBy("bucket", "_sub").agg(F.min(F.struct("_size", "node")).alias("_p")))
        best = best.groupBy("bucket").agg(F.min("_p").alias("_p"), F.collect_list("_p.node").alias("pivots")).select("bucket", F.col("_p.node").alias("first"), "pivots")
        here = stored(members.join(best, "bucket"), "near-here")
        pending = here.select(F.explode("pivots").alias("pivot"), "node").filter("node <> pivot").distinct()
        measured = _measured(pending, sets, threshold)
        comp = _merge(comp, measured.filter("linked"))
        # strata i and i + 1 hold whatever lies within the threshold of a member of stratum i + 1
        rest = here.filter(~F.array_contains("pivots", F.col("node"))).select(F.col("first").alias("pivot"), "node").distinct()
        spread = measured.join(rest, ["pivot", "node"]).select("pivot", "node", F.explode(F.array(
            F.struct("stratum", F.lit(1).alias("own")), F.struct((F.col("stratum") + 1).alias("stratum"), F.lit(0).alias("own")))).alias("s"))
        spread = spread.select(F.xxhash64("pivot", "s.stratum").alias("bucket"), "node", "s.own")
        used = spread.groupBy("bucket").agg(F.max("own").alias("_own"), F.count(F.lit(1)).alias("_n")).filter("_own = 1 and _n > 1").select("bucket")
        members = stored(spread.join(used, "bucket").select("bucket", "node"), "near-members")
        first_round = False
    named = nodes.select("node", "f1", "f2", "n", "least").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    head = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = named.join(head, "comp").select("f1", "f2", "n", "component_id")
    linked = sketch.filter("n > 0").select("doc_id", "n", "f1", "f2").join(named, ["f1", "f2", "n"]).select("doc_id", "n", "component_id")
    alone = sketch.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id",
                                            F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, threshold: int = THRESHOLD) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest id; columns unchanged."""
    gone = stored(near_duplicates(docs, shingle, threshold).filter("not kept and doc_id is not null").select("doc_id").distinct(), "near-gone")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
