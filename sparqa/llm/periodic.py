"""Periodic runs of words by seeds and diagonals.

A run is a stretch of words with smallest period q, at least twice the period and ``MIN_WORDS`` long, that no
neighbouring word extends. On the diagonal of lag q it is a stretch of positions i with word[i] = word[i + q]:

1. *Classes.* Lags are taken in classes [o, 2o), [2o, 4o), ... with o half of ``MIN_WORDS``, and all lags below o with
   the first. In a class every run covers its diagonal for at least the class's least lag: the guaranteed overlap.
2. *Seeds.* The k-grams of about half that overlap are indexed by (hash, position) in one sorted array; a fixed grid of positions
   is so dense that one grid position with its whole k-gram lies in every such stretch. Its later occurrences
   in the same document within the class's lags are one range of the index: the occurrence pairs.
3. *Extension.* Pairs of one lag are taken from the left. The first is extended both ways to its whole stretch, and the
   table of the furthest position covered per lag rules out the pairs inside it. Pairs inside a
   run already known, with a multiple of its period as lag, lead to the same run and are left out as well.

Grid positions times lags of a class is twice the text, so pairs, time and memory are n log n for any text; nothing is capped.
Hashes only choose and extend; every run is confirmed word by word, and a stretch that fails is cut where its words differ.

Documents are worked through in chunks of ``CHUNK_WORDS`` words in the task that read them: no shuffle.
Edge cases: a NULL or empty text has no words and no runs; a text longer than a chunk is a chunk of its own, so memory follows the
longest text; repeated rows and ties are independent rows; other columns are kept, one named like a result is replaced;
an empty table stays empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparqa.llm.common import words
from sparqa.llm.hashing import mix, release

MIN_WORDS = 12
CHUNK_WORDS = 1 << 19
#: Rounds of extension by the furthest-covered table before the rest of a class's pairs is extended at once.
ROUNDS = 24
_BASE = 0x9E3779B97F4A7C15  # odd
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


class Words:
    """Word numbers of several documents end to end, with hashes of any stretch of them."""

    def __init__(self, word: np.ndarray, offs: np.ndarray):
        self.word, self.offs, n = word, offs, len(word)
        size = np.diff(offs)
        self.doc = np.repeat(np.arange(len(size)), size)
        self.begin, self.end = offs[:-1][self.doc], offs[1:][self.doc]

        def powers(base: int) -> np.ndarray:
            x = np.full(n + 1, base & (2 ** 64 - 1), np.uint64)
            x[0] = 1
            return np.cumprod(x)
        value = mix(word.astype(np.uint64) + np.uint64(1)) * powers(_BASE)[:n]
        self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value)])
        self.inverse = powers(pow(_BASE, -1, 2 ** 64))

    def gram(self, at: np.ndarray, size) -> np.ndarray:
        """Hash of the ``size`` words from each position."""
        return (self.total[at + size] - self.total[at]) * self.inverse[at]

    def common(self, x: np.ndarray, y: np.ndarray, limit: np.ndarray, back: bool) -> np.ndarray:
        """Number of equal words from x and y on (or before them), at most ``limit``."""
        low, high = np.zeros_like(limit), limit.copy()
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            mid = (low[open_] + high[open_] + 1) // 2
            a, b = (x[open_] - mid, y[open_] - mid) if back else (x[open_], y[open_])
            same = self.gram(a, mid) == self.gram(b, mid)
            low[open_[same]] = mid[same]
            high[open_[~same]] = mid[~same] - 1


def lag_classes(longest: int, min_words: int):
    """(least lag, greatest lag, guaranteed overlap) of each class that a text of ``longest`` words can have."""
    over = max(1, -(-min_words // 2))
    low = 1
    while 2 * low <= longest and (low > 1 or longest >= min_words):
        yield low, 2 * over - 1, over
        low, over = 2 * over, 2 * over


def occurrence_pairs(w: Words, low: int, high: int, over: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, lag): grid positions whose k-gram recurs in the same document at a lag of the class."""
    n, k = len(w.word), (over + 1) // 2
    step = over - k + 1
    at = np.flatnonzero((w.end - w.begin >= 2 * low) & (np.arange(n) + k <= w.end))
    bits = np.uint64((2 * n + 2).bit_length())
    key = mix(w.gram(at, k) + w.doc[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    key = ((key >> bits) << bits) | at.astype(np.uint64)
    key.sort()
    top = key >> bits
    same = top[1:] == top[:-1]
    key = key[np.concatenate([[False], same]) | np.concatenate([same, [False]])] if len(key) else key
    place = (key & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    grid = place % step == 0
    first = np.searchsorted(key, key[grid] + np.uint64(low))
    count = np.searchsorted(key, key[grid] + np.uint64(high), "right") - first
    x = np.repeat(place[grid], count)
    inside = np.arange(len(x)) - np.repeat(np.cumsum(count) - count, count)
    return x, place[np.repeat(first, count) + inside] - x


def not_in_known(x: np.ndarray, lag: np.ndarray, low: int, runs: np.ndarray) -> np.ndarray:
    """Pairs that no known run with a period dividing the lag covers. ``runs`` has columns start, end, period.

    Two different runs whose periods are at most half of ``low`` cannot both cover ``low`` words, so the run that
    reaches furthest is the only one that may cover a pair.
    """
    runs = runs[(runs[:, 2] <= low // 2) & (runs[:, 1] - runs[:, 0] > low)]
    if not len(runs) or not len(x):
        return np.ones(len(x), bool)
    runs = runs[np.argsort(runs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(runs[:, 1])
    best = np.maximum.accumulate(np.where(runs[:, 1] == reach, np.arange(len(runs)), 0))
    i = np.searchsorted(runs[:, 0], x, "right") - 1
    run = runs[best[np.maximum(i, 0)]]
    return (i < 0) | (x + lag >= run[:, 1]) | (lag % run[:, 2] != 0)


def stretches(w: Words, x: np.ndarray, lag: np.ndarray) -> np.ndarray:
    """(begin, end, lag) of the diagonal stretches through the pairs, each found once."""
    order = np.lexsort((x, lag))
    x, lag = x[order], lag[order]
    found, turn = [np.zeros((0, 3), np.int64)], 0
    while len(x):
        doc = w.doc[x]
        head = np.ones(len(x), bool)
        if turn < ROUNDS:
            head[1:] = (lag[1:] != lag[:-1]) | (doc[1:] != doc[:-1])
        a, q = x[head], lag[head]
        ahead = w.common(a, a + q, w.end[a] - a - q, False)
        behind = w.common(a, a + q, a - w.begin[a], True)
        found.append(np.stack([a - behind, a + ahead, q], 1))
        furthest = (a + ahead)[np.cumsum(head) - 1]  # per lag (and document)
        rest = ~head & (x >= furthest)
        x, lag, turn = x[rest], lag[rest], turn + 1
    return np.unique(np.concatenate(found), axis=0)


def confirmed(w: Words, found: np.ndarray, min_words: int) -> np.ndarray:
    """(start, end, period) of the stretches that make a run, after comparing their words."""
    def long(rows: np.ndarray) -> np.ndarray:
        return rows[rows[:, 1] - rows[:, 0] >= np.maximum(min_words - rows[:, 2], rows[:, 2])]
    out = []
    for a, b, q in long(found).tolist():
        same = w.word[a:b] == w.word[a + q:b + q]
        if same.all():
            out.append((a, b + q, q))
            continue
        cut = np.concatenate([[a - 1], a + np.flatnonzero(~same), [b]])  # a hash took unequal words for equal
        part = long(np.stack([cut[:-1] + 1, cut[1:], np.full(len(cut) - 1, q)], 1))
        out += [(c, d + q, q) for c, d, _ in part.tolist()]
    return np.array(out, np.int64).reshape(-1, 3)


def find_runs(word: np.ndarray, offs: np.ndarray, min_words: int = MIN_WORDS) -> np.ndarray:
    """(start, end, period) of every run, by position in ``word``; ``offs`` are the documents' offsets."""
    runs = np.zeros((0, 3), np.int64)
    if not len(word):
        return runs
    w = Words(word, offs)
    for low, high, over in lag_classes(int(np.diff(offs).max()), min_words):
        x, lag = occurrence_pairs(w, low, high, over)
        rest = not_in_known(x, lag, low, runs)
        runs = np.concatenate([runs, confirmed(w, stretches(w, x[rest], lag[rest]), min_words)])
    # one stretch of words has one smallest period; its multiples found the same stretch
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(1)
    runs = runs[first]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _work(texts: list[list[bytes]], min_words: int) -> tuple[pa.Array, pa.Array]:
    """The runs and the collapsed text of each list of words."""
    known: dict[bytes, int] = {}
    size = np.array([len(t) for t in texts], np.int64)
    offs = np.concatenate([[0], np.cumsum(size)])
    word = np.fromiter((known.setdefault(x, len(known)) for t in texts for x in t), np.int64, int(offs[-1]))
    runs = find_runs(word, offs, min_words)
    at = np.searchsorted(offs, runs[:, 0], "right") - 1 if len(runs) else np.zeros(0, np.int64)
    cut = np.searchsorted(at, np.arange(len(texts) + 1))
    change = np.zeros(len(word) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 1], -1)
    kept = np.cumsum(change)[:-1] == 0
    collapsed = []
    for i, t in enumerate(texts):
        if cut[i] < cut[i + 1]:
            t = [x for x, k in zip(t, kept[offs[i]:offs[i + 1]].tolist(), strict=True) if k]
        collapsed.append(b" ".join(t))
    struct = pa.StructArray.from_arrays([pa.array(runs[:, 0] - offs[at]), pa.array(runs[:, 1] - runs[:, 0]), pa.array(runs[:, 2])], ["start", "length", "period"])
    return pa.ListArray.from_arrays(pa.array(cut, pa.int32()), struct), pa.array(collapsed, pa.binary()).cast(pa.string())


def with_runs(df: DataFrame, text: str = "text", runs: str = "runs", collapsed: str = "collapsed", min_words: int = MIN_WORDS) -> DataFrame:
    """``df`` with the runs of ``text`` (by start, then period) and its text without their repeats.

    ``collapsed`` has the words that no run contains after its first period, joined by one space.
    """
    schema = df.withColumn(runs, F.lit(None).cast(RUNS)).withColumn(collapsed, F.lit("")).schema

    def run(batches):
        for t in batches:
            # bytes.split() cuts at the six characters that part words; texts are taken from the batch as they are needed
            column, lo, n, held = t.column(text).cast(pa.binary()), 0, 0, []
            for i in range(len(column)):
                held.append((column[i].as_py() or b"").split())
                n += len(held[-1])
                if n >= CHUNK_WORDS or i == len(column) - 1:
                    a, b = _work(held, min_words)
                    part = t.slice(lo, i + 1 - lo)
                    cols = {c: part.column(c) for c in t.schema.names} | {runs: a, collapsed: b}
                    yield pa.RecordBatch.from_arrays([cols[f.name] for f in schema], [f.name for f in schema])
                    lo, n, held = i + 1, 0, []
        release()
    return df.mapInArrow(run, schema)


def planted(docs: DataFrame) -> Column:
    """``text`` with the query's planted repeats: in a tenth of the documents (by checksum of ``doc_id``) the words from
    some place on repeat a first stretch of themselves. A NULL id is never planted."""
    h = F.crc32(F.col("doc_id").cast("long").cast("string"))
    g = F.floor(h / 10).cast("long")

    def repeat(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = F.pmod(g, n)
        p = F.floor((n - a) / (g % 8 + 3)).cast("long") + 1
        return F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: w[F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")])
    hit = (h % 10 == 0) & (F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", "")) > 0)
    # a one-element transform binds the words once
    return F.when(hit, F.transform(F.array(words(F.col("text"))), lambda w: F.array_join(repeat(w), " "))[0]).otherwise(F.col("text"))


def report(docs: DataFrame) -> DataFrame:
    """The query's row of each document: run count, the longest run, digests of all runs and of the collapsed text."""
    df = with_runs(docs.select(F.col("doc_id").cast("long").alias("doc_id"), planted(docs).alias("text")).select("doc_id", "text"))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r.length).alias("m"), r.start.alias("start"), r.period.alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n"))), "")
    return (df.withColumn("b", best)
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("b.start").alias("start"), (-F.col("b.m")).alias("length"),
                    F.col("b.period").alias("period"), F.expr("(-1000 * b.m) div b.period").alias("exponent_milli"),
                    F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")))
