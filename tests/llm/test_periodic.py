"""Periodic runs against a brute-force version."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from conftest import SF001

from sparqa.llm import periodic


def brute_runs(w, least=12):
    """Every lag, every stretch; the smallest period of a stretch of words wins."""
    n, best = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                best.setdefault((i, j + q), q)
            i = j
    return sorted((a, b - a, q) for (a, b), q in best.items())


def brute_row(doc_id, text, plant=True):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if plant and h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = sorted(brute_runs(w), key=lambda r: (r[0], r[2]))
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *(top if top else (None,) * 3), 1000 * top[1] // top[2] if top else None,
            sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def find(w, least=12):
    ids = {}
    word = np.array([ids.setdefault(x, len(ids)) for x in w], np.int64)
    return [(a, b - a, q) for a, b, q in periodic.find_runs(word, np.array([0, len(w)]), least).tolist()]


@pytest.mark.parametrize("least", [2, 3, 7, 12, 20])
def test_random_words(least):
    rng = random.Random(least)
    for turn in range(300):
        w = [rng.choice("ab" if turn % 2 else "abc") for _ in range(rng.randrange(0, 120))]
        if turn % 3 == 0:  # periods of all sizes
            u = [rng.choice("abc") for _ in range(rng.randrange(1, 30))]
            w = w[:rng.randrange(0, 20)] + (u * 9)[:rng.randrange(1, 120)] + w[-5:]
        assert sorted(find(w, least)) == sorted(brute_runs(w, least)), w


def test_structured_words():
    fib = ["a", "ab"]
    while len(fib[-1]) < 400:
        fib.append(fib[-1] + fib[-2])
    thue = "".join("ab"[bin(i).count("1") % 2] for i in range(600))
    for w in (fib[-1], thue, "a" * 500, "a" * 200 + "b" + "a" * 200, ("a" * 20 + "b") * 15, "ab" * 6, "ab" * 5 + "a", ("abc" * 10 + "x") * 8, ""):
        assert sorted(find(w)) == sorted(brute_runs(w)), w[:40]


def test_many_documents_keep_apart():
    rng = random.Random(3)
    docs = [[rng.choice("ab") for _ in range(rng.randrange(0, 60))] for _ in range(200)] + [["a"] * 40] * 3 + [[]]
    ids = {"a": 0, "b": 1}
    offs = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    runs = periodic.find_runs(np.array([ids[x] for d in docs for x in d], np.int64), offs)
    got = [[(a - offs[i], b - a, q) for a, b, q in runs.tolist() if offs[i] <= a < offs[i + 1]] for i in range(len(docs))]
    assert [sorted(g) for g in got] == [brute_runs(d) for d in docs]


def test_a_false_hash_match_is_undone(monkeypatch):
    monkeypatch.setattr(periodic, "mix", lambda x: x * np.uint64(0) + np.uint64(7))  # all words hash alike
    rng = random.Random(5)
    for _ in range(30):
        w = [rng.choice("ab") for _ in range(50)]
        runs = find(w)
        for s, m, q in runs:
            assert w[s:s + m - q] == w[s + q:s + m]


@pytest.mark.parametrize("w", ["a" * 200_000, "a" * 100_000 + "b" + "a" * 100_000, ("a" * 50 + "b") * 4000])
def test_long_texts_take_little_time(w):
    t = time.process_time()
    assert find(w)
    assert time.process_time() - t < 60


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_documents(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect() if len(r.text or "") < 9000]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(periodic.report(df)) == sorted((brute_row(*r) for r in rows), key=str)


def test_edge_cases(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(1, None), (2, ""), (3, " \n "), (4, "x"), (5, "a " * 11), (6, "a " * 12), (6, "a " * 12), (None, "b " * 30), (None, None), (7, "a\x0bb\x0c" * 9), (8, "a b\x1c\x85 " * 9),
            (9, "ä ö " * 20 + "ü" * 5000)]
    rows += [(100 + i, " ".join(rng.choice("ab") for _ in range(rng.randrange(0, 200)))) for i in range(120)]
    for size in (1 << 19, 50):
        monkeypatch.setattr(periodic, "CHUNK_WORDS", size)
        df = spark.createDataFrame([(d, t, 1, "y") for d, t in rows], "doc_id long, text string, runs int, b string").coalesce(1)
        assert got(periodic.report(df)) == sorted((brute_row(*r) for r in rows), key=str)


def test_operator_keeps_columns(spark):
    df = spark.createDataFrame([(1, "a b " * 8, "x"), (2, None, None)], "doc_id long, body string, runs string")
    out = {r.doc_id: r for r in periodic.with_runs(df, text="body").collect()}
    assert [tuple(x) for x in out[1].runs] == [(0, 16, 2)] and out[1].collapsed == "a b" and out[1].body == "a b " * 8
    assert out[2].runs == [] and out[2].collapsed == "" and out[2].body is None


def test_empty(spark):
    assert periodic.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0
