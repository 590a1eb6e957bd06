"""Near duplicates against all pairs by brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF001

from sparqa.llm import minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = WORD.findall(low)
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k):
    sets = [(d, shingles(t, k)) for d, t in rows]
    comp = list(range(len(sets)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i
    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                comp[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(s), least.get(find(i)), d is not None and d == least.get(find(i))) for i, (d, s) in enumerate(sets)), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_documents(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for k in (2, 5):
        assert got(minhash.near_duplicates(docs, k)) == brute(rows, k)


def cases():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    base = [word() for _ in range(200)]
    rows = [(i, " ".join(base)) for i in range(20)]
    for i in range(120):  # a crowded neighbourhood of the threshold
        w = list(base)
        for _ in range(rng.randrange(40)):
            w[rng.randrange(200)] = word()
        rows.append((1000 + i, " ".join(w)))
    chain = [word() for _ in range(100)]
    for i in range(30):  # each is near the next only
        rows.append((2000 + 31 * i % 97, " ".join(chain[6 * i % 60:] + [word() for _ in range(6 * i % 60)])))
    rows += [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "One two"), (7, "one  two"), (8, "É one"), (9, "é one"),
             (None, "one two"), (None, " ".join(base[:150])), (None, "lonely words here"), (50, "x " * 50000), (51, "x\x0bx"), (4, "one")]
    return rows


@pytest.mark.parametrize("k", [2, 5])
def test_edge_cases(spark, monkeypatch, k):
    monkeypatch.setattr(minhash, "CELL_PAIRS", 20)
    monkeypatch.setattr(minhash, "FINISH_PAIRS", 900)
    monkeypatch.setattr(minhash, "BLOCK_M", 16)
    df = spark.createDataFrame([(d, t, 1) for d, t in cases()], "doc_id long, text string, n int")
    assert got(minhash.near_duplicates(df, k)) == brute(cases(), k)


def test_empty(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_drop_keeps_one_of_each_group(spark):
    rows = [(5, "a b c d e f g h i j", "x"), (3, "a b c d e f g h i j", "y"), (9, None, None), (8, "other words", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in minhash.drop_near_duplicates(df).collect()) == [3, 8, 9]


def test_signature_estimates_jaccard():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2 ** 63, 900).astype(np.uint64)
    b = np.concatenate([a[:600], rng.integers(0, 2 ** 63, 300).astype(np.uint64)])
    sig = minhash.signatures(np.concatenate([a, b]), np.array([0, 900]), 1000)
    assert abs((sig[0] == sig[1]).mean() - 0.5) < 0.06


def test_marks_never_part_linked_sets_and_rule_out_most_others():
    rng = np.random.default_rng(3)
    sets, at = [], 0
    for n in (1, 2, 90, 130, 480, 520, 3000):  # families on both sides of a mark's sizes
        base = rng.integers(0, 2 ** 63, n).astype(np.uint64)
        for share in (0, 0.05, 0.1, 0.12, 0.18, 0.25, 0.5):
            new = base.copy()
            new[:round(share * n)] = rng.integers(0, 2 ** 63, round(share * n)).astype(np.uint64)
            sets += [np.unique(new), np.unique(new[:max(1, round(0.9 * n))])]
    table = pa.table({"bucket": [1] * len(sets), "bx": [0] * len(sets), "bm": [0] * len(sets), "node": list(range(len(sets))), "comp": list(range(len(sets))),
                      "n": [len(s) for s in sets], "mark": [minhash.mark(s).tobytes() for s in sets]})
    found = set(zip(*(minhash._possible(80, False)(table, table)[c].to_pylist() for c in ("pivot", "node"))))
    linked = {(i, j) for j in range(len(sets)) for i in range(j) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
    assert linked <= found and len(linked) > 50
    assert len(found) < 1.5 * len(linked)  # of 4,753 pairs, all of which were compared shingle by shingle
    best = set(zip(*(minhash._possible(80, True)(table, table.set_column(4, "comp", pa.array([-1] * len(sets))))[c].to_pylist() for c in ("pivot", "node"))))
    assert len(best) <= len(sets) and best <= found | {(i, i) for i in range(len(sets))}


def test_a_crowd_of_unlike_texts_is_settled_by_marks(spark, monkeypatch):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    base = [word() for _ in range(150)]
    rows = []
    for i in range(160):  # about 0.7 alike, some in pairs
        w = [word() if rng.random() < 0.05 else x for x in base]
        rows += [(2 * i, " ".join(w))] + [(2 * i + 1, " ".join(w[:-2]))] * (i % 3 == 0)
    compared = []
    monkeypatch.setattr(minhash, "_measured", lambda pairs, sets, t, f=minhash._measured: compared.append((out := f(pairs, sets, t)).count()) or out)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(minhash.near_duplicates(df, 2)) == brute(rows, 2)
    assert sum(compared) < len(rows) * (len(rows) - 1) / 2 / 4  # pairs compared shingle by shingle
