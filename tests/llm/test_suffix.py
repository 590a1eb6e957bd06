"""Suffix-array dedup against a dictionary of every 50-byte string."""

import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF001

from sparqa.llm import suffix


def brute(rows):
    least = {}
    raw = [(d, (t or "").encode()) for d, t in rows]
    key = lambda d: suffix.NO_ID if d is None else d
    for d, b in raw:
        for i in range(len(b) - 49):
            s = b[i:i + 50]
            least[s] = min(least.get(s, key(d)), key(d))
    out = []
    for d, b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 49):
            if least[b[i:i + 50]] < key(d):
                gone[i:i + 50] = True
        a = np.frombuffer(b, np.uint8)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(a[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_two_stage_order_is_the_suffix_order():
    rng = random.Random(3)
    for alphabet, n in ((2, 300), (4, 500), (1, 70), (250, 400)):
        text = np.array([rng.randrange(alphabet) for _ in range(n)], np.uint8)
        want = np.array(sorted(rng.sample(range(n), n // 2)))
        order = suffix.two_stage_order(text, want)
        assert sorted(order) == list(want)
        key = [bytes(np.append(text, np.zeros(60, np.uint8))[p:p + 50]) for p in order]
        assert key == sorted(key)
        word = suffix._words8(text)
        lcp = suffix.common_prefixes(word, order)
        for a, b, m in zip(key, key[1:], lcp):
            assert m == next((i for i in range(50) if a[i] != b[i]), 50)


def test_documents(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(suffix.report(docs)) == brute(rows)


def _cases():
    rng = random.Random(5)
    line = lambda n, a="abcdefgh ": "".join(rng.choice(a) for _ in range(n))
    hot = line(120)
    rows = [(i, line(200) + hot + line(rng.randrange(90))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "x" * 49), (103, "x" * 50), (104, "x" * 51), (105, "x" * 300), (None, hot), (None, hot + "y")]
    rows += [(7, rows[3][1]), (7, rows[3][1]), (200, "é" * 60), (201, "zé" + "é" * 60 + "q"), (202, "é" * 24 + "aa"), (203, "é" * 24 + "ab")]
    rows += [(300 + i, rows[5][1][:i] + "#" + rows[5][1][i:]) for i in range(0, 200, 17)]
    rows += [(400, "a" * 30 + "b" * 30 + "\x00" * 60), (401, "c" + "\x00" * 60), (402, line(30000, "ab"))]
    return rows


def test_edge_cases(spark, monkeypatch):
    for block, entries in ((1 << 20, 12000), (2000, 50)):
        monkeypatch.setattr(suffix, "BLOCK_BYTES", block)
        monkeypatch.setattr(suffix, "CONTEXT_BUCKET_ENTRIES", entries)
        monkeypatch.setattr(suffix, "ANCHOR_BUCKET_BYTES", 4000 if block < 9999 else 1 << 20)
        df = spark.createDataFrame([(d, t, d) for d, t in _cases()], "doc_id long, text string, _n long").repartition(5)
        assert got(suffix.report(df)) == brute(_cases())


def _template(n):
    rng = random.Random(9)
    noise = lambda k: "".join(rng.choice("abcdefgh ") for _ in range(k))
    return [(i, noise(60) + "All rights reserved. Page N of " + noise(60)) for i in range(n)]


def test_a_hot_anchor_is_spread_over_buckets():
    rows = _template(2000)
    t = pa.table({"_block": pa.array([0] * len(rows), pa.int32()), "_id": [i for i, _ in rows], "_text": [x for _, x in rows]})
    told = suffix._shared_anchors(100)(suffix._send_anchors(1)(t))
    sent = suffix._send_contexts(64)(t, told)
    sizes = [int(np.frombuffer(x.as_py(), np.int64, 1)[0]) for x in sent["data"]]
    assert len(sizes) == 64 and max(sizes) < 2 * sum(sizes) / 64


def test_a_block_of_hot_text_takes_bounded_memory():
    rng = random.Random(11)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(150)) + "All rights reserved. Page N of " + "".join(rng.choice("abcdefgh ") for _ in range(150)) for _ in range(6000)]
    t = pa.table({"_block": pa.array([0] * len(texts), pa.int32()), "_id": list(range(len(texts))), "_text": texts})
    # every anchor of the block told to be shared and hot: the worst case
    hashes = np.unique(np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in suffix._send_anchors(1)(t)["data"]]) | suffix._LOW)
    told = pa.table({"data": [(hashes - np.uint64(1)).tobytes()]})
    n = sum(map(len, texts))
    tracemalloc.start()
    suffix._send_contexts(200)(t, told)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 * n, peak / n


def test_template_line_in_all_documents(spark, monkeypatch):
    monkeypatch.setattr(suffix, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(suffix, "CONTEXT_BUCKET_ENTRIES", 100)
    rows = _template(600)
    rows += [(1000 + i, x[:100] + "#" + x[20:]) for i, x in rows[::7]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(suffix.report(df)) == brute(rows)


def test_clean_texts_keep_whole_characters_and_columns(spark):
    rows = [(1, "x", "é" * 40 + "tail one"), (2, None, "a" + "é" * 40 + " tail two"), (3, "z", "é" * 40)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    out = {r.doc_id: r for r in suffix.remove_repeats(df).collect()}
    assert out[1].text == rows[0][2]
    assert out[2].text == "a tail two" and out[2].lang is None
    assert 3 not in out
    assert suffix.remove_repeats(df).columns == df.columns


@pytest.mark.parametrize("rows", [[], [(1, None)]])
def test_empty(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [tuple(r)[:4] for r in suffix.report(df).collect()] == [(r[0], 0, 0, 0) for r in rows]
    assert suffix.remove_repeats(df).count() == 0
