"""Spelling variants against a brute-force version."""

import random
import re
import zlib
from collections import Counter

import pytest
from conftest import SF001

from sparqa.llm import spelling


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def brute_count(rows):
    count = Counter()
    for d, text in rows:
        for r in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            r = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r)
            h = zlib.crc32(f"{d}:{r}".encode())
            if h % 31 == 0:
                r = r[:h % len(r)] + r[h % len(r) + 1:]
            count[r] += 1
    return {w: n for w, n in count.items() if n >= 2 and len(w) >= 7}


def brute_variants(count):
    near = {w: [] for w in count}
    by_deletion = {}  # words one edit apart share a word with a letter less, or one is that word
    for w in count:
        for x in {w, *(w[:i] + w[i + 1:] for i in range(len(w)))}:
            by_deletion.setdefault(x, []).append(w)
    for group in by_deletion.values():
        for a in group:
            near[a] += [b for b in group if one_edit(a, b)]
    form = {}
    for w, others in near.items():
        best = min(set(others), key=lambda x: (-count[x], x), default=None)
        form[w] = best if best and count[best] >= 10 * count[w] else None
    out = []
    for w, n in count.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(set(near[w])), count[form[w]] if form[w] else None))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_scan_finds_all_pairs():
    rng = random.Random(1)
    for turn in range(400):
        words = sorted({"".join(rng.choice("abc"[:2 + turn % 2]) for _ in range(rng.choice([5, 6]))) for _ in range(rng.randrange(2, 60))})
        want = sorted((i, j) for i in range(len(words)) for j in range(i + 1, len(words))
                      if one_edit(words[i], words[j]) and not len(words[i]) == len(words[j]) == 6)
        assert sorted(spelling.scan(words, 5, 1 << 30)) == want
        share = [(i, j) for i, j in want if words[i][:2] != words[j][:2]]
        assert sorted(spelling.scan(words, 5, 2)) == share


@pytest.mark.parametrize("limit", [512, 6])
def test_lists_lose_no_pair_and_count_none_twice(spark, limit):
    rng = random.Random(limit)
    count = {}
    for _ in range(700):  # few letters: many near words, long lists with one first half
        w = rng.choice(["", "aaaa", "bbbbbb"]) + "".join(rng.choice("abÿ") for _ in range(rng.randrange(4, 9)))
        count[w] = rng.choice([2, 3, 20, 30, 200, 400, 5000])
    count |= {"x" * 3000: 2, "x" * 2999 + "y": 90, "y" + "x" * 3000: 1000, "ab": 2, "b": 30}
    df = spark.createDataFrame(list(count.items()), "word string, n long")
    assert got(spelling.variants(df, limit=limit)) == brute_variants(count)


def test_roots_follow_long_chains(spark):
    words = ["aaaaaaa" + "bcdefghij"[:i] for i in range(10)]
    count = {w: 2 * 10 ** i for i, w in enumerate(words)}
    out = {r.word: r.root for r in spelling.variants(spark.createDataFrame(list(count.items()), "word string, n long")).collect()}
    assert set(out.values()) == {words[-1]}


def test_documents(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    assert got(spelling.report(docs)) == brute_variants(brute_count([(r.doc_id, r.text) for r in docs.collect()]))


def test_edge_cases(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(1, None), (2, ""), (3, "short words only"), (4, "Straße Straßen STRASSE straßen " * 9), (4, "Straße Straßen STRASSE straßen " * 9), (None, "Ärgerlich ärgerlich Ängstlich"),
            (5, "letters1letters_letters-letters ×÷Àÿabcd" * 3), (6, "x" * 50_000 + " " + "x" * 50_000 + " " + "x" * 49_999)]
    for i in range(300):
        rows.append((10 + i, " ".join(rng.choice(["spelling", "spellings", "variant", "Variants", "grouping"]) for _ in range(30))))
    want = brute_variants(brute_count(rows))
    assert any(r[1] for r in want)
    for held in (400_000, 3):
        monkeypatch.setattr(spelling, "HELD_WORDS", held)
        df = spark.createDataFrame([(d, t, "w", 4) for d, t in rows], "doc_id long, text string, word string, n int")
        assert got(spelling.report(df)) == want


def test_empty(spark):
    assert spelling.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert spelling.count_words(spark.createDataFrame([], "doc_id long, text string")).count() == 0
