"""Quality rules, source mix, k-d shards and licence digests against brute force."""

import collections
import re
import zlib

import pytest
from conftest import SF001

from sparqa.llm import kdtree, license, mix, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, lang string, size int, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(d, t, s, "en", 0, len(t or "")) for d, t, s in rows], SCHEMA)


EDGE = [(1, None, "a"), (2, "", "a"), (3, " \n\t", None), (4, "one", "b"), (5, "x y z x y z w", None), (6, "word " * 60, "b"), (6, "word " * 60, "b"),
        (7, "a b\na b\n\nc d\x0be\x0c", ""), (None, "no id at all", "c"), (8, " ".join(f"alpha{i}" for i in range(30000)), "a"),
        (9, " ".join(f"w{i}é#" for i in range(80)), "c"), (10, "p q r s p q r t " * 3, "c")]


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    tri = collections.Counter(zip(w, w[1:], w[2:]))
    cov = {p + k for p in range(len(w) - 2) if tri[w[p], w[p + 1], w[p + 2]] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(w)
    base = n < 50 or 100 * len(cov) > 50 * n
    chars, sym = sum(map(len, w)), sum(text.count(c) for c in quality.SYMBOLS)
    dup = len(lines) - len(set(lines))
    bad = (10 * sym > n or chars < 3 * n or chars > 10 * n or 10 * dup > 3 * len(lines) or 10 * sum(any(c.isalpha() for c in x) for x in w) < 8 * n
           or 2 * sum(c.isupper() for c in text) > chars)
    return n, chars, sym, dup, len(cov), base, not (base or bad)


def test_quality(spark):
    table = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    for rows in (table, EDGE, []):
        df = docs_of(spark, rows)
        assert sorted(map(tuple, quality.report(df).collect()), key=str) == sorted(((d, *counts(t)) for d, t, _ in rows), key=str)
        kept = quality.quality_filter(df)
        assert kept.columns == df.columns
        assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted((d, t) for d, t, _ in rows if counts(t)[-1])


def targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mix.WEIGHTS[i % 3] for i, s in enumerate(names)}
    left, out, free = sum(sizes.values()), {}, set(names)
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 3 * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = 3.0 * sizes[s]
        left -= sum(out[s] for s in over)
        free -= over
    return out


@pytest.mark.parametrize("block", [4, 64])
def test_mix(spark, block):
    table = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    for rows in (EDGE, [(1, "", "a")]) if block == 4 else (table, []):
        df = docs_of(spark, rows)
        got = mix.report(df, block).collect()
        assert sorted(map(str, got)) == sorted(map(str, mix.report(df.repartition(3), block).collect()))
        sizes, taken = collections.Counter(), collections.Counter()
        for _, t, s in rows:
            sizes[s] += len(WORD.findall(t or ""))
        want = targets(sizes)
        assert sorted((r.doc_id, r["size"]) for r in got if r.doc_id is not None) == sorted((d, len(WORD.findall(t or ""))) for d, t, _ in rows if d is not None)
        source = {(d, len(WORD.findall(t or ""))): s for d, t, s in rows}
        for r in got:
            s = source[r.doc_id, r["size"]]
            assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s]) and 0 <= r.taken <= 3 * r["size"]
            taken[s] += r.taken
        for s in sizes:  # to half a word
            assert abs(taken[s] - want[s]) <= 0.5 + 1e-6
        pieces = collections.Counter()
        out = mix.mixed_documents(df, block)
        assert out.columns == df.columns
        for r in out.collect():
            pieces[r.doc_id] += len(WORD.findall(r.text))
            assert r.n_chars == len(r.text)
        by_id = collections.Counter()
        for r in got:
            by_id[r.doc_id] += r.taken
        assert {k: v for k, v in pieces.items() if v} == {k: v for k, v in by_id.items() if v}
        blocks = mix.mixed_pieces(df, block, shard_slots=50).collect()
        # a slot is one block of one source, and is in one shard
        assert len({(r["shard"], r["slot"], r["block"], r._row.source) for r in blocks}) == len({(r["slot"], r._row.source) for r in blocks})


def plan_of(spark, sizes):
    sizes = spark.createDataFrame([(s, n) for s, n in sizes], "source string, size long")
    return mix.stored(mix.targets(mix._keyed(sizes)), "test-plan")


@pytest.mark.parametrize("size", [1, 25, 64, 1000])
def test_mix_takes_each_target_to_a_word(spark, size):
    """Small sources too: a last slot takes what is missing."""
    sizes = {f"s{i:02}": size + i % 3 for i in range(30)}
    plan = plan_of(spark, sizes.items())
    got = collections.Counter()
    seen = collections.Counter()
    for r in mix.slots(plan, 64, 11, shard_slots=16).collect():
        got[r._src] += r["words"]
        seen[r._src, r["pass"], r["block"]] += 1
    assert max(seen.values()) == 1
    want = targets(sizes)
    assert all(abs(got[s] - want[s]) <= 0.5 + 1e-6 for s in sizes)


def test_mix_permutations_are_whole_and_unlike_a_stride(spark):
    df = spark.createDataFrame([(0, f"s{n}", n) for n in [*range(1, 40), 500, 1597]], "_nosrc int, _src string, n long")
    x = df.withColumn("x", mix.F.explode(mix.F.sequence(mix.F.lit(0).cast("long"), mix.F.col("n") - 1)))
    x = x.withColumn("y", mix._walked(mix.F.col("x"), mix.F.col("n"), mix.F.lit(2), 5))
    x = x.withColumn("z", mix._walked(mix.F.col("y"), mix.F.col("n"), mix.F.lit(2), 5, back=True)).collect()
    assert all(r.x == r.z for r in x)
    for n in (*range(1, 40), 500, 1597):
        to = {r.x: r.y for r in x if r.n == n}
        assert sorted(to.values()) == list(range(n))
        if n >= 500:
            steps = collections.Counter((to[i + 1] - to[i]) % n for i in range(n - 1))
            assert max(steps.values()) < 12


def test_mix_shard_counts_are_a_multinomial_draw(spark):
    quota = mix.stored(mix.quotas(plan_of(spark, [("a", 400_000), ("b", 100_000), ("c", 30_000)]), 64, 11), "test-quota")
    counts = mix.shard_counts(quota, 11, shard_slots=500).collect()
    slots = {r._src: r._slots for r in quota.collect()}
    n = max(r.shard for r in counts) + 1
    assert n == -(-sum(slots.values()) // 500)
    for s, k in slots.items():
        per = [next((r["count"] for r in counts if r._src == s and r.shard == i), 0) for i in range(n)]
        assert sum(per) == k
        chi = sum((x - k / n) ** 2 / (k / n) for x in per)
        assert n / 3 < chi < 3 * n


def test_kd_shards(spark):
    table = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    same = [(i, "equal text " * 5, "a") for i in range(900)]
    for rows, n in ((table, 5), (same, 7), (EDGE, 3), ([], 4), (EDGE[:2], 8)):
        got = kdtree.report(docs_of(spark, rows), n).collect()
        enc = [(t or "").encode() for _, t, _ in rows]
        assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in got), key=str) == sorted(((d, len(b) + 16, zlib.crc32(b)) for (d, _, _), b in zip(rows, enc)), key=str)
        slots = collections.defaultdict(list)
        bytes_ = collections.Counter()
        for r in got:
            assert 0 <= r.shard < n and r.law == "bytes" and r.grown_shard is None
            slots[r.shard].append(r.slot)
            bytes_[r.shard] += r["size"]
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
        if rows is same or rows is table:
            biggest = max(len(b) + 16 for b in enc)
            assert max(bytes_.values()) - min(bytes_[i] for i in range(n)) <= 2.5 * biggest


def test_kd_shards_cut_inside_a_repeated_row(spark):
    rows = [(i, f"text {i}", "a") for i in range(2000)] + [(5000, "one row again and again", "b")] * 1000
    got = kdtree.report(docs_of(spark, rows), 40).collect()
    bytes_, slots = collections.Counter(), collections.defaultdict(list)
    for r in got:
        bytes_[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert len(got) == 3000 and len(bytes_) == 40 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(bytes_.values()) - min(bytes_.values()) <= 2 * max(len(t) + 16 for _, t, _ in rows)


def test_licenses(spark):
    mit = next(t for i, t in license.KNOWN if i == "MIT" and len(t) > 100)
    rows = [(1, None, ""), (2, " ", ""), (3, mit.upper().replace("LICENSE", "LICENCE"), ""), (4, "Copyright (c) 2020 A. Person\n" + mit, ""), (5, mit + " extra", ""),
            (6, "intro\nreleased under the MIT licence!\nrest", ""), (6, "intro\nreleased under the MIT licence!\nrest", ""), (None, "Licensed under CC BY 4.0.", "")]
    got = license.scan(docs_of(spark, rows), license.known_table(spark)).collect()
    whole = [(r.doc_id, r.license_id) for r in got if r.unit == "text"]
    assert sorted(whole, key=str) == sorted([(1, None), (2, None), (3, "MIT"), (4, "MIT"), (5, None), (6, None), (6, None), (None, "CC-BY-4.0")], key=str)
    assert [(r.doc_id, r.position, r.license_id) for r in got if r.unit == "line" and r.doc_id == 6] == [(6, 1, "MIT")] * 2
    assert license.scan(docs_of(spark, []), license.known_table(spark)).count() == 0
