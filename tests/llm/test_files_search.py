"""WARC round trip, HTML rendering, nearest neighbours, and the pipeline's stages, against brute force."""

import hashlib
import re
import textwrap

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF001

import corpus_pipeline
from sparqa.llm import ann, html, license, mix, suffix, warc

PAGES = [(5, "http://a/", "x" * 200), (3, "http://b/", "x" * 200), (9, None, "x" * 200), (9, None, "x" * 200), (4, "u", "short"), (6, "u", "short"), (7, "", None), (8, "", ""),
         (None, "n", "x" * 200), (10, "a b\r\nc", "é" * 50), (11, "k", "é" * 50), (12, "long", "\r\n\r\nWARC/1.1\r\n" + "z" * 100000)]


def expected(rows):
    first, out = {}, []
    for p, _, h in rows:
        if p is not None:
            first[h] = min(first.get(h, p), p)
    for p, _, h in rows:
        b = (h or "").encode()
        again = len(b) >= 100 and p is not None and first[h] < p
        out.append((p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[h] if again else None))
    return sorted(out, key=str)


def test_warc(spark, tmp_dir):
    table = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{SF001}/pages.parquet").collect()]
    for k, rows in enumerate((PAGES, table, [])):
        df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, shard int")
        seen = []
        for parts in (1, 6):
            base = f"{tmp_dir}/w{k}-{parts}"
            manifest = warc.write(df.repartition(parts), base, shard_bytes=50_000, roll_bytes=2_000)
            seen.append(sorted((r.file, r.sha256) for r in manifest.collect()))
            back = warc.read(spark, base).collect()
            assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back), key=str) == expected(rows)
            assert all(r.payload is None or hashlib.sha256(r.payload).hexdigest() == r.payload_digest for r in back)
        assert seen[0] == seen[1]


def test_warc_cuts_inside_an_id(spark, tmp_dir):
    hot = [(None, f"u{i}", f"{i % 40}" * 500) for i in range(200)] + [(7, "same", "y" * 1000)] * 150 + [(7, f"v{i}", "z" * 1000) for i in range(100)]
    rows = [(i, f"w{i}", f"{i}-" * 100) for i in range(50)] + hot
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    seen = []
    for parts in (2, 7):
        base = f"{tmp_dir}/hot-{parts}"
        manifest = warc.write(df.repartition(parts), base, shard_bytes=20_000, roll_bytes=1 << 20).collect()
        assert max(r.records for r in manifest) <= 50 and sum(r.records for r in manifest) == len(rows)
        seen.append(sorted((r.file, r.sha256) for r in manifest))
        back = warc.read(spark, base).collect()
        assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back), key=str) == expected(rows)
        assert sorted((str(r.page_id), r.url) for r in back) == sorted((str(p), u) for p, u, _ in rows)
    assert seen[0] == seen[1]


def test_html_layout():
    cases = {
        "<p>a<p>b": "a\n\nb", "x<br>y": "x\ny", "<ul><li>1<li>2</ul>": "- 1\n- 2", "<ol start=4><li>a</ol>": "4. a",
        "<table><tr><td>a<td>bb<tr><td>ccc<td>d</table>": "a    bb\nccc  d", "<div hidden>x</div>y": "y", "<p style='display:none'>x</p>y": "y",
        "<style>.g, #h{visibility:hidden}</style><b class='f g'>x</b><i id=h>z</i>y": "y", "<script>a<b</script>c": "c", "a<!-- b -->c": "ac",
        "<pre>a\n  b</pre>": "a\n  b", "&lt;b&gt; &amp;": "<b> &", "": "", "<td>stray</b></i>": "stray", "a  \n b": "a b",
        "<details><summary>s</summary>t</details>": "s", "<ul><li>a<ul><li>b</ul></ul>": "- a\n  - b", "<blockquote>q</blockquote>": "> q",
        "<title>t</title>body": "body", "<b>unclosed": "unclosed", "a<b>b</b> c": "ab c", "<table><tr><td>1<table><tr><td>in</table></table>": "1\n\nin",
    }
    for page, text in cases.items():
        assert html.render(page) == text, page
    assert html.render(None) == "" and html.render("<div>" * 50000 + "deep") == "deep"


def test_html_no_visible_word_is_missing():
    cases = {
        "<table>w1<tr><td>w2</table>": "w1\nw2", "<table><tr>w1<td>w2<div>w3</div></td></tr></table>": "w1\nw2\nw3",
        "<table><tr><form><td>w1</td></form></tr></table>": "w1", "<table><tr><form><td>w1<td>w2</form><tr><td>w3</table>": "w1  w2\nw3",
        "<table><tr><a href=x>w1</a><p>w2</p><td>w3</table>": "w1\nw2\nw3", "<table><tbody>w1<tr><div>w2</div><td>w3</table>": "w1\nw2\nw3",
        "<table><tr><table><tr><td>w1</table><td>w2</table>": "w1\nw2", "<table><form><tr><td>w1<td>w2</tr></form></table>": "w1  w2",
        "<style>@media print{nav,.side{display:none}}</style><nav>w1</nav><p class=side>w2": "w1\n\nw2",
        "<style>@media screen{.s{display:none}} .t{color:red;display:none}</style><p class=s>x<p class=t>y<p>w1": "w1",
        "<style>@import 'a';@media print{.a{x:y}} .b{display:none}</style><p class=a>w1<p class=b>x": "w1",
        "<a title=don't>w1</a><b>it's</b>": "w1it's", "<p title=\"a>b\">w1": "w1", "<p title = 'a>b'>w1": "w1",
        "<textarea>w1</textarea> <select><option>w2<option>w3</select>": "w1\nw2\nw3", "<svg><text>w1</text></svg> <math><mi>w2</mi></math>": "w1 w2",
        "<svg><title>x</title><text>w1</text></svg>": "w1", "<table><caption hidden>x</caption><tr><td>w1</table>": "w1",
        "<table><tr>w1<td>w2</td>w3</table>": "w1\nw3\nw2", "<a href=a?b=\"c>w1</a>": "w1", "<p>w1<a" + " b='1'" * 3000: "w1",
    }
    for page, text in cases.items():
        got = html.render(page)
        assert re.findall(r"w\d|it's", got) == re.findall(r"w\d|it's", text) and "x" not in got and "y" not in got, (page, got)


def test_html_table(spark):
    df = spark.createDataFrame([(1, None, 2), (None, "<p>x", 3)], "page_id long, html string, text int")
    assert sorted(map(tuple, html.extract(df).collect()), key=str) == sorted([(1, "", 0), (None, "x", 1)], key=str)
    assert html.extract(df.limit(0)).count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8)], i % 3) for i in range(1, 900)]
    rows += [(1000 + i, rows[0][1], 0) for i in range(200)] + [(0, rows[5][1], 0), (2000, None, 0), (2001, [0.0] * 8, 0), (2002, [float("nan")] * 8, 0),
             (2003, [1.0, None] * 4, 0), (2004, [1.0], 0), (None, [1.0] * 8, 0), (500, rows[499][1], 9), (2100, [float("inf")] * 8, 0)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int"))
    fine = {i: np.array(v, np.float32).astype(float) for i, v, _ in rows if i is not None and v and len(v) == 8 and None not in v and np.isfinite(v).all() and any(v)}
    ids = np.array(sorted(fine))
    x = np.stack([fine[i] for i in ids])
    hit = total = 0
    found = {}
    for r in got.collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(found) == {i for i in ids if i % 100 == 0}
    for q, rs in found.items():
        d = np.sqrt(((x - fine[q]) ** 2).sum(1))
        d[ids == q] = np.inf
        best = ids[np.lexsort([ids, d])[:10]]
        assert [r[0] for r in sorted(rs)] == list(range(1, 11))
        for _, v, score in rs:
            assert score == pytest.approx(float(np.sqrt(((fine[v] - fine[q]) ** 2).sum())), abs=1e-12)
        hit += len({r[1] for r in rs} & set(best))
        total += 10
    assert hit / total >= 0.9
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 2.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r["rank"], r.vec_id) for r in ann.nearest(few).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2)]
    assert ann.nearest(few.limit(0)).count() == 0


def test_recall_on_the_table(spark):
    e = spark.read.parquet(f"{SF001}/embeddings.parquet")
    p = e.toPandas()
    x, ids = np.stack(p.embedding).astype(float), p.vec_id.values
    got = ann.nearest(e).toPandas()
    hits = []
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        hits.append(len(set(ids[np.lexsort([ids, d])[:10]]) & set(got[got.query_id == q].vec_id)))
    assert np.mean(hits) >= 9


def _unit(n, d=64):
    x = np.random.default_rng(2).normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1)[:, None]


def test_boundary_vectors_are_replicated(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST_ROWS", 16)
    x = _unit(3000)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<double>")
    postings, graph = ann.build(df, 10)
    got = {}
    for r in postings.select("list", "vec_id").collect():
        got.setdefault(r.vec_id, []).append(r.list)
    assert len(graph.c) > 150 and set(got) == set(range(3000))
    assert np.mean([len(v) for v in got.values()]) > 2
    dist = np.sqrt(((x[:, None] - graph.c) ** 2).sum(2))
    for i, lists in got.items():
        assert len(set(lists)) == len(lists) <= ann.REPLICAS
        assert dist[i, lists].max() <= ann.REPLICA_RATIO * dist[i, lists].min() + 1e-9


def test_probes_are_not_cut_by_the_beam():
    x = _unit(6000)
    graph = ann.Graph(ann.fit(x, 750))
    q = x[::300]
    batch = pa.RecordBatch.from_pydict({"vec_id": pa.array(range(len(q)), pa.int64()), "v": pa.array(q.tolist(), pa.list_(pa.float64()))})
    got = {}
    for t in ann._probe(graph, dict.fromkeys(range(750), 8), 1)([batch]):
        got |= dict(zip(t.column("query_id").to_pylist(), t.column("lists").to_pylist(), strict=True))
    assert set(got) == set(range(len(q)))
    most = hit = total = 0
    for i, v in enumerate(q):
        d = np.sqrt(((graph.c - v) ** 2).sum(1))
        want = np.flatnonzero(d <= ann.PROBE_RATIO * d.min() * (1 - 1e-9))
        most = max(most, len(want))
        hit += len(set(want) & set(got[i]))
        total += len(want)
    assert most > ann.BEAM and hit / total >= 0.98  # a walk that ends beyond the ratio may still miss a list


def test_recall_over_many_lists(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST_ROWS", 40)
    monkeypatch.setattr(ann, "SAMPLE_ROWS", 2000)
    x = _unit(20000)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(df).toPandas()
    hits = []
    for q in range(0, 20000, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        hits.append(len(set(np.argsort(d)[:10]) & set(got[got.query_id == q].vec_id)))
    assert np.mean(hits) >= 9, np.mean(hits)


def test_recall_of_queries_in_the_fitted_sample(spark, monkeypatch):
    """A fit in two levels, with half of the queries in the sample that the centroids come from."""
    monkeypatch.setattr(ann, "LIST_ROWS", 128)
    monkeypatch.setattr(ann, "SAMPLE_ROWS", 4000)
    x = _unit(40000)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = ann.stored(df.select("vec_id", df.embedding.alias("v")), "test-rows")
    fitted = {r.vec_id for r in ann._sampled(rows, 40000, 40000 // 128 * ann.FIT_ROWS).select("vec_id").collect()}
    got = ann.nearest(df, every=50).toPandas()
    hits = {True: [], False: []}
    for q in range(0, 40000, 50):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        hits[q in fitted].append(len(set(np.argsort(d)[:10]) & set(got[got.query_id == q].vec_id)))
    assert len(hits[True]) > 200 and len(hits[False]) > 200
    assert np.mean(hits[True]) >= 9 and np.mean(hits[False]) >= 9, (np.mean(hits[True]), np.mean(hits[False]))


@pytest.mark.parametrize("size", [1e200, 1e-200, 1e300])
def test_components_beyond_the_square_root_of_doubles(spark, size):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 6)) / 4
    df = spark.createDataFrame([(i, (v * size).tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(df, k=3).toPandas()
    for q in (0, 100, 200):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        mine = got[got.query_id == q].sort_values("rank")
        assert list(mine.vec_id) == list(np.argsort(d)[:3])
        assert np.allclose(mine.score / size, np.sort(d)[:3], rtol=1e-9)


def test_pipeline_stages(spark):
    from test_bpe import PATH, Tokenizer
    from test_bpe import expected as tokens
    from test_minhash import brute as near
    from test_native import counts

    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], SF001).cache())
        if stage is not corpus_pipeline.tokens:
            assert out[-1].columns == docs.columns
    rows = [[(r.doc_id, r.text) for r in d.collect()] for d in out[:-1]]
    assert sorted(rows[1]) == sorted((d, t) for d, t in rows[0] if counts(t)[-1])
    stay = {r[0] for r in near(rows[1], 5) if r[3]}
    assert sorted(rows[2]) == sorted(x for x in rows[1] if x[0] in stay)
    least = {}
    for d, t in sorted(rows[2]):
        b = t.encode()
        for i in range(len(b) - 49):
            least.setdefault(b[i:i + 50], d)
    want = []
    for d, t in rows[2]:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 49):
            if least[b[i:i + 50]] < d:
                gone[i:i + 50] = True
        kept, at = "", 0
        for c in t:
            n = len(c.encode())
            kept += "" if gone[at:at + n].all() else c
            at += n
        if kept.strip(" \t\n\x0b\x0c\r"):
            want.append((d, kept))
    assert sorted(rows[3]) == sorted(want)
    taken = {r.doc_id: r.taken for r in mix.report(out[3], corpus_pipeline.PIPELINE_BLOCK_WORDS).collect() if r.taken}
    words = {}
    texts = dict(rows[3])
    for d, t in rows[4]:
        assert t.strip() in texts[d]
        words[d] = words.get(d, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t))
    assert words == taken
    assert sorted((tuple(r) for r in out[5].collect()), key=str) == tokens(Tokenizer.from_file(PATH), rows[4])
    assert suffix.MATCH == 50


def test_pipeline_of_nothing(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF001)
    assert docs.count() == 0


def test_license_lines_and_whole_texts(spark):
    mit = license.KNOWN[1][1]
    isc = next(t for i, t in license.KNOWN if i == "ISC")
    docs = spark.createDataFrame(
        [(1, f"Intro.\n\n  (c) 2020 Someone\nLICENCED under the  mit-licence!\n", "x"), (2, f"Copyright 1999 A\n{isc.upper()}", "x"),
         (3, None, "x"), (4, "", "x"), (5, "copyright 2001 B\n(c) C", "x"), (5, "copyright 2001 B\n(c) C", "x"), (6, mit + " And more.", "x")],
        "doc_id long, text string, digest string")
    got = license.scan(docs, license.known_table(spark))
    found = {(r.doc_id, r.unit, r.position, r.license_id) for r in got.collect()}
    assert found == {(1, "text", -1, None), (1, "line", 3, "MIT"), (2, "text", -1, "ISC"), (3, "text", -1, None), (4, "text", -1, None),
                     (5, "text", -1, None), (6, "text", -1, None)}
    assert got.where("doc_id = 5").count() == 2
    assert {r.doc_id for r in got.where("digest is null").collect()} == {3, 4, 5}
    assert license.scan(docs.limit(0), license.known_table(spark)).count() == 0


def test_license_files_wrapped_and_titled(spark):
    mit = license.KNOWN[-1][1]
    rows, want = [], []
    for text, name in ((mit, "MIT"), *((t, i) for i, t in license.full_texts())):
        for width in (44, 60, 77):
            blocks = [b if re.search(r"(?im)^\s*copyright \W*(c\W|\d|yyyy)", b) else textwrap.fill(b, width, break_on_hyphens=False, break_long_words=False)
                      for b in re.split(r"\n\s*\n", text)]
            rows.append((len(rows), "\n\n".join(blocks)))
            want.append(name)
    for head in ("MIT License\n\nCopyright (c) 2020 Someone\n\n", "The MIT License (MIT)\r\nCopyright Jane Doe, Inc.\r\n", "\u00a9 Some People\n"):
        rows.append((len(rows), head + mit.replace("AUTHORS OR COPYRIGHT HOLDERS", "AUTHORS OR\nCOPYRIGHT HOLDERS")))
        want.append("MIT")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.license_id for r in license.scan(docs, license.known_table(spark)).where("unit = 'text'").collect()}
    assert [i for i, w in enumerate(want) if got[i] != w and not (w.startswith("BSD") and (got[i] or "").startswith("BSD"))] == []
    assert {"MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0", "GPL-3.0", "MPL-2.0"} <= set(got.values())
