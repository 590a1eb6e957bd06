"""C6 from an entity table, against a plain scan of every position."""

import random

import pytest
from pyspark.sql import functions as F

from sparqa.operators import gazetteer as gz


def brute(text, table):
    out, i = [], 0
    text = text or ""
    while i < len(text):
        hits = [s for s in table if s and text.startswith(s, i) and (i == 0 or not text[i - 1].isalnum())
                and (i + len(s) == len(text) or not text[i + len(s)].isalnum())]
        if hits:
            s = max(hits, key=len)
            out.append((i, s, table[s]))
            i += len(s)
        else:
            i += 1
    return out


def _data():
    rng = random.Random(6)
    names = ["Ann", "Ann Arbor", "Arbor", "Arbor Day", "Day", "New York", "York", "York City Hall", "City", "Ünal", "東京", "3M", "a.b", "a", "b a"]
    table = {n: rng.choice(["PERSON", "PLACE", "ORG"]) for n in names}
    words = ["Ann", "Arbor", "Day", "New", "York", "City", "Hall", "Ünal", "東京", "3M", "a.b", "a", "b", "Annex", "xAnn", "of", "."]
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 40)))) for i in range(200)]
    texts += [(1000, None), (1001, ""), (1002, "Ann"), (1003, "Ann,Ann\nAnn Arbor Day"), (1004, "Ann " * 5000)]
    return table, texts


@pytest.mark.parametrize("part", [100_000, 4, 1])
def test_mentions_are_leftmost_longest(spark, monkeypatch, part):
    monkeypatch.setattr(gz, "BLOCK_CHUNKS", 60)
    table, texts = _data()
    chunks = spark.createDataFrame([(d, d % 7, t) for d, t in texts], "doc_id long, pos int, chunk string")
    rows = [*table.items(), ("Ann", "ZZZ"), ("", "X"), (None, "X")]
    ents = spark.createDataFrame(rows, "surface string, label string")
    got = {r.doc_id: [tuple(m) for m in r.mentions] for r in gz.tag_mentions(chunks, ents, ["doc_id", "pos"], part_surfaces=part).collect()}
    assert got == {d: brute(t, table) for d, t in texts}


def test_enriched_text(spark):
    chunks = spark.createDataFrame([(1, 0, "Ann met Ann in New York"), (2, 0, "nobody"), (3, 0, None)], "doc_id long, pos int, chunk string")
    ents = spark.createDataFrame([("Ann", "PERSON"), ("New York", "PLACE"), ("York", "PLACE")], "surface string, label string")
    for part in (100, 1):
        out = {r.doc_id: r.chunk for r in gz.enrich_from_table(chunks, ents, ["doc_id", "pos"], part_surfaces=part).collect()}
        assert out == {1: "Ann met Ann in New York\n\n[Entities: Ann(PERSON), Ann(PERSON), New York(PLACE)]", 2: "nobody", 3: None}


def test_no_entities_and_no_chunks(spark):
    chunks = spark.createDataFrame([(1, 0, "Ann")], "doc_id long, pos int, chunk string")
    none = spark.createDataFrame([], "surface string, label string")
    assert gz.enrich_from_table(chunks, none, ["doc_id", "pos"]).first().chunk == "Ann"
    ents = spark.createDataFrame([("Ann", None), ("Bea", "P")], "surface string, label string")
    assert gz.enrich_from_table(chunks.where(F.lit(False)), ents, ["doc_id", "pos"], part_surfaces=1).count() == 0
    assert gz.tag_mentions(chunks, ents, ["doc_id", "pos"]).first().mentions[0].label == ""
