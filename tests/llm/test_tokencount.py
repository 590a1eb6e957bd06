"""Token counts against the tokenizers library."""

import random

import public_tokenizers
import pytest
from conftest import SF001
from tokenizers import Tokenizer

from sparqa.llm import tokencount

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(PATH)


def expected(tok, rows):
    n = [(d, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for d, t in rows]
    return sorted(((d, b, k, k > 1024) for d, b, k in n), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_documents(spark, tok):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    assert got(tokencount.report(docs, PATH)) == expected(tok, [(r.doc_id, r.text) for r in docs.collect()])


def test_edge_cases(spark, tok, monkeypatch):
    rng = random.Random(7)
    rows = [(1, None), (2, ""), (3, " "), (4, "a" * 20001), (5, "<|endoftext|>x <|endoftext|><|endoftext"), (5, "<|endoftext|>x <|endoftext|><|endoftext"),
            (6, "\x00\x1c\x85 　z​\n\n  \t"), (7, "I'll we've 'S don't"), (8, "日本語 ünïcödé 𝒳😀👩‍👩‍👧 ½ ٣"), (None, "null id"), (9, "\r\n \x0b\x0c "),
            (10, "é" * 500 + " " + "-" * 700), (11, "word " * 1024), (12, " word" * 1024), (13, " word" * 1025)]
    for i in range(200):
        rows.append((100 + i, "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x500), rng.randrange(0x2000, 0x3100), 32])) for _ in range(60))))
    for i in range(20):
        rows.append((400 + i, "".join(rng.choice("aabbe  ") for _ in range(500))))
    df = spark.createDataFrame([(d, t, 5) for d, t in rows], "doc_id long, text string, n_tokens int").coalesce(1)
    assert got(tokencount.report(df, PATH)) == expected(tok, rows)
    monkeypatch.setattr(tokencount, "KNOWN_PIECES", 10)
    monkeypatch.setattr(tokencount, "KNOWN_CHARS", 3)
    c = tokencount.Counter(PATH)
    assert [c.count(t or "") for _, t in rows] == [len(tok.encode(t or "", add_special_tokens=False).ids) for _, t in rows]
    assert len(c.known) < 500


def test_a_long_piece_takes_n_log_n(tok):
    text = "abcdefgh" * 40_000  # one piece
    assert tokencount.Counter(PATH).count(text) == len(tok.encode(text, add_special_tokens=False).ids)


def test_columns_and_empty(spark):
    df = spark.createDataFrame([(1, "hello wörld", "x"), (2, None, None)], "doc_id long, body string, n_tokens string")
    out = {r.doc_id: r for r in tokencount.with_counts(df, PATH, text="body").collect()}
    assert out[1].n_tokens == 4 and out[2].n_tokens == 0 and out[1].body == "hello wörld"
    assert tokencount.report(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
