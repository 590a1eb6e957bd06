"""BPE against the tokenizers library."""

import hashlib
import random

import public_tokenizers
import pytest
from conftest import SF001
from tokenizers import Tokenizer

from sparqa.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(PATH)


def expected(tok, rows):
    out = []
    for d, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        back = tok.decode(ids, skip_special_tokens=False)
        out.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_documents(spark, tok):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(bpe.report(docs, PATH)) == expected(tok, rows)


def cases():
    rng = random.Random(4)
    rows = [(1, None), (2, ""), (3, " "), (4, "a" * 1001), (5, "<|endoftext|>x <|endoftext|><|endoftext"), (6, "\x00\x1c\x85 　z​\n\n  \t"),
            (7, "I'll we've 'S don't"), (8, "日本語 ünïcödé 𝒳😀👩‍👩‍👧 ½ ٣"), (9, "1234567 12.5e-7"), (None, "null id"), (9, "1234567 12.5e-7"),
            (10, "İİ ǅ"), (11, "\r\n \x0b\x0c ")]
    for i in range(200):
        rows.append((100 + i, "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x500), rng.randrange(0x2000, 0x3100), 32])) for _ in range(60))))
    for i in range(20):
        rows.append((400 + i, "".join(rng.choice("aabbe  ") for _ in range(500))))
    return rows


def test_edge_cases(spark, tok, monkeypatch):
    for size in (8 << 20, 100):
        monkeypatch.setattr(bpe, "CHUNK_CHARS", size)
        df = spark.createDataFrame([(d, t, 0) for d, t in cases()], "doc_id long, text string, ids int").coalesce(1)
        assert got(bpe.report(df, PATH)) == expected(tok, cases())


def test_index_encodes_any_piece(tok):
    v = bpe.vocabulary(PATH)
    pieces = ["", "aaaaaaa", " the", "ééé", "x" * 300]
    assert bpe.encode_pieces(pieces, v) == [tok.encode(p, add_special_tokens=False).ids for p in pieces]


def test_encode_decode_columns(spark):
    df = spark.createDataFrame([(1, "hello wörld", "x"), (2, None, None)], "doc_id long, text string, note string")
    out = {r.doc_id: r for r in bpe.decode(bpe.encode(df, PATH), PATH).collect()}
    assert out[1].decoded == "hello wörld" and out[1].note == "x" and out[2].decoded == "" and out[2].ids == []


def test_empty(spark):
    assert bpe.report(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
