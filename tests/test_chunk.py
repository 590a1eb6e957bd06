import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparqa.operators import chunk as ch
from sparqa.plans import oracles as O

# C1/C2 quirks, chunk_size=10
GOLDEN = [
    ("aa\n\nbb", ["aa bb"]),
    ("aaaa\n\nbbbb\n\ncccc\n\ndd", ["aaaa bbbb", "ccccdd"]),
    ("abcdefghijklmnop", ["abcdefghijklmnop"]),
    ("Hello you. Bye now", ["Hello you", "Bye now"]),
    ("a\n\n\n\nb", ["a  b"]),
    ("", []),
    ("abcdefghijk. x", ["abcdefghijk", "x"]),
    (" ab \n\n\x1ccd", ["ab cd"]),
]


def _chunk(spark, texts, size, block=None):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    rows = df.select("id", ch.chunk_text("text", size, method="recursive", block=block).alias("c")).collect()
    return [r.c for r in sorted(rows, key=lambda r: r.id)]


def test_golden_cases(spark):
    for block in (None, 1, 2):  # block size never changes the chunks
        got = _chunk(spark, [t for t, _ in GOLDEN], 10, block)
        assert got == [e for _, e in GOLDEN]


def test_non_bmp_and_no_separators(spark):
    text = "😀" * 12 + " ok"
    got = _chunk(spark, [text, None], 10)
    assert got[0] == ["😀" * 12, "ok"]
    assert got[1] == []


def test_unknown_method_raises():
    with pytest.raises(ValueError):
        ch.chunk_text("text", 10)  # default method is not implemented
    with pytest.raises(ValueError):
        ch.chunk_text("text", 10, method="semantic")


def _duck_chunks(texts, size):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    rows = con.execute(f"WITH {O.chunks_cte(size)} SELECT doc_id, pos, chunk FROM chunks").fetchall()
    out = {i: [] for i in range(len(texts))}
    for d, p, c in sorted(rows):
        out[d].append(c)
    return [out[i] for i in range(len(texts))]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \n.\t\x1c", max_size=60), min_size=1, max_size=8),
       st.sampled_from([3, 5, 10]))
def test_matches_duckdb_chunker(spark, texts, size):
    expected = _duck_chunks(texts, size)
    assert _chunk(spark, texts, size) == expected
    assert _chunk(spark, texts, size, block=2) == expected  # many block boundaries


def test_blocked_packing_equals_flat_fold(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    flat = ch.pack_pieces(ch.split_pieces("text", 120), 120)
    cmp = docs.select(flat.alias("a"), ch.chunk_text("text", 120, method="recursive", block=3).alias("b"),
                      ch.chunk_text("text", 120, method="recursive").alias("c"))
    assert cmp.where((F.col("a") != F.col("b")) | (F.col("a") != F.col("c"))).count() == 0


def test_long_document_is_linear(spark):
    import time
    text = ". ".join(f"word{i % 97} more words here" for i in range(60000))
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    t0 = time.time()
    n = ch.chunk_documents(df, chunk_size=500).count()
    assert n > 2000 and time.time() - t0 < 30


def test_properties_on_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    chunks = ch.chunk_documents(docs, chunk_size=120)
    # length <= size unless the chunk is one unsplittable word
    bad = chunks.where((F.length("chunk") > 120) & F.col("chunk").contains(" "))
    assert bad.count() == 0
    # non-whitespace characters other than '.' survive in order
    pieces = chunks.groupBy("doc_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "chunk"))), lambda x: x["chunk"]),
                     "").alias("joined"))
    cmp = docs.join(pieces, "doc_id").select(
        F.regexp_replace("text", r"[\s.\x1c-\x1f]", "").alias("a"),
        F.regexp_replace("joined", r"[\s.\x1c-\x1f]", "").alias("b"))
    assert cmp.where(F.col("a") != F.col("b")).count() == 0


def test_enrich_entities_join_and_inline_agree(spark):
    chunks = spark.createDataFrame([(1, 0, "Alice met Bob in Paris and Alice left"), (1, 1, "no names here")],
                                   "doc_id long, pos int, chunk string")
    keys = ["doc_id", "pos"]
    joined = ch.enrich_entities(chunks, ch.entity_mentions(chunks, keys), keys)
    inline = chunks.select(*keys, ch.enrich_inline("chunk").alias("chunk"))
    a = sorted(tuple(r) for r in joined.collect())
    b = sorted(tuple(r) for r in inline.collect())
    assert a == b
    assert a[0][2].endswith("[Entities: Alice(TERM), Bob(TERM), Paris(TERM), Alice(TERM)]")
    assert a[1][2] == "no names here"
