import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from sparqa.operators import collection as coll
from sparqa.sources.corpus import assemble_pages, isolate_failures, safe_extract, scan_corpus
from sparqa.sources.results import load_generated, load_qa, union_results


def _write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_csv_scan_quotes_newlines_and_na(spark, tmp_dir):
    p = os.path.join(tmp_dir, "qa.csv")
    _write(p, 'question,answer,extra\n"line1\nline2","say ""hi""",x\nNA,null,y\n"q3",nan,z\n')
    rows = load_qa(spark, p).collect()
    assert rows[0].question == "line1\nline2" and rows[0].answer == 'say "hi"' and rows[0].extra == "x"
    assert rows[1].question is None and rows[1].answer is None and rows[2].answer is None


def test_missing_required_columns_sorted(spark, tmp_dir):
    p = os.path.join(tmp_dir, "bad.csv")
    _write(p, "foo\n1\n")
    with pytest.raises(ValueError, match=r"\['answer', 'question'\]"):
        load_qa(spark, p)


def test_generated_fill_and_contexts(spark, tmp_dir):
    p = os.path.join(tmp_dir, "g.csv")
    _write(p, "question,answer,generated_answer,retrieved_contexts\nq,a,,\"['x', 'y']\"\nq2,a2,g,\n")
    rows = load_generated(spark, p).orderBy("question").collect()
    assert rows[0].generated_answer == "" and rows[0].retrieved_contexts == ["x", "y"]
    assert rows[1].retrieved_contexts == []
    _write(p, "question,answer,generated_answer\nq,a,g\n")
    assert load_generated(spark, p).first().retrieved_contexts == []


def test_assemble_pages_and_failures(spark):
    pages = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, None)], "doc_id long, page_no int, text string")
    got = {r.doc_id: r.text for r in assemble_pages(pages).collect()}
    assert got == {1: "ab", 2: ""}

    def extract(v):
        if v == "bad":
            raise IOError("cannot read")
        return v.upper()

    docs = spark.createDataFrame([(1, "ok"), (2, "bad")], "doc_id long, raw string")
    x = docs.select("doc_id", safe_extract(extract)(F.col("raw")).alias("r")).select("doc_id", "r.value", "r.error")
    kept, errors = isolate_failures(x)
    assert [r.doc_id for r in kept.collect()] == [1]
    assert errors.first().error.startswith("OSError")


def test_scan_corpus_binary_and_text(spark, tmp_dir):
    os.makedirs(os.path.join(tmp_dir, "a", "b"))
    _write(os.path.join(tmp_dir, "a", "b", "x.pdf"), "%PDF")
    _write(os.path.join(tmp_dir, "a", "y.PDF"), "%PDF")
    _write(os.path.join(tmp_dir, "a", "z.txt"), "text")
    found = scan_corpus(spark, tmp_dir, "binary").select("path").collect()
    assert [os.path.basename(r.path) for r in found] == ["x.pdf"]


def test_union_by_name_fills_missing(spark):
    a = spark.createDataFrame([(1, 0.5)], "row_id long, faithfulness double")
    b = spark.createDataFrame([(2,)], "row_id long")
    rows = sorted(union_results({"A": a, "B": b}).collect(), key=lambda r: r.row_id)
    assert (rows[1].label, rows[1].faithfulness) == ("B", None)


def test_collection_dimension_guard(spark):
    path = coll.scratch_path(spark, "guard")
    assert coll.create_collection(spark, path, 4) == "created"
    assert coll.collection_count(spark, path) == 0
    assert coll.create_collection(spark, path, 4) == "reused"
    with pytest.raises(ValueError, match="length 4"):
        coll.create_collection(spark, path, 8)
    assert coll.create_collection(spark, path, 8, recreate_on_dimension_mismatch=True) == "recreated"
    assert coll.collection_dimension(spark, path) == 8
    assert coll.collection_count(spark, coll.scratch_path(spark, "absent")) == 0


def test_entry_and_registry(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 40 and df.columns == ["qid", "question", "n_contexts", "context", "generated_answer"]
    assert all(r.n_contexts == 3 for r in rows)
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q) and len(q) >= 60


def test_streaming_indexer_matches_batch(spark, tmp_dir):
    from sparqa.operators import chunk as ch
    from sparqa.streaming.indexer import start_indexer
    src = os.path.join(tmp_dir, "in")
    docs = spark.createDataFrame([(1, "alpha beta.\n\ngamma", "en", "s", 17), (2, "delta", "en", "s", 5)],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(src)
    path = coll.scratch_path(spark, "stream-t")
    q = start_indexer(spark, src, path, dim=16, chunk_size=10,
                      checkpoint=os.path.join(tmp_dir, "ckpt"))
    q.awaitTermination()
    got = sorted((r.doc_id, r.pos, r.text) for r in coll.read_points(spark, path).collect())
    exp = sorted(tuple(r) for r in ch.chunk_documents(docs, chunk_size=10).collect())
    assert got == exp


def test_scan_corpus_nothing_found(spark, tmp_dir):
    _write(os.path.join(tmp_dir, "a.txt"), "x")
    assert scan_corpus(spark, tmp_dir, "binary").count() == 0
    missing = scan_corpus(spark, os.path.join(tmp_dir, "missing"), "binary")
    assert missing.count() == 0 and missing.columns == ["doc_id", "path", "modificationTime", "length", "content"]


def test_report_formats(spark):
    from sparqa.operators.report import method_averages, report_rows, report_summary
    df = spark.createDataFrame(
        [(0, "q?", "it's", "ref", ["a'b", "line\none", 'say "x"'], 0.5, None, float("nan"), 0.123456789)],
        "row_id long, user_input string, response string, reference string, retrieved_contexts array<string>, "
        "context_precision double, context_recall double, faithfulness double, answer_relevancy double")
    md = report_rows(df).first().markdown
    assert md.startswith("# Question 1\n\n## User Question\nq?\n\n## Generated Answer\nit's\n\n")
    assert "1. \"a'b\"\n2. 'line\\none'\n3. 'say \"x\"'\n" in md
    assert md.endswith("| 0.5000 | nan | nan | 0.1235 |\n\n ")
    avg = method_averages(df.withColumn("method", F.lit("m")))
    s = report_summary(avg).first().summary
    assert "Method Used: m\n" in s and "Overall Average Context Precision: 0.50\n" in s
    assert "Overall Average Context Recall: 0.00\n" in s and "Overall Average Answer Relevancy: 0.12\n" in s


def test_index_once_and_empty_without_docs(spark):
    from sparqa.operators.chunk import chunk_documents
    from sparqa.operators.embed import embed
    docs = spark.createDataFrame([(1, "alpha beta. gamma")], "doc_id long, text string")
    path = coll.scratch_path(spark, "index-once")
    kw = dict(dim=16, chunker=lambda d: chunk_documents(d, chunk_size=10), embed_fn=lambda c: embed(c, "chunk"))
    with pytest.raises(ValueError, match="empty"):
        coll.index_corpus(spark, None, path, **kw)
    first = coll.index_corpus(spark, docs, coll.scratch_path(spark, "index-once2"), **kw)
    assert first["action"] == "created" and first["n_points"] == 2
    p2 = coll.scratch_path(spark, "index-once3")
    coll.index_corpus(spark, docs, p2, **kw)
    again = coll.index_corpus(spark, docs, p2, **kw)
    assert again == {"action": "skipped", "n_points": 2}


def test_scan_corpus_text_files(spark, tmp_dir):
    os.makedirs(os.path.join(tmp_dir, "d", "e"))
    _write(os.path.join(tmp_dir, "d", "one.txt"), "first\n\nline")
    _write(os.path.join(tmp_dir, "d", "e", "two.txt"), "second")
    got = sorted((os.path.basename(r.path), r.text) for r in scan_corpus(spark, tmp_dir, "text").collect())
    assert got == [("one.txt", "first\n\nline"), ("two.txt", "second")]


def test_generated_from_parquet_keeps_arrays(spark, tmp_dir):
    p = os.path.join(tmp_dir, "gen.parquet")
    spark.createDataFrame([("q", "a", None, ["x", "y"], float("nan")), ("q2", None, "g", None, 0.5)],
                          "question string, answer string, generated_answer string, "
                          "retrieved_contexts array<string>, faithfulness double").write.parquet(p)
    rows = sorted(load_generated(spark, p, fmt="parquet").collect(), key=lambda r: r.question)
    assert (rows[0].generated_answer, rows[0].retrieved_contexts, rows[0].faithfulness) == ("", ["x", "y"], None)
    assert (rows[1].answer, rows[1].retrieved_contexts, rows[1].faithfulness) == ("", [], 0.5)


def test_folder_to_collection_pipeline(spark, tmp_dir):
    from sparqa.operators.chunk import chunk_documents
    from sparqa.operators.embed import embed
    from sparqa.sources.corpus import drop_empty
    root = os.path.join(tmp_dir, "corpus")
    os.makedirs(os.path.join(root, "sub"))
    _write(os.path.join(root, "a.pdf"), "Alpha beta gamma.\n\nDelta epsilon.")
    _write(os.path.join(root, "sub", "b.pdf"), "   ")
    _write(os.path.join(root, "sub", "c.pdf"), "BROKEN")

    def decode(content):
        text = bytes(content).decode("utf-8")
        if text == "BROKEN":
            raise ValueError("cannot decode")
        return text

    files = scan_corpus(spark, root, "binary")
    extracted = files.select("doc_id", safe_extract(decode)(F.col("content")).alias("r")) \
                     .select("doc_id", F.col("r.value").alias("text"), F.col("r.error").alias("error"))
    good, errors = isolate_failures(extracted)
    docs = drop_empty(good).select("doc_id", "text")
    assert errors.count() == 1 and docs.count() == 1
    chunks = chunk_documents(docs, chunk_size=20)
    path = coll.scratch_path(spark, "folder")
    out = coll.index_corpus(spark, docs, path, dim=16, chunker=lambda d: chunk_documents(d, chunk_size=20),
                            embed_fn=lambda c: embed(c, "chunk"))
    assert out["n_points"] == chunks.count() == 2


def test_writers_do_not_touch_each_other(spark, tmp_dir):
    import pytest

    from sparqa.operators import collection as coll

    def pts(*ids):
        return spark.createDataFrame([(i, i, 0, "t", [1.0, 2.0]) for i in ids], "point_id long, doc_id long, pos int, text string, embedding array<double>")
    path = f"{tmp_dir}/c"
    ids = lambda: sorted(r.doc_id for r in coll.read_points(spark, path).collect())
    coll.create_collection(spark, path, 2)
    coll.append_points(pts(1, 2), path)
    coll.append_points(pts(10), path, "stream-a", 0)
    coll.append_points(pts(20), path, "stream-b", 0)
    coll.append_points(pts(20), path, "stream-b", 0)
    assert ids() == [1, 2, 10, 20]
    with pytest.raises(Exception, match="length 2"):
        coll.append_points(pts(30).withColumn("embedding", F.array(F.lit(1.0))), path)
    assert ids() == [1, 2, 10, 20]
    assert coll.create_collection(spark, path, 3, recreate_on_dimension_mismatch=True) == "recreated" and ids() == []
