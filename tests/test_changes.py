"""Incremental index against a full rebuild, and the stream that replaces documents."""

import random

import pytest
from pyspark.sql import functions as F

from sparqa.operators import changes
from sparqa.operators import chunk as ch
from sparqa.operators import collection as coll
from sparqa.streaming.replacer import start_replacing_indexer

CHUNK = dict(chunker=lambda d: ch.chunk_documents(d, chunk_size=30))


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def _live(spark, path):
    return sorted((r.doc_id, r.pos, r.text) for r in changes.live_points(spark, path).collect())


def _rebuilt(spark, rows):
    return sorted(tuple(r) for r in ch.chunk_documents(_docs(spark, [(d, t) for d, t in rows if d is not None]), chunk_size=30).collect())


def test_changes_equal_a_full_rebuild(spark):
    rng = random.Random(4)
    path = coll.scratch_path(spark, "changes")
    text = lambda: ". ".join("w" * rng.randrange(1, 20) for _ in range(rng.randrange(0, 8)))
    rows = {i: text() for i in range(40)} | {40: None, 41: ""}
    for turn in range(4):
        if turn:
            before = dict(rows)
            for i in rng.sample(sorted(rows), 6):
                del rows[i]
            for i in rng.sample(sorted(rows), 6):
                rows[i] = text()
            rows |= {100 * turn + i: text() for i in range(5)}
            if turn == 3:
                rows |= {i: before[i] for i in list(before)[:3]}  # back again
        counts = changes.index_changes(spark, _docs(spark, list(rows.items()) + [(None, "no id")]), path, dim=16, **CHUNK)
        assert _live(spark, path) == _rebuilt(spark, list(rows.items()))
        if turn == 0:
            assert counts == {"new": 42, "changed": 0, "gone": 0}
        else:
            old = {i: before[i] or "" for i in before}
            new = {i: rows[i] or "" for i in rows}
            assert counts == {"new": len(new.keys() - old.keys()), "gone": len(old.keys() - new.keys()),
                              "changed": sum(new[i] != old[i] for i in new.keys() & old.keys())}
    points = coll.collection_count(spark, path)
    assert changes.index_changes(spark, _docs(spark, list(rows.items())), path, dim=16, **CHUNK) == {"new": 0, "changed": 0, "gone": 0}
    assert coll.collection_count(spark, path) == points
    assert changes.index_changes(spark, _docs(spark, []), path, dim=16, **CHUNK)["gone"] == len(rows)
    assert _live(spark, path) == []


def test_repeated_rows_of_a_document_count_once(spark):
    path = coll.scratch_path(spark, "changes")
    docs = spark.createDataFrame([(1, 1, "old"), (1, 2, "new"), (1, 2, "new"), (2, None, "b")], "doc_id long, v int, text string")
    assert changes.index_changes(spark, docs, path, dim=16, version_col="v", **CHUNK)["new"] == 2
    assert _live(spark, path) == [(1, 0, "new"), (2, 0, "b")]


def test_a_run_that_dies_leaves_the_collection_as_it_was(spark, monkeypatch):
    path = coll.scratch_path(spark, "changes")
    changes.index_changes(spark, _docs(spark, [(1, "one"), (2, "two")]), path, dim=16, **CHUNK)
    append = coll.append_points

    def die(*args):
        append(*args)
        raise RuntimeError("died after the points")
    with monkeypatch.context() as m:
        m.setattr(coll, "append_points", die)
        with pytest.raises(RuntimeError):
            changes.index_changes(spark, _docs(spark, [(1, "ONE"), (3, "three")]), path, dim=16, **CHUNK)
    assert _live(spark, path) == [(1, 0, "one"), (2, 0, "two")]
    changes.index_changes(spark, _docs(spark, [(1, "uno"), (3, "three")]), path, dim=16, **CHUNK)
    assert _live(spark, path) == [(1, 0, "uno"), (3, 0, "three")]


def test_other_writers_points_stay(spark):
    path = coll.scratch_path(spark, "changes")
    changes.index_changes(spark, _docs(spark, [(1, "one")]), path, dim=2, chunker=CHUNK["chunker"],
                          embed_fn=lambda c: c.withColumn("embedding", F.array(F.lit(0.0), F.lit(1.0))))
    extra = spark.createDataFrame([(9, 0, "nine", [1.0, 0.0])], "doc_id long, pos int, chunk string, embedding array<double>")
    coll.append_points(coll.to_points(extra), path)
    assert [t for *_, t in _live(spark, path)] == ["one", "nine"]


def test_recreated_collection_keeps_its_points_until_its_metadata_is_written(spark, monkeypatch):
    path = coll.scratch_path(spark, "recreate")
    coll.create_collection(spark, path, 2)
    extra = spark.createDataFrame([(9, 0, "nine", [1.0, 0.0])], "doc_id long, pos int, chunk string, embedding array<double>")
    coll.append_points(coll.to_points(extra), path)

    def die(*_):
        raise RuntimeError("died before the metadata")
    with monkeypatch.context() as m:
        m.setattr(coll, "_write_meta", die)
        with pytest.raises(RuntimeError):
            coll.create_collection(spark, path, 3, recreate_on_dimension_mismatch=True)
    assert coll.collection_dimension(spark, path) == 2 and coll.collection_count(spark, path) == 1
    assert coll.create_collection(spark, path, 3, recreate_on_dimension_mismatch=True) == "recreated"
    assert coll.collection_dimension(spark, path) == 3 and coll.collection_count(spark, path) == 0


def _write(spark, folder, name, rows):
    spark.createDataFrame(rows, "doc_id long, version long, text string").coalesce(1).write.parquet(f"{folder}/{name}")


def test_stream_replaces_documents(spark, tmp_dir):
    source, path, ckpt = f"{tmp_dir}/in", coll.scratch_path(spark, "replace"), f"{tmp_dir}/ckpt"

    def drain():
        q = start_replacing_indexer(spark, source, path, dim=16, chunk_size=30, checkpoint=ckpt)
        q.awaitTermination()
    _write(spark, source, "a", [(1, 1, "one. " * 20), (2, 1, "two"), (3, 1, "three"), (3, 1, "three"), (None, 1, "no id"), (4, None, "four")])
    drain()
    assert _live(spark, path) == _rebuilt(spark, [(1, "one. " * 20), (2, "two"), (3, "three"), (4, "four")])
    # second version, repeated, late, gone, two versions in one batch, and a version that says the same again
    _write(spark, source, "b", [(1, 2, "uno"), (2, 1, "two"), (3, 0, "late three"), (4, 2, None), (5, 1, "five"), (5, 3, "cinco"), (5, 2, "fünf"), (2, 4, "two")])
    drain()
    assert _live(spark, path) == _rebuilt(spark, [(1, "uno"), (2, "two"), (3, "three"), (5, "cinco")])
    _write(spark, source, "c", [(4, 3, "four again"), (2, 3, "late two"), (5, 3, "aaa")])
    drain()
    got = dict((d, t) for d, _, t in _live(spark, path))
    assert got[4] == "four again" and got[2] == "two" and got[5] in ("cinco", "aaa") and len(got) == 5
    drain()
    assert dict((d, t) for d, _, t in _live(spark, path)) == got


def test_state_worker_holds_few_texts_and_settings_come_back(spark, tmp_dir, monkeypatch):
    from sparqa.streaming import replacer
    seen = {}

    def commit(path, chunker, embedder, *rows):
        run = real(path, chunker, embedder, *rows)

        def watched(batch, batch_id):
            seen["state"] = batch.sparkSession.conf.get(replacer.ARROW_ROWS)
            run(batch, batch_id)
        return watched
    real, write = replacer._commit, changes.write_batch
    monkeypatch.setattr(replacer, "_commit", commit)
    monkeypatch.setattr(changes, "write_batch", lambda s, *a: (seen.update(chunks=s.conf.get(replacer.ARROW_ROWS)), write(s, *a)))
    before = spark.conf.get(replacer.ARROW_ROWS)
    path = coll.scratch_path(spark, "replace")
    _write(spark, f"{tmp_dir}/in2", "a", [(i, 1, f"text {i}") for i in range(600)])
    start_replacing_indexer(spark, f"{tmp_dir}/in2", path, dim=16, checkpoint=f"{tmp_dir}/ckpt2").awaitTermination()
    assert seen == {"state": str(replacer.ROWS_AT_ONCE), "chunks": before} and spark.conf.get(replacer.ARROW_ROWS) == before
    assert len(_live(spark, path)) == 600
