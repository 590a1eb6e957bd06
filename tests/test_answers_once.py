"""Answers written once, and stages that go on where a run stopped."""

import os

import pytest
from pyspark.sql import functions as F

from sparqa.operators import answerstore as store
from sparqa.operators import experiment as ex
from sparqa.operators import staged
from sparqa.operators.collection import scratch_path


def _counting(folder, fail_on=None):
    """A responder that leaves a line in a file of its own for each prompt it is asked."""
    def respond(prompts):
        with open(os.path.join(folder, f"{os.getpid()}.log"), "a") as f:
            for p in prompts:
                if fail_on and fail_on in p and not os.path.exists(os.path.join(folder, "mended")):
                    os._exit(1)  # the worker dies, not only the call
                f.write(p.replace("\n", " ") + "\n")
        return [p.upper() for p in prompts]
    return respond


def _asked(folder):
    out = []
    for f in os.listdir(folder):
        if f.endswith(".log"):
            with open(os.path.join(folder, f)) as g:
                out += g.read().splitlines()
    return sorted(out)


def _rows(spark):
    rows = [(i, "m1" if i % 2 else "m2", f"prompt {i % 5}") for i in range(40)] + [(100, "m1", None), (101, "m1", "")]
    return spark.createDataFrame(rows, "row_id long, generator_model string, prompt string")


def test_each_distinct_prompt_is_asked_once(spark, tmp_dir):
    path = scratch_path(spark, "answers")
    both = {m: _counting(tmp_dir) for m in ("m1", "m2")}
    first = store.answers_once(_rows(spark), path, both)
    assert {(r.row_id, r.generated_answer) for r in first.collect()} == {(i, f"PROMPT {i % 5}") for i in range(40)} | {(100, ""), (101, "")}
    assert _asked(tmp_dir) == sorted([f"prompt {i}" for i in range(5)] * 2 + [""])
    more = _rows(spark).unionByName(spark.createDataFrame([(200, "m1", "new")], _rows(spark).schema))
    assert store.store_answers(more, path, both) == 1
    assert store.store_answers(more, path, {}) == 0  # nothing left to ask: no responder is needed
    assert _asked(tmp_dir).count("new") == 1 and len(_asked(tmp_dir)) == 12


def test_a_restart_asks_only_for_the_rest(spark, tmp_dir):
    path = scratch_path(spark, "answers")
    rows = spark.createDataFrame([(i, "m", f"p{i:03}") for i in range(60)], "row_id long, generator_model string, prompt string").coalesce(1)
    with pytest.raises(Exception, match="(?i)worker|exit|crash"):
        store.answers_once(rows, path, {"m": _counting(tmp_dir, "p031")}, commit_prompts=10)
    kept = store.read_answers(spark, path).count()
    open(os.path.join(tmp_dir, "mended"), "w").close()
    out = store.answers_once(rows, path, {"m": _counting(tmp_dir, "p031")}, commit_prompts=10)
    assert sorted(r.generated_answer for r in out.collect()) == [f"P{i:03}" for i in range(60)]
    asked = _asked(tmp_dir)
    stored_first = {r.answer.lower() for r in store.read_answers(spark, path).collect()}
    assert len(stored_first) == 60 and kept < 60
    # what was committed before the worker died is not asked again; the commit it died in is
    assert len(asked) - len(set(asked)) <= 10 * 4


def test_factories_are_built_once_a_task(spark, tmp_dir):
    def factory():
        with open(os.path.join(tmp_dir, f"made-{os.getpid()}-{os.urandom(4).hex()}"), "w"):
            pass
        return lambda prompts: ["x" + p for p in prompts]
    rows = _rows(spark).coalesce(1).where("prompt <> ''")
    out = ex.ans.answer_by_model(rows, {}, factories={"m1": factory, "m2": factory})
    assert all(r.generated_answer == "x" + r.prompt for r in out.collect())
    assert len([f for f in os.listdir(tmp_dir) if f.startswith("made-")]) == 2


def _qa(spark):
    return spark.createDataFrame([(i, f"question {i % 4}?", f"answer {i}. It is so.") for i in range(12)], "row_id long, question string, answer string")


def test_stages_resume(spark, tmp_dir):
    path = scratch_path(spark, "run")
    models = {m: _counting(tmp_dir) for m in ("llama", "gpt_oss")}
    names = ["llama_without_rag", "gpt_oss_without_rag"]
    for e in names:
        _, ran = ex.run_stages_saved("bert", path, _qa(spark), experiment=e, responders=models)
        assert ran == [("generate", e), ("bert", e)]
    assert len(_asked(tmp_dir)) == 8
    for e in names:  # as after a run that died before it judged
        out, ran = ex.run_stages_saved("all", path, _qa(spark), experiment=e, responders=models)
        assert ran == [("ragas", e)]
        whole = ex.run_stages("all", generate=lambda e=e: ex.generate_grid(_qa(spark), None, e, responders={m: (lambda ps: [p.upper() for p in ps]) for m in models}))
        cols = ["row_id", "experiment", "generated_answer", "bertscore_f1", "answer_relevancy"]
        assert sorted(map(tuple, out.select(cols).collect())) == sorted(map(tuple, whole.select(cols).collect()))
        assert ex.run_stages_saved("all", path, _qa(spark), experiment=e, responders=models)[1] == []
    assert len(_asked(tmp_dir)) == 8
    # other data or configuration is other work
    assert ex.run_stages_saved("generate", path, _qa(spark).limit(6), experiment=names[0], responders=models)[1] == [("generate", names[0])]
    assert ex.run_stages_saved("generate", path, _qa(spark), experiment=names[0], responders=models, config={"model": 2})[1] == [("generate", names[0])]


def test_rows_without_a_manifest_are_not_read(spark, monkeypatch):
    path = scratch_path(spark, "run")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "experiment string, x int")

    def stop(*_):
        raise RuntimeError("died between rows and manifest")
    with monkeypatch.context() as m:
        m.setattr(staged, "_commit", stop)
        with pytest.raises(RuntimeError):
            staged.run_resumable(spark, path, [("make", lambda todo: df)], ["a", "b"], df, {})
    out, ran = staged.run_resumable(spark, path, [("make", lambda todo: df.where(F.col("experiment").isin(todo)))], ["a", "b"], df, {})
    assert ran == [("make", "a"), ("make", "b")] and out.count() == 2
    out, ran = staged.run_resumable(spark, path, [("make", None), ("more", lambda d: d.withColumn("y", F.col("x") + 1))], ["b"], df, {})
    assert ran == [("more", "b")] and [tuple(r) for r in out.select("experiment", "x", "y").collect()] == [("b", 2, 3)]


def test_fingerprint_sees_content_not_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "i int, t string")
    assert staged.fingerprint(a) == staged.fingerprint(a.orderBy(F.desc("i")).repartition(3))
    assert staged.fingerprint(a) != staged.fingerprint(a.unionByName(a))
    assert staged.fingerprint(a) != staged.fingerprint(a.withColumn("t", F.coalesce("t", F.lit(""))))
