import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sparqa.operators import answer as ans
from sparqa.operators.judge import attach_metrics, judge_means, native_judge, run_judge, verdict_table
from sparqa.operators.tokenmatch import bertscore, match_scores


def test_responder_failure_is_empty_answer_only_for_that_row(spark):
    def responder(prompts):
        out = []
        for p in prompts:
            if "boom" in p:
                raise RuntimeError("model down")
            out.append("  answer to " + p[-3:] + "  ")
        return out

    df = spark.createDataFrame([(1, "q one"), (2, "boom q"), (3, "q three")], "qid int, prompt string")
    got = {r.qid: r.generated_answer for r in ans.generate_answers(df, responder=responder).collect()}
    assert got == {1: "answer to one", 2: "", 3: "answer to ree"}


def test_template_substitution_is_one_pass(spark):
    df = spark.createDataFrame([("Q?", "ctx with {question} inside")], "q string, c string")
    out = df.select(ans.fill_template("C={context} Q={question}", context=F.col("c"), question=F.col("q"))
                    .alias("p")).first().p
    assert out == "C=ctx with {question} inside Q=Q?"
    plain = df.select(ans.build_prompt("q", "c", False, plain_template="only {question}").alias("p")).first().p
    assert plain == "only Q?"


def test_build_context_cut_and_join(spark):
    df = spark.createDataFrame([(["a" * 900, "b"],), ([],), (None,)], "c array<string>")
    got = [r.x for r in df.select(ans.build_context("c").alias("x")).collect()]
    assert got == ["a" * 800 + " b", "", ""]


def test_plain_answering_has_empty_contexts(spark):
    q = spark.createDataFrame([(1, "what?")], "qid int, question string")
    r = ans.answer_questions(q, None, use_rag=False).first()
    assert r.retrieved_contexts == [] and r.generated_answer == ""


def test_token_match_identity_and_empty():
    assert match_scores(["a", "b", "a"], ["a", "b", "a"]) == (1.0, 1.0, 1.0) or all(
        math.isclose(x, 1.0) for x in match_scores(["a", "b", "a"], ["a", "b", "a"]))
    assert match_scores([], ["a"]) == (0.0, 0.0, 0.0)


def test_bertscore_identity_in_spark(spark):
    df = spark.createDataFrame([("The cat sat.", "the CAT sat"), ("", "x")], "generated_answer string, answer string")
    rows = bertscore(df).collect()
    assert all(math.isclose(v, 1.0) for v in (rows[0].bertscore_precision, rows[0].bertscore_recall,
                                              rows[0].bertscore_f1))
    assert (rows[1].bertscore_precision, rows[1].bertscore_f1) == (0.0, 0.0)


def _judge_row(spark, question, answer, reference, contexts, use_rag=True):
    df = spark.createDataFrame([(1, question, answer, reference, contexts)],
                               "row_id int, question string, generated_answer string, answer string, "
                               "retrieved_contexts array<string>")
    return native_judge(df, use_rag=use_rag).first()


def test_context_precision_formula(spark):
    # contexts: irrelevant, relevant, relevant -> (0 + 1/2 + 2/3) / 2
    r = _judge_row(spark, "q", "alpha beta.", "alpha beta. gamma delta.",
                   ["zzz", "alpha beta", "gamma delta"])
    assert math.isclose(r.context_precision, (0.5 + 2 / 3) / 2)
    assert math.isclose(r.context_recall, 1.0)
    assert math.isclose(r.faithfulness, 1.0)


def test_missing_statements_and_evasive_answer(spark):
    r = _judge_row(spark, "q", "   ", "...", ["a"])
    assert r.context_recall is None and r.faithfulness is None
    assert r.answer_relevancy == 0.0 and r.context_precision == 0.0
    plain = _judge_row(spark, "q", "some words here", "ref", [], use_rag=False)
    assert plain.context_precision is None and plain.answer_relevancy is not None


def test_verdict_table_long_form(spark):
    df = spark.createDataFrame([(1, "q", "alpha. omega", "alpha", ["alpha beta"])],
                               "row_id int, question string, generated_answer string, answer string, "
                               "retrieved_contexts array<string>")
    v = sorted((r.metric, r.idx, r.verdict) for r in verdict_table(df, ["row_id"]).collect())
    assert v == [("context_precision", 0, 1), ("context_recall", 0, 1), ("faithfulness", 0, 1),
                 ("faithfulness", 1, 0)]


def test_pluggable_judge_failures_become_missing(spark):
    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        if (pdf["response"] == "bad").any():
            raise ValueError("judge timeout")
        return pd.DataFrame({"faithfulness": np.ones(len(pdf)), "answer_relevancy": np.full(len(pdf), 0.5)})

    df = spark.createDataFrame([(1, "q", "ok", "r", ["c"]), (2, "q", "bad", "r", ["c"])],
                               "row_id int, question string, generated_answer string, answer string, "
                               "retrieved_contexts array<string>")
    out = {r.row_id: r for r in run_judge(df, ["row_id"], judge).collect()}
    assert out[1].faithfulness == 1.0 and out[1].context_precision is None
    assert out[2].faithfulness is None and out[2].answer_relevancy is None
    attached = attach_metrics(df.withColumn("faithfulness", F.lit(9.0)), run_judge(df, ["row_id"], judge),
                              ["row_id"]).orderBy("row_id").collect()
    assert [r.faithfulness for r in attached] == [1.0, None]


def test_judge_means_count_missing_as_zero(spark):
    df = spark.createDataFrame([(1.0, None), (float("nan"), 0.5), (0.0, 1.0)], "faithfulness double, context_recall double")
    r = judge_means(df).first()
    assert math.isclose(r.faithfulness_mean, 1 / 3) and math.isclose(r.context_recall_mean, 0.5)


def test_run_stages_actions_and_context_guard(spark):
    import pytest

    from sparqa.operators.experiment import check_action, run_stages
    saved = spark.createDataFrame([(1, "q", "alpha", "alpha beta", ["alpha"])],
                                  "row_id long, question string, answer string, generated_answer string, "
                                  "retrieved_contexts array<string>")
    out = run_stages("bert", load=lambda: saved, experiment="llama_with_rag").first()
    assert out.experiment == "llama_with_rag" and math.isclose(out.bertscore_recall, 1.0)
    assert "context_precision" not in run_stages("bert", load=lambda: saved).columns
    r = run_stages("ragas", load=lambda: saved, experiment="llama_with_rag").first()
    assert r.context_recall == 1.0 and "bertscore_f1" not in r.asDict()
    with pytest.raises(ValueError):
        run_stages("ragas", load=lambda: saved.drop("retrieved_contexts"), experiment="llama_with_rag")
    with pytest.raises(ValueError):
        check_action("everything")


def test_generate_grid_with_responder(spark):
    from sparqa.operators.experiment import generate_grid
    qa = spark.createDataFrame([(7, "what is alpha", "alpha")], "row_id long, question string, answer string")
    pts = spark.createDataFrame([(1, 0, "alpha beta", [1.0, 0.0])],
                                "doc_id long, pos int, text string, embedding array<double>")

    def emb(texts):
        return np.array([[1.0, 0.0] for _ in texts])

    g = generate_grid(qa, pts, embedder=emb, responder=lambda ps: ["ctx" if "alpha beta" in p else "none"
                                                                  for p in ps]).collect()
    got = {r.experiment: (r.generated_answer, r.retrieved_contexts) for r in g}
    assert got["llama_with_rag"] == ("ctx", ["alpha beta"])
    assert got["gpt_oss_without_rag"] == ("none", [])
    calls = []

    def model(name):
        def respond(prompts):
            calls.append((name, len(prompts)))
            if name == "gpt_oss" and any("alpha beta" in p for p in prompts):
                raise RuntimeError("down")
            return [f"{name}:{'rag' if 'alpha beta' in p else 'plain'}" for p in prompts]
        return respond

    g = generate_grid(qa, pts, embedder=emb, responders={"llama": model("llama"), "gpt_oss": model("gpt_oss")})
    got = {r.experiment: r.generated_answer for r in g.collect()}
    assert got == {"llama_with_rag": "llama:rag", "llama_without_rag": "llama:plain",
                   "gpt_oss_with_rag": "", "gpt_oss_without_rag": "gpt_oss:plain"}


def test_native_and_python_hash_vectors_agree(spark):
    from sparqa.functions.hashvec import text_vector
    from sparqa.operators.embed import embedding_udf, hash_embedder
    texts = ["Hello, wörld 12x", "", None, "Élan vital ÉLAN", "a.b.c"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", text_vector("t").alias("a"), embedding_udf()(F.col("t")).alias("b")).orderBy("i").collect()
    for r in rows:
        assert list(r.a) == list(r.b)
    assert np.array_equal(np.array([list(r.b) for r in rows]), hash_embedder(["" if t is None else t for t in texts]))


def test_factories_build_the_model_once_per_task(spark):
    from sparqa.operators.embed import embed

    def make_embedder():
        state = {"built": True}

        def model(texts):
            assert state["built"]
            return np.array([[float(len(t)), 1.0] for t in texts])
        return model

    df = spark.createDataFrame([(i, "x" * i) for i in range(50)], "i int, t string").repartition(3)
    got = {r.i: list(r.e) for r in embed(df, "t", "e", factory=make_embedder).collect()}
    assert got[7] == [7.0, 1.0] and len(got) == 50
    ans_df = spark.createDataFrame([("a",), ("boom",)], "prompt string")

    def make_responder():
        def respond(ps):
            if any("boom" in p for p in ps):
                raise RuntimeError("down")
            return [p.upper() for p in ps]
        return respond

    out = sorted(r.a for r in ans_df.select(ans.responder_udf(factory=make_responder)(F.col("prompt")).alias("a")).collect())
    assert out == ["", "A"]


def test_verdicts_of_a_row_are_linear_and_keep_missing_contexts(spark):
    from sparqa.operators.judge import row_verdicts, with_verdicts
    assert row_verdicts(["a b", "", None], ["a c", "", "d e"], []) == ([1, 1, None], [None] * 3, [])
    assert row_verdicts([None], [], ["a"]) == ([0], [], [None])
    n = 20_000  # before, each statement was compared with a set of all the contexts' tokens made anew: 400 million entries
    words = [f"w{i}" for i in range(n)]
    cp, cr, f = row_verdicts([" ".join(words)], [*words, "x"], ["w1 x y"])
    assert cp == [1] and cr == [1] * n + [0] and f == [0]
    df = spark.createDataFrame([(["A b. c", "zz"], "a b. Q r. c? !", "c; zz. x y"), (None, None, None), (["k", None], "k. m", "k")],
                               "retrieved_contexts array<string>, answer string, generated_answer string")
    got = [(r._v_cp, r._v_cr, r._v_f) for r in with_verdicts(df).collect()]
    assert got == [([1, 0], [1, 0, 1], [1, 0]), ([], [], []), ([1, None], [None, None], [None])]
