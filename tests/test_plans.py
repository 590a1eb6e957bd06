"""Plan tests: registered queries keep to scale-safe physical operators."""
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
HAZARDS = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"]
REPRESENTATIVE = ["ask", "knn_cosine", "retrieve_topk", "experiment_stages", "merge_metrics", "describe_text",
                  "judge_verdicts", "chunk_documents", "bertscore", "limit_rows", "skip_failed_docs",
                  "union_results", "repair_overwrite", "question_type"]


def _plan(spark, name):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return E.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize("name", REPRESENTATIVE)
def test_no_hazards(spark, name):
    plan = _plan(spark, name)
    assert not [h for h in HAZARDS if h in plan]


def test_native_operators_stay_in_the_jvm(spark):
    for name in ("chunk_documents", "merge_metrics", "limit_rows", "question_type", "skip_failed_docs"):
        plan = _plan(spark, name)
        assert "Python" not in plan and "MapInPandas" not in plan, name


def test_retrieval_forces_no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(spark, "retrieve_topk")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "WindowGroupLimit" in plan and "Broadcast" not in plan  # only measured sizes may choose one


@pytest.mark.parametrize("name", ["union_results", "retrieval_quality", "rag_delta", "experiment_stages"])
def test_retrieval_runs_once_per_query(spark, name):
    # the kNN grid appears once (no branch recomputes the retrieval pipeline)
    plan = E.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapCoGroupsInPandas") <= 1


def test_chunker_expression_is_not_duplicated(spark):
    plan = E.queries()["chunk_documents"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 4  # one per split level
