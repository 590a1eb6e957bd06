import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparqa.operators.experiment import check_experiment, limit_rows
from sparqa.operators.profile import describe_numeric, describe_text, exact_quantiles, info
from sparqa.operators.repair import (diagnose_missing, duplicate_keys, merge_metrics, nan_counts, null_counts,
                                     repair)

SCHEMA = ("row_id long, question string, answer string, experiment string, generated_answer string, "
          "retrieved_contexts string, context_precision double, context_recall double, faithfulness double, "
          "answer_relevancy double")


def _scored(spark):
    rows = [(1, "q1", "a", "e", "ans", "['c']", 1.0, 0.5, 1.0, 0.2),
            (2, "q2", "a", "e", "", "[]", 0.0, None, 1.0, None),
            (3, "q3", "a", "e", " ", "nan", None, 0.1, float("nan"), 0.3)]
    return spark.createDataFrame(rows, SCHEMA)


def test_repair_overwrites_targets_only(spark):
    s = _scored(spark)

    def rescore(t):
        return t.select("row_id", F.lit(0.9).alias("context_precision"), F.lit(None).cast("double")
                        .alias("context_recall"), F.lit(0.7).alias("faithfulness"),
                        F.lit(0.6).alias("answer_relevancy"))

    out = {r.row_id: r for r in repair(s, rescore).collect()}
    assert (out[1].context_precision, out[1].context_recall) == (1.0, 0.5)  # untouched
    assert (out[2].context_precision, out[2].context_recall, out[2].answer_relevancy) == (0.9, None, 0.6)
    assert out[3].faithfulness == 0.7
    none = repair(s.where("row_id = 1"), rescore).collect()
    assert none[0].context_precision == 1.0


def test_nan_counts_and_null_counts(spark):
    s = _scored(spark)
    r = nan_counts(s).first()
    assert (r.total_rows, r.target_rows, r.missing_faithfulness) == (3, 2, 1)
    nc = {r.column: r.n_missing for r in null_counts(s).collect()}
    assert nc["faithfulness"] == 1 and nc["context_recall"] == 1 and nc["question"] == 0
    d = diagnose_missing(s).first()
    assert (d.n_missing, d.n_empty_contexts, d.n_blank_answers) == (1, 1, 1)


def test_merge_null_keys_and_left_rows(spark):
    main = spark.createDataFrame([("q", None, "e", None), ("q2", "a", "e", 0.5), ("q3", "a", "e", None)],
                                 "question string, answer string, experiment string, faithfulness double")
    src = spark.createDataFrame([("q", None, "e", 1.0), ("q2", "a", "e", 0.1)],
                                "question string, answer string, experiment string, faithfulness double")
    out = {r.question: r.faithfulness for r in merge_metrics(main, src, metrics=["faithfulness"]).collect()}
    assert out == {"q": 1.0, "q2": 0.5, "q3": None}
    dup = src.unionByName(src.limit(1))
    assert duplicate_keys(dup).count() == 1
    with pytest.raises(ValueError):
        merge_metrics(main, dup, metrics=["faithfulness"])


def test_exact_quantiles_match_linear_rule(spark):
    vals = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0, float("nan"), None]
    df = spark.createDataFrame([(v,) for v in vals], "x double").repartition(3)
    got = exact_quantiles(df, "x", [0.0, 0.25, 0.5, 0.75, 1.0])
    clean = [v for v in vals if v is not None and not math.isnan(v)]
    assert np.allclose(got, np.percentile(clean, [0, 25, 50, 75, 100]))
    d = describe_numeric(df).first()
    assert d["count"] == 8 and math.isclose(d.std, float(np.std(clean, ddof=1)))


def test_describe_text_tie_takes_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "t string")
    r = describe_text(df).first()
    assert (r["count"], r.unique, r.top, r.freq) == (4, 2, "a", 2)
    i = {r.column: (r.non_null, r.type) for r in info(df).collect()}
    assert i == {"t": (4, "string")}


def test_limits(spark):
    df = spark.range(10).withColumnRenamed("id", "row_id")
    ids = lambda d: sorted(r.row_id for r in d.collect())
    assert ids(limit_rows(df, None)) == list(range(10))
    assert ids(limit_rows(df, 0)) == []
    assert ids(limit_rows(df, 3)) == [0, 1, 2]
    assert ids(limit_rows(df, -3)) == list(range(7))
    assert ids(limit_rows(df, 50)) == list(range(10))
    assert ids(limit_rows(df, -50)) == []
    with pytest.raises(ValueError):
        check_experiment("nope")


def test_merge_keeps_left_row_count_on_driver_tables(spark):
    from sparqa.plans import fixtures as fx
    sf = "/root/testdata/sf0.01"
    main = fx.scored_results(spark, sf)
    merged = merge_metrics(main, fx.second_run(spark, sf), keys=["row_id", "experiment"])
    assert merged.count() == main.count()
    assert merged.where("context_recall IS NULL").count() <= main.where("context_recall IS NULL").count()


def test_describe_text_all_missing_column(spark):
    df = spark.createDataFrame([(None, "x"), (None, "x")], "a string, b string")
    got = {r.column: (r["count"], r.unique, r.top, r.freq) for r in describe_text(df).collect()}
    assert got == {"a": (0, 0, None, None), "b": (2, 1, "x", 2)}


def test_hot_null_key_merge_and_duplicates(spark):
    # a third of the rows share one (NULL) key on both sides of the merge
    n = 3000
    main = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id").cast("string")).alias("question"),
        F.lit("a").alias("answer"), F.lit("e").alias("experiment"),
        F.when(F.col("id") % 2 == 0, F.lit(None).cast("double")).otherwise(F.lit(0.5)).alias("faithfulness"))
    src = spark.range(n).where(F.col("id") % 3 != 0).select(
        F.col("id").cast("string").alias("question"), F.lit("a").alias("answer"), F.lit("e").alias("experiment"),
        F.lit(1.0).alias("faithfulness")).unionByName(
        spark.range(1).select(F.lit(None).cast("string").alias("question"), F.lit("a").alias("answer"),
                              F.lit("e").alias("experiment"), F.lit(2.0).alias("faithfulness")))
    out = merge_metrics(main, src, metrics=["faithfulness"], check=False)
    assert out.count() == n
    got = {r.k: r.c for r in out.groupBy(F.coalesce("faithfulness", F.lit(-1.0)).alias("k")).count()
           .withColumnRenamed("count", "c").collect()}
    # NULL-key rows missing a value take the single NULL-key source value (2.0)
    assert got[2.0] == sum(1 for i in range(n) if i % 3 == 0 and i % 2 == 0)
    assert got[1.0] == sum(1 for i in range(n) if i % 3 != 0 and i % 2 == 0)
    d = duplicate_keys(main).collect()
    assert len(d) == 1 and d[0].question is None and d[0].n == n // 3


@pytest.mark.parametrize("leaf, splitters", [(1, 2), (4096, 63)])
def test_limits_are_exact_with_null_and_repeated_ids(spark, monkeypatch, leaf, splitters):
    from sparqa.operators import experiment as X
    monkeypatch.setattr(X, "_LEAF_ROWS", leaf)
    monkeypatch.setattr(X, "_SPLITTERS", splitters)
    ids = [None, None, 1, 1, 2, 3] + [7] * 9 + list(range(10, 40, 3))
    df = spark.createDataFrame([(i, "x") for i in ids], "row_id long, text string").repartition(4).cache()
    got = lambda d: sorted((-1 if r.row_id is None else r.row_id) for r in d.collect())
    want = [-1 if i is None else i for i in ids]
    for n in (1, 2, 3, 8, 15, len(ids), 100):
        assert got(X.limit_rows(df, n)) == want[:n], n
    for n in (-1, -12, -len(ids), -100):
        assert got(X.limit_rows(df, n)) == want[:n], n
    assert got(X.limit_rows(df.limit(0), 3)) == [] == got(X.limit_rows(df.limit(0), -3))
    df.unpersist()
