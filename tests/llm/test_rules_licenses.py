"""Order of the cascade, and the digest of known texts in the driver and in Spark."""

import random

from pyspark.sql import functions as F

from sparqa.llm import license, quality


def _rule(name):
    return quality.Rule(name, lambda d: F.lit(False))


def test_order_is_by_what_earlier_rules_leave():
    rules = [_rule("a"), _rule("b"), _rule("c")]
    # b rejects nothing that a has not rejected; c rejects few, but others
    seen = {"110": 50, "100": 10, "001": 5, "000": 35}
    cheap = dict.fromkeys("abc", 1.0)
    assert [r.name for r in quality.by_rejection_per_cost(rules, cheap, seen)] == ["a", "c", "b"]
    assert [r.name for r in quality.by_rejection_per_cost(rules, cheap | {"a": 100.0}, seen)] == ["b", "c", "a"]
    assert [r.name for r in quality.by_rejection_per_cost(rules, cheap, {})] == ["a", "b", "c"]


def test_a_planned_order_keeps_every_rule(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(i, " ".join(rng.choice(["word", "#", "WORD", "x" * 30]) for _ in range(60))) for i in range(200)], "doc_id long, text string")
    order = quality.plan_order(df, quality.CONTENT_RULES, sample_rows=100)
    assert sorted(r.name for r in order) == sorted(r.name for r in quality.CONTENT_RULES)
    assert sorted(r.name for r in quality.plan_order(df.limit(0), quality.CONTENT_RULES)) == sorted(r.name for r in quality.CONTENT_RULES)


def test_digests_agree_in_driver_and_spark(spark):
    texts = [t for _, t in (*license.KNOWN, *license.full_texts())] + ["", " \n.", "Copyright 2020 A\nlicence licence licence", "non commercial non commercial", "© Some One\nx"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", license.digest(F.col("text")).alias("d")).collect()
    assert {r.i: r.d for r in got} == {i: license.digest_of(t) for i, t in enumerate(texts)}


def test_adjacent_spellings_are_both_met(spark):
    df = spark.createDataFrame([("licence licence licence",), ("license license license",)], "text string")
    assert len({r.d for r in df.select(license.digest(F.col("text")).alias("d")).collect()}) == 1
