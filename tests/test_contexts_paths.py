import os

import pytest
from pyspark.sql import functions as F

from sparqa.functions.contexts import literal_items, parse_contexts
from sparqa.sources.results import build_output_path, check_not_same, repaired_path

F1_CASES = [
    (None, []), ("  ", []), ("NaN", []), ("[]", []), ("['a', \"b'c\"]", ["a", "b'c"]), ("('a',)", ["a"]),
    ("[1, None]", ["1", "None"]), ("42", ["42"]), ("'x'", ["x"]), ("plain text", ["plain text"]),
    ("[nan]", ["[nan]"]), ("{'a':1}", ["{'a': 1}"]), ("['a\\x0cb', '\\xa0']", ["a\x0cb", "\xa0"]),
]


@pytest.mark.parametrize("value,expected", [c for c in F1_CASES if c[1]])
def test_literal_items(value, expected):
    assert literal_items(value) == expected


def test_json_cells_read_as_literals_do(spark):
    cells = ['["a"]', '["a", "b\\n\\"c"]', '["\\u0001"]', '["a", 1]', '["a", null]', '["\\/"]', '[ ]', '["x" "y"]']
    df = spark.createDataFrame([(i, v) for i, v in enumerate(cells)], "i int, v string")
    got = {r.i: r.c for r in df.select("i", parse_contexts(F.col("v")).alias("c")).collect()}
    assert [got[i] for i in range(len(cells))] == [literal_items(v) for v in cells]


def test_parse_contexts_udf(spark):
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(F1_CASES)], "i int, v string")
    got = {r.i: r.c for r in df.select("i", parse_contexts(F.col("v")).alias("c")).collect()}
    assert [got[i] for i in range(len(F1_CASES))] == [e for _, e in F1_CASES]


NAMES = ["results/rag.csv", "results/rag", "x.tar.gz", "a/.csv", "a/..b", "a.", "dir.d/file", ".hidden",
         "a/b.c/d.e", "..", "dir/", "rag_combined_results.csv"]


def test_output_path_matches_splitext(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "base string")
    got = {r.base: r.out for r in df.select("base", build_output_path(F.col("base"), F.lit("exp")).alias("out"))
           .collect()}
    for n in NAMES:
        stem, ext = os.path.splitext(n)
        assert got[n] == f"{stem}_exp{ext or '.csv'}", n


def test_repaired_path(spark):
    df = spark.createDataFrame([("r/a.csv", None), ("r/a.csv.csv", None), ("r/a", None), ("r/a.csv", "o.csv")],
                               "p string, o string")
    got = [r.x for r in df.select(repaired_path(F.col("p"), F.col("o")).alias("x")).collect()]
    assert got == ["r/a_nan_fixed.csv", "r/a_nan_fixed.csv_nan_fixed.csv", "r/a", "o.csv"]
    with pytest.raises(ValueError):
        check_not_same("r/a", "r/a/")


def test_parse_contexts_json_roundtrip(spark):
    from sparqa.functions.contexts import parse_contexts_json
    df = spark.createDataFrame([(["a", 'b"c', "d\ne"],), ([],), (None,)], "c array<string>")
    back = df.select(parse_contexts_json(F.to_json("c")).alias("x")).collect()
    assert [r.x for r in back] == [["a", 'b"c', "d\ne"], [], []]
