"""Answers written once (G8, G10): a store of model answers keyed by a digest of model and prompt.

``<path>/answers/commit=<c>/`` holds (digest, model, answer). Only prompts that are not in the store go to their model, each distinct prompt
once; they are written in commits of at most ``commit_prompts`` before anything reads an answer. A run that dies keeps what it
committed: the next one asks for the rest. Scoring stages read the store, so they never call a model again.

A task that Spark runs again inside one commit asks its prompts again; smaller commits bound that.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from sparqa.operators import answer as ans
from sparqa.operators.collection import scratch_path

COMMIT_PROMPTS = 100_000
SCHEMA = "digest string, model string, answer string"


def prompt_digest(model: Column, prompt: Column) -> Column:
    """The key of an answer; a missing prompt is an empty one."""
    return F.sha2(F.concat(F.coalesce(model, F.lit("")), F.lit("\x1f"), F.coalesce(prompt, F.lit(""))), 256)


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """(digest, model, answer), one row per digest; no rows where nothing was stored yet."""
    try:
        df = spark.read.schema(SCHEMA).parquet(f"{path.rstrip('/')}/answers")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)
    # two runs at a time may store one prompt twice: the smallest answer counts, for all readers
    return df.groupBy("digest").agg(F.min("model").alias("model"), F.min("answer").alias("answer"))


def store_answers(df: DataFrame, path: str, responders: dict[str, ans.Responder] | None = None, *,
                  factories: dict[str, Callable[[], ans.Responder]] | None = None, model_col: str = "generator_model",
                  prompt_col: str = "prompt", commit_prompts: int = COMMIT_PROMPTS) -> int:
    """Ask the models for the prompts of ``df`` that the store lacks; returns how many these were."""
    spark = df.sparkSession
    asked = df.select(F.col(model_col).alias("generator_model"), F.col(prompt_col).alias("prompt"))
    asked = asked.withColumn("digest", prompt_digest(F.col("generator_model"), F.col("prompt"))).dropDuplicates(["digest"])
    todo_path = scratch_path(spark, "prompts")  # what is to be asked is fixed before the first call
    asked.join(read_answers(spark, path).select("digest"), "digest", "left_anti").write.parquet(todo_path)
    todo = spark.read.parquet(todo_path)
    n = todo.count()
    commits = -(-n // commit_prompts)
    for i in range(commits):
        part = todo.where(F.pmod(F.xxhash64("digest"), F.lit(commits)) == i)
        out = ans.answer_by_model(part, responders or {}, out_col="answer", factories=factories)
        out.select("digest", F.col("generator_model").alias("model"), "answer").write.parquet(f"{path.rstrip('/')}/answers/commit={uuid.uuid4().hex}")
    return n


def answers_once(df: DataFrame, path: str, responders: dict[str, ans.Responder] | None = None, *,
                 factories: dict[str, Callable[[], ans.Responder]] | None = None, model_col: str = "generator_model",
                 prompt_col: str = "prompt", out_col: str = "generated_answer", commit_prompts: int = COMMIT_PROMPTS) -> DataFrame:
    """``df`` with its answers, all of which are in the store when this returns. ``df`` is read twice."""
    store_answers(df, path, responders, factories=factories, model_col=model_col, prompt_col=prompt_col, commit_prompts=commit_prompts)
    known = read_answers(df.sparkSession, path).select(F.col("digest").alias("_digest"), F.col("answer").alias(out_col))
    keyed = df.drop(out_col).withColumn("_digest", prompt_digest(F.col(model_col), F.col(prompt_col)))
    return keyed.join(known, "_digest", "left").drop("_digest")
