"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparqa.session import checkpoint_dir

#: A word is a run of other characters than these six.
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """The words of ``text`` in order; NULL has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def buckets_for(rows: int) -> int:
    """Number of sub-buckets that balances rows per bucket against buckets per group."""
    return max(1, int(rows ** 0.5))


def with_start(df: DataFrame, group: list[str], order: list[str], size: str, start: str, n_buckets: int) -> DataFrame:
    """Add ``start``: the sum of ``size`` over the rows before this one in its group.

    Rows of a group are ordered by (hash bucket of ``order``, ``order``). Sums run inside a bucket and
    over bucket totals, so a group of any size is spread over many tasks: no task holds a whole group.
    ``df`` is read twice and should be stored; ``group`` columns hold no NULL.
    """
    df = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(n_buckets)).cast("int"))
    inside = Window.partitionBy(*group, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = (df.groupBy(*group, "_b").agg(F.sum(size).alias("_t"))
              .withColumn("_o", F.coalesce(F.sum("_t").over(before), F.lit(0))).drop("_t"))
    return (df.withColumn("_i", F.coalesce(F.sum(size).over(inside), F.lit(0)))
            .join(totals.hint("merge"), [*group, "_b"])  # the rows are dealt and sorted by these already
            .withColumn(start, (F.col("_i") + F.col("_o")).cast("long")).drop("_i", "_o", "_b"))
