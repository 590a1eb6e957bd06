"""Connected components as joins: minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparqa.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``edges`` (a, b): comp is the least node reachable.

    Each step takes the least label among neighbours (pre-aggregated before the shuffle, so a hub of any degree
    is cheap) and then the label of that label; labels are written to the shared folder between steps.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b")
    both = stored(both.distinct(), "cc-edges")
    label = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_m"))
                   .select("node", F.least("node", "_m").alias("comp")), "cc-labels")
    while True:
        near = (both.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("_m")))
        step = label.join(near, "node").select("node", "comp", F.least("comp", "_m").alias("_c"))
        jump = label.select(F.col("node").alias("_c"), F.col("comp").alias("_j"))
        new = stored(step.join(jump, "_c").select("node", F.col("comp").alias("_old"), F.least("_c", "_j").alias("comp")), "cc-labels")
        moved = new.filter("comp <> _old").limit(1).count()
        label = new.select("node", "comp")
        if not moved:
            return label
