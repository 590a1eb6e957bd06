"""Sharding by a k-d tree over row metadata (native DataFrame expressions only).

A node that stands for k shards is cut along its widest metadata dimension at the weighted quantile
floor(k/2)/k, so that each leaf holds the target bytes (all bytes divided by the shard count). Medians
are found for all nodes of a level at once by histograms: every pass narrows a node's range to the bin
that holds the quantile, and Spark aggregates the bins. The driver sees a few numbers per node, that is
per shard, never per row.

A coordinate is a 62-bit integer: 40 bits of the scaled value, then 22 bits of a row hash, so a value that
a third of all rows share can still be cut anywhere. Rows alike in everything are counted and numbered first, and the
number is part of the hash: a row repeated in a third of the table is cut like any other rows.

Groups of equal texts are not kept together: the law is near-equal bytes, and a group may hold more than a shard.

Edge cases: a NULL dimension value is placed lowest; a NULL text has no bytes and checksum 0; with fewer rows than shards
some shards are empty; an empty table gives an empty table.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparqa.llm.common import buckets_for, stored, with_start

VALUE_BITS, TIE_BITS = 40, 22
BINS = 1024
#: A cut may miss its quantile by this share of a shard's target bytes.
TOLERANCE = 0.002
ROW_BYTES = 16
#: Equal rows numbered by one row of a task, and rows a task numbers in all.
NUMBERS = 4096
TASK_ROWS = 500_000


def _scaled(df: DataFrame, dims: dict[str, Column], tie: Column) -> DataFrame:
    """Add ``_k0, _k1, ...``: each dimension as a 62-bit coordinate."""
    df = df.withColumns({f"_v{i}": c.cast("double") for i, c in enumerate(dims.values())})
    stats = df.agg(*(f(f"_v{i}") for i in range(len(dims)) for f in (F.min, F.max))).first()
    top = float(2 ** VALUE_BITS - 1)
    tied = F.pmod(tie, F.lit(2 ** TIE_BITS))
    for i in range(len(dims)):
        lo, hi = stats[2 * i], stats[2 * i + 1]
        unit = F.lit(0.0) if lo is None or hi <= lo else (F.col(f"_v{i}") - F.lit(lo)) / F.lit(hi - lo)
        value = F.floor(F.coalesce(unit, F.lit(0.0)) * F.lit(top)).cast("long")
        df = df.withColumn(f"_k{i}", F.shiftleft(value, TIE_BITS) + tied)
    return df.drop(*(f"_v{i}" for i in range(len(dims))))


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with ``name``: 0, 1, ... over the rows that are alike in all columns.

    Equal rows become one with a count before they are shuffled; they are made again by many tasks.
    """
    counts = stored(df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_c")), "kd-counts")
    total = counts.agg(F.sum("_c")).first()[0] or 0
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_c") - 1) / NUMBERS).cast("long")))
    dealt = counts.withColumn("_chunk", chunk).repartition(max(1, -(-total // TASK_ROWS)), F.xxhash64(*df.columns, "_chunk"))
    first = F.col("_chunk") * NUMBERS
    return dealt.withColumn(name, F.explode(F.sequence(first, F.least(first + NUMBERS, F.col("_c")) - 1))).drop("_c", "_chunk")


def _pick(n_dims: int, dim: Column) -> Column:
    out = F.col("_k0")
    for i in range(1, n_dims):
        out = F.when(dim == i, F.col(f"_k{i}")).otherwise(out)
    return out


def _rows(spark, rows: list[tuple], schema: str) -> DataFrame:
    """A per-node table: at most one row per shard, hence small enough to broadcast."""
    names = [c.split()[0] for c in schema.split(", ")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    kind = ", ".join(c.replace(" ", ": ") for c in schema.split(", "))
    return F.broadcast(spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{kind}>>"))))


def _quantiles(df: DataFrame, n_dims: int, nodes: dict[int, tuple[int, int, int, float, float]]) -> dict[int, int]:
    """For node -> (dim, lowest, highest coordinate, wanted weight, tolerance): the coordinate below which
    about the wanted weight lies."""
    spark = df.sparkSession
    cuts: dict[int, int] = {}
    todo = {n: (d, lo, hi, want, tol, 0.0) for n, (d, lo, hi, want, tol) in nodes.items()}
    while todo:
        spec = _rows(spark, [(n, d, lo, hi, max(1, (hi - lo) // BINS + 1), base, float(want))
                             for n, (d, lo, hi, want, _, base) in todo.items()],
                     "_node int, _dim int, _lo long, _hi long, _step long, _base double, _want double")
        at = df.join(spec, "_node").withColumn("_key", _pick(n_dims, F.col("_dim"))).filter("_key between _lo and _hi")
        at = at.withColumn("_bin", F.floor((F.col("_key") - F.col("_lo")) / F.col("_step")).cast("int"))
        bins = at.groupBy("_node", "_bin", "_base", "_want").agg(
            F.sum("_w").cast("double").alias("w"), F.min("_key").alias("lo"), F.max("_key").alias("hi"))
        upto = Window.partitionBy("_node").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
        bins = bins.withColumn("end", F.col("_base") + F.sum("w").over(upto))
        hit = (bins.filter("end >= _want").groupBy("_node")
               .agg(F.min_by(F.struct("w", "lo", "hi", "end"), "_bin").alias("b")).select("_node", "b.*"))
        found = {r["_node"]: r for r in hit.collect()}
        later = {}
        for n, (d, _, hi, want, tol, base) in todo.items():
            r = found.get(n)
            if r is None:
                cuts[n] = hi + 1
            elif r["w"] <= tol or r["lo"] == r["hi"]:
                cuts[n] = r["lo"] if want - (r["end"] - r["w"]) < r["end"] - want else r["hi"] + 1
            else:
                later[n] = (d, r["lo"], r["hi"], want, tol, r["end"] - r["w"])
        todo = later
    return cuts


def assign(df: DataFrame, n_shards: int, dims: dict[str, Column], weight: str, tie: Column) -> DataFrame:
    """``df`` with ``shard`` in 0..n_shards-1; ``df`` is read once per histogram pass and should be stored."""
    spark = df.sparkSession
    keyed = stored(_scaled(df, dims, tie).withColumn("_w", F.col(weight)), "kd-keys")
    n_dims = len(dims)
    first = {0: n_shards}  # node -> shards it stands for; a node is named by the first of them
    placed, level = keyed.withColumn("_node", F.lit(0)), first
    while any(k > 1 for k in level.values()):
        ends = [f(f"_k{i}").alias(f"{n}{i}") for i in range(n_dims) for n, f in (("lo", F.min), ("hi", F.max))]
        stats = {r["_node"]: r for r in placed.groupBy("_node").agg(F.sum("_w").alias("w"), *ends).collect()}
        asked, dim_of = {}, {}
        for node, k in level.items():
            s = stats.get(node)
            if k < 2 or s is None:
                continue
            dim = max(range(n_dims), key=lambda i, s=s: s[f"hi{i}"] - s[f"lo{i}"])
            dim_of[node] = dim
            asked[node] = (dim, s[f"lo{dim}"], s[f"hi{dim}"], s["w"] * (k // 2) / k, TOLERANCE * s["w"] / k)
        cuts = _quantiles(placed, n_dims, asked)
        down = _rows(spark, [(n, dim_of[n], cuts[n], n + level[n] // 2) for n in asked], "_node int, _dim int, _cut long, _right int")
        placed = placed.join(down, "_node", "left").withColumn(
            "_node", F.when(F.col("_dim").isNotNull() & (_pick(n_dims, F.col("_dim")) >= F.col("_cut")), F.col("_right"))
            .otherwise(F.col("_node"))).drop("_dim", "_cut", "_right")
        placed = stored(placed, "kd-level")  # else every pass of a level repeats the joins of those above
        level = {m: c for n, k in level.items() for m, c in (((n, k // 2), (n + k // 2, k - k // 2)) if k > 1 else ((n, k),)) if c}
        if not asked:
            break
    return placed.withColumnRenamed("_node", "shard").drop("_w", *(f"_k{i}" for i in range(n_dims)))


def report(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    """Every document's shard and its gapless slot there, under the law of near-equal bytes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    meta = numbered(docs.select(
        "doc_id", (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        "source", "lang", F.length(text).alias("_chars")), "_nr")
    place = lambda c: F.when(F.col(c).isNotNull(), F.pmod(F.xxhash64(c), F.lit(2 ** 31)))
    dims = {"doc_id": F.col("doc_id"), "chars": F.col("_chars"), "source": place("source"), "lang": place("lang")}
    tie = F.xxhash64("doc_id", "text_crc32", "size", "_nr")
    out = stored(assign(meta, n_shards, dims, "size", tie).select("doc_id", "size", "text_crc32", "_nr", F.col("shard").cast("int"), F.lit(1).cast("long").alias("_one")), "kd-shards")
    out = with_start(out, ["shard"], ["doc_id", "text_crc32", "size", "_nr"], "_one", "slot", buckets_for(out.count()))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast(T.IntegerType()).alias("grown_shard"))
