"""Vector collection as a Parquet table (V1-V7).

Layout of a collection directory::

    <path>/points-<g>/writer=<w>/batch=<b>/   (point_id BIGINT, doc_id, pos INT, text STRING, embedding ARRAY<...>)
    <path>/meta/generation=<g>/               one row: name STRING, dim INT, distance STRING

The highest generation in ``meta`` is the collection. Recreating writes the next generation's empty points first and its metadata
last, so a job that dies on the way leaves the collection as it was.

``point_id`` is a hash of ``(doc_id, pos, text)`` so a re-run gives the same ids; appending
the same chunks twice keeps both copies, as a fresh-id upsert does.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from sparqa.session import checkpoint_dir

DISTANCE = "cosine"


def _points(path: str, generation: int) -> str:
    return f"{path.rstrip('/')}/points-{generation}"


def _meta(path: str) -> str:
    return path.rstrip("/") + "/meta"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the collection has metadata; any error but a missing folder surfaces."""
    try:
        spark.read.parquet(_meta(path)).limit(1).collect()
        return True
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise


def _write_meta(spark: SparkSession, path: str, name: str, dim: int, generation: int) -> None:
    spark.createDataFrame([(name, int(dim), DISTANCE)], "name string, dim int, distance string") \
        .coalesce(1).write.mode("overwrite").parquet(f"{_meta(path)}/generation={generation}")


def _batch_path(path: str, generation: int, writer: str, batch: str | int) -> str:
    return f"{_points(path, generation)}/writer={writer}/batch={batch}"


def _write_empty_points(spark: SparkSession, path: str, vec_type: str, generation: int) -> None:
    """A batch of no points, which fixes the schema; points of other writers stay."""
    none = spark.createDataFrame([], f"point_id bigint, doc_id bigint, pos int, text string, embedding array<{vec_type}>")
    none.write.mode("overwrite").parquet(_batch_path(path, generation, "create", 0))


def _latest(spark: SparkSession, path: str):
    """The metadata row of the current generation."""
    return spark.read.parquet(_meta(path)).orderBy(F.desc("generation")).first()


def generation_of(spark: SparkSession, path: str) -> int:
    return int(_latest(spark, path)["generation"])


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    """(name, dim, distance) of the collection."""
    meta = spark.read.parquet(_meta(path))
    return meta.where(F.col("generation") == generation_of(spark, path)).select("name", "dim", "distance")


def collection_dimension(spark: SparkSession, path: str) -> int:
    """V3: the stored dimension; error when it cannot be determined."""
    row = _latest(spark, path)
    if row is None or row["dim"] is None:
        raise ValueError(f"the metadata of {path} names no vector length")
    return int(row["dim"])


def create_collection(spark: SparkSession, path: str, dim: int, name: str = "collection",
                      recreate_on_dimension_mismatch: bool = False,
                      vec_type: str = "double") -> str:
    """V1 + V2: create when missing; on an existing one guard the dimension.

    A mismatch raises naming both dimensions, or starts an empty generation when asked to.
    Returns the action taken: ``created``, ``reused`` or ``recreated``.
    """
    if not exists(spark, path):
        _write_empty_points(spark, path, vec_type, 0)
        _write_meta(spark, path, name, dim, 0)
        return "created"
    current = collection_dimension(spark, path)
    if current != dim:
        if not recreate_on_dimension_mismatch:
            raise ValueError(f"collection '{name}' holds vectors of length {current}, those given have {dim}; "
                             "index into another one or pass recreate_on_dimension_mismatch=True")
        following = generation_of(spark, path) + 1
        _write_empty_points(spark, path, vec_type, following)
        _write_meta(spark, path, name, dim, following)  # from here on the old points are out of the collection
        return "recreated"
    return "reused"


def point_ids(doc_col: str = "doc_id", pos_col: str = "pos", text_col: str = "chunk"):
    return F.xxhash64(F.col(doc_col), F.col(pos_col), F.col(text_col))


def to_points(chunks: DataFrame, doc_col: str = "doc_id", pos_col: str = "pos",
              text_col: str = "chunk", vec_col: str = "embedding") -> DataFrame:
    """V4 shape: pair each vector with its own text by key (no positional zip).

    ``doc_id`` is an integer key; a file corpus uses ``xxhash64(path)`` and keeps the path
    alongside (see ``sources.corpus``).
    """
    return chunks.select(point_ids(doc_col, pos_col, text_col).alias("point_id"),
                         F.col(doc_col).cast("bigint").alias("doc_id"),
                         F.col(pos_col).cast("int").alias("pos"),
                         F.col(text_col).alias("text"),
                         F.col(vec_col).alias("embedding"))


def append_points(points: DataFrame, path: str, writer: str = "append", batch: str | int | None = None) -> None:
    """V4: one distributed append; duplicates are kept.

    Each call writes a folder of its own (``writer``, ``batch``); a replayed batch replaces itself and nothing else. A
    vector of another length than the collection's fails the write.
    """
    meta = _latest(points.sparkSession, path)
    dim = int(meta["dim"])
    vec = F.col("embedding")
    fits = F.when(F.size(vec) == dim, vec).otherwise(F.raise_error(F.concat(F.lit(f"the collection holds vectors of length {dim}, not "), F.size(vec).cast("string"))))
    points.withColumn("embedding", fits).write.mode("overwrite").parquet(_batch_path(path, int(meta["generation"]), writer, uuid.uuid4().hex if batch is None else batch))


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """The points of all writers."""
    return spark.read.parquet(_points(path, generation_of(spark, path))).drop("writer", "batch")


def collection_count(spark: SparkSession, path: str) -> int:
    """V5: number of points; only an absent collection counts as empty."""
    if not exists(spark, path):
        return 0
    return read_points(spark, path).count()


def is_empty(spark: SparkSession, path: str) -> bool:
    if not exists(spark, path):
        return True
    return read_points(spark, path).isEmpty()


def index_corpus(spark: SparkSession, docs: DataFrame | None, path: str, *, dim: int,
                 chunker, embed_fn, name: str = "collection",
                 recreate_on_dimension_mismatch: bool = False) -> dict:
    """V6 + V7: index once. Chunk, embed and append in one lazy plan when empty.

    ``chunker``: docs -> (doc_id, pos, chunk); ``embed_fn``: chunks -> + embedding.
    Returns a summary dict (action, n_points).
    """
    action = create_collection(spark, path, dim, name, recreate_on_dimension_mismatch)
    if not is_empty(spark, path):
        return {"action": "skipped", "n_points": collection_count(spark, path)}
    if docs is None:
        raise ValueError(f"Collection '{name}' is empty and no documents were given to index.")
    pts = to_points(embed_fn(chunker(docs)))
    append_points(pts, path)
    return {"action": action, "n_points": collection_count(spark, path)}
