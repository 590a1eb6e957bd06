"""Incremental index (V6, V7): only new and changed documents are chunked and embedded again.

Beside its points a collection holds the state of its documents, one row per document and batch that touched it::

    <collection>/documents-<g>/batch=<n>/   (doc_id, version, digest, alive)

The latest batch of a document counts; ``alive`` false is a tombstone. Points carry the batch that made them (writer ``changes``), and a point
is live while its batch is its document's latest. A batch writes its points first and its document rows last: a run that
dies in between leaves the collection as it was, and the next run takes the same batch number and replaces the unfinished points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from sparqa.operators import collection as coll
from sparqa.operators.embed import embed

WRITER = "changes"
STATE = "doc_id bigint, version bigint, digest string, alive boolean"


def _state_path(spark: SparkSession, path: str) -> str:
    return f"{path.rstrip('/')}/documents-{coll.generation_of(spark, path)}"


def text_digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _batches(spark: SparkSession, path: str) -> DataFrame:
    """Every state row with its batch."""
    schema = f"{STATE}, batch bigint"
    try:
        return spark.read.schema(schema).parquet(_state_path(spark, path))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def document_state(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, version, digest, alive, batch): each document as its latest batch left it."""
    last = F.max_by(F.struct("version", "digest", "alive", "batch"), "batch").alias("s")
    return _batches(spark, path).groupBy("doc_id").agg(last).select("doc_id", "s.*")


def next_batch(spark: SparkSession, path: str) -> int:
    last = _batches(spark, path).agg(F.max("batch")).first()[0]
    return 0 if last is None else int(last) + 1


def one_text_each(docs: DataFrame, version_col: str | None = None) -> DataFrame:
    """(doc_id, version, text, digest): of the rows of a document the one of the highest version, then of the largest digest.

    Rows without an id are left out: nothing could ever replace them.
    """
    version = F.col(version_col).cast("bigint") if version_col else F.lit(0).cast("bigint")
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(version, F.lit(0).cast("bigint")).alias("version"), "text")
    rows = rows.withColumn("digest", text_digest(F.col("text")))
    best = F.max_by("text", F.struct("version", "digest")).alias("text")
    top = F.max(F.struct("version", "digest")).alias("top")
    return rows.groupBy("doc_id").agg(best, top).select("doc_id", "top.version", "text", "top.digest")


def classify(docs: DataFrame, state: DataFrame) -> DataFrame:
    """(doc_id, kind, version, text, digest) with kind ``new``, ``changed``, ``same`` or ``gone``; NULL texts of gone documents.

    ``docs`` as made by ``one_text_each``, the whole corpus. A document that is back after it had gone is new.
    """
    old = state.where("alive").select("doc_id", F.col("digest").alias("_old"))
    kind = (F.when(F.col("digest").isNull(), "gone").when(F.col("_old").isNull(), "new")
            .when(F.col("_old") == F.col("digest"), "same").otherwise("changed"))
    return docs.join(old, "doc_id", "full_outer").select("doc_id", kind.alias("kind"), "version", "text", "digest")


def write_batch(spark: SparkSession, path: str, batch: int, changed: DataFrame, chunker: Callable[[DataFrame], DataFrame],
                embed_fn: Callable[[DataFrame], DataFrame]) -> None:
    """Commit a batch: ``changed`` has doc_id, version, text, digest and alive; dead rows become tombstones."""
    points = coll.to_points(embed_fn(chunker(changed.where("alive").select("doc_id", "text"))))
    coll.append_points(points, path, WRITER, batch)
    changed.select("doc_id", "version", "digest", "alive").write.mode("overwrite").parquet(f"{_state_path(spark, path)}/batch={batch}")


def index_changes(spark: SparkSession, docs: DataFrame, path: str, *, dim: int, chunker: Callable[[DataFrame], DataFrame],
                  embed_fn: Callable[[DataFrame], DataFrame] = lambda c: embed(c, "chunk"), version_col: str | None = None) -> dict[str, int]:
    """Bring the collection to the state of ``docs`` (doc_id, text), the whole corpus as it is now.

    Documents are joined with the stored digests by id. New and changed ones are chunked and embedded, changed and gone ones lose
    their old points. Returns the number of documents of each kind. Nothing changed: nothing is written.
    """
    coll.create_collection(spark, path, dim)
    found = classify(one_text_each(docs, version_col), document_state(spark, path))
    # read twice below, and the state it was made from must not move in between
    found.where("kind <> 'same'").write.parquet(work := coll.scratch_path(spark, "changes"))
    found = spark.read.schema(found.schema).parquet(work)
    counts = {k: 0 for k in ("new", "changed", "gone")} | {r["kind"]: r["n"] for r in found.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    if any(counts.values()):
        changed = found.select("doc_id", "version", "text", "digest", (F.col("kind") != "gone").alias("alive"))
        write_batch(spark, path, next_batch(spark, path), changed, chunker, embed_fn)
    return counts


def live_points(spark: SparkSession, path: str) -> DataFrame:
    """The points of the collection without those that a later batch replaced or took away; points of other writers stay."""
    points = spark.read.parquet(coll._points(path, coll.generation_of(spark, path)))
    points = points.withColumn("batch", F.col("batch").cast("string"))
    latest = document_state(spark, path).where("alive").select(F.col("doc_id").alias("_doc"), F.col("batch").cast("string").alias("_batch"))
    mine = points.where(F.col("writer") == WRITER).join(latest, (F.col("doc_id") == F.col("_doc")) & (F.col("batch") == F.col("_batch")), "left_semi")
    return mine.unionByName(points.where(F.col("writer") != WRITER)).drop("writer", "batch")
