"""Indexing stream that replaces documents (V7): a document that comes again with another text takes the place of the old one.

Keyed state holds the last version and digest of every document. Of the rows of a document in a micro-batch the highest version counts;
what is older than the state (late) or says the same again (repeated) changes nothing. What is left is committed as a batch
of changes: new points, new document state, and tombstones for documents that come without a text.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sparqa.operators import changes
from sparqa.operators import chunk as ch
from sparqa.operators import collection as coll
from sparqa.operators.embed import Embedder, embed, hash_embedder

SOURCE = "doc_id bigint, version bigint, text string"
CHANGED = "doc_id bigint, version bigint, text string, digest string, alive boolean"
GONE = ""  # the digest of a document without a text
#: Rows, each with a whole text, that the state function's worker holds at once.
ROWS_AT_ONCE = 256
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _digest(text: str | None) -> str:
    return GONE if text is None else hashlib.sha256(text.encode()).hexdigest()


def latest_change(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The row of a document that changes its state, if any: higher version first, then larger digest."""
    version, digest = state.get if state.exists else (None, GONE)
    best = None
    for part in rows:
        for v, t in zip(part["version"], part["text"], strict=True):
            v, t = int(v), None if pd.isna(t) else t
            if best is None or (v, _digest(t)) > best[:2]:
                best = (v, _digest(t), t)
    if best is None or (version is not None and best[0] < version):
        return
    if version is not None and best[0] == version and best[1] <= digest:
        return
    state.update((best[0], best[1]))
    if best[1] != digest:  # the same text under a higher version only moves the version
        yield pd.DataFrame({"doc_id": [key[0]], "version": [best[0]], "text": [best[2]], "digest": [best[1]], "alive": [best[2] is not None]})


def changed_documents(docs: DataFrame) -> DataFrame:
    """Stream of the rows of (doc_id, version, text) that change a document; rows without an id are left out, a missing version is 0."""
    keyed = docs.where("doc_id IS NOT NULL").withColumn("version", F.coalesce("version", F.lit(0).cast("bigint")))
    return keyed.groupBy("doc_id").applyInPandasWithState(latest_change, CHANGED, "version bigint, digest string", "append", GroupStateTimeout.NoTimeout)


def _commit(path: str, chunker: Callable[[DataFrame], DataFrame], embedder: Embedder, chunk_rows: str):
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(work := f"{path.rstrip('/')}/work/batch={batch_id}")
        changed = spark.read.schema(CHANGED).parquet(work)
        if not changed.isEmpty():
            spark.conf.set(ARROW_ROWS, chunk_rows)  # chunks are short
            try:
                changes.write_batch(spark, path, batch_id, changed, chunker, lambda c: embed(c, "chunk", "embedding", embedder))
            finally:
                spark.conf.set(ARROW_ROWS, str(ROWS_AT_ONCE))
    return run


def start_replacing_indexer(spark: SparkSession, source_dir: str, path: str, *, dim: int, chunk_size: int = ch.DEFAULT_CHUNK_SIZE,
                            embedder: Embedder = hash_embedder, checkpoint: str | None = None, file_glob: str = "*.parquet",
                            available_now: bool = True, max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Start the stream over the Parquet files of ``source_dir`` (doc_id, version, text).

    The collection belongs to this stream and its checkpoint: micro-batch numbers are batch numbers, so a batch that is
    run again after a failure replaces its own points and state. Read the result with ``changes.live_points``.
    """
    coll.create_collection(spark, path, dim)
    reader = spark.readStream.schema(SOURCE).option("pathGlobFilter", file_glob).option("recursiveFileLookup", True)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    out = changed_documents(reader.parquet(source_dir))
    chunk_rows = spark.conf.get(ARROW_ROWS)
    writer = out.writeStream.outputMode("append").foreachBatch(_commit(path, lambda d: ch.chunk_documents(d, chunk_size=chunk_size), embedder, chunk_rows)) \
        .option("checkpointLocation", checkpoint or os.path.join(coll.scratch_path(spark, "replace-stream"), "_checkpoint"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    spark.conf.set(ARROW_ROWS, str(ROWS_AT_ONCE))  # the stream takes the settings of its session when it starts
    try:
        return writer.start()
    finally:
        spark.conf.set(ARROW_ROWS, chunk_rows)
