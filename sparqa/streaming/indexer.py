"""Incremental indexing (V4 + V7 as a stream): new documents landing in a folder are
chunked, embedded and appended to a collection.

Each micro-batch is written under the folder of its stream and batch with overwrite, so a
batch replayed after a failure (Structured Streaming re-runs the last uncommitted
batch from its checkpoint) replaces its own output instead of duplicating it.
The stream's checkpoint lives in the shared checkpoint folder.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from sparqa.operators import chunk as ch
from sparqa.operators import collection as coll
from sparqa.operators.embed import Embedder, embed, hash_embedder


def _index_batch(path: str, writer: str, chunk_size: int, embedder: Embedder):
    def run(batch: DataFrame, batch_id: int) -> None:
        chunks = ch.chunk_documents(batch.select("doc_id", "text"), chunk_size=chunk_size)
        pts = coll.to_points(embed(chunks, "chunk", "embedding", embedder))
        coll.append_points(pts, path, writer, batch_id)
    return run


def start_indexer(spark: SparkSession, source_dir: str, path: str, *, dim: int,
                  schema: str = "doc_id bigint, text string, lang string, source string, n_chars bigint",
                  file_glob: str = "*.parquet", chunk_size: int = ch.DEFAULT_CHUNK_SIZE,
                  embedder: Embedder = hash_embedder, checkpoint: str | None = None,
                  available_now: bool = True, max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Start the indexing stream; ``available_now`` drains what is there and stops."""
    coll.create_collection(spark, path, dim)
    reader = spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    docs = reader.parquet(source_dir)
    ckpt = checkpoint or os.path.join(coll.scratch_path(spark, "index-stream"), "_checkpoint")
    # batch numbers start anew with each checkpoint, so the checkpoint names the writer
    writer = "stream-" + hashlib.sha256(ckpt.encode()).hexdigest()[:16]
    w = docs.writeStream.foreachBatch(_index_batch(path, writer, chunk_size, embedder)) \
        .option("checkpointLocation", ckpt)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
