"""Corpus scans and document assembly."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparqa.functions.text import strip


BINARY_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()),
                              T.StructField("path", T.StringType()),
                              T.StructField("modificationTime", T.TimestampType()),
                              T.StructField("length", T.LongType()),
                              T.StructField("content", T.BinaryType())])


def scan_corpus(spark: SparkSession, path: str, fmt: str = "parquet", suffix: str = "*.pdf") -> DataFrame:
    """A corpus folder.

    - ``binary``: every file matching ``suffix`` at any depth (case-sensitive) as
      ``(doc_id, path, modificationTime, length, content)``; decoding is a separate step.
    - ``text``: one row per file, whole file as ``text``, with ``doc_id`` and ``path``.
    ``doc_id`` is ``xxhash64(path)``, the integer document key the collection uses.
    - ``parquet``: a table of documents.
    A folder without matching files, or a missing folder, gives an empty DataFrame,
    not an error ("nothing found").
    """
    from pyspark.errors import AnalysisException

    if fmt == "binary":
        try:
            files = spark.read.format("binaryFile").option("recursiveFileLookup", True) \
                .option("pathGlobFilter", suffix).load(path)
            return files.select(F.xxhash64("path").alias("doc_id"), "*")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return spark.createDataFrame([], BINARY_SCHEMA)
    if fmt == "text":
        # wholetext must be an argument: text() resets the option to its own default
        files = spark.read.text(path, wholetext=True, recursiveFileLookup=True) \
            .select(F.input_file_name().alias("path"), F.col("value").alias("text"))
        return files.select(F.xxhash64("path").alias("doc_id"), "path", "text")
    return spark.read.format(fmt).load(path)


def assemble_pages(pages: DataFrame, doc_col: str = "doc_id", page_col: str = "page_no",
                   text_col: str = "text") -> DataFrame:
    """Page texts concatenated in page order with no separator -> ``(doc, text)``.

    A document is one output value, so its pages meet in one row by definition; the
    grouping is per document (partial aggregation collects per map partition first).
    """
    agg = pages.groupBy(doc_col).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(page_col, F.coalesce(
            F.col(text_col), F.lit("")).alias("t")))), lambda p: p["t"]), "").alias(text_col))
    return agg


def drop_empty(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """S3: drop documents whose text is NULL or blank after strip."""
    return docs.where(F.col(text_col).isNotNull() & (strip(text_col) != ""))


EXTRACT_TYPE = T.StructType([T.StructField("value", T.StringType()),
                             T.StructField("error", T.StringType())])


def safe_extract(fn: Callable[[object], str]):
    """S4 helper: wrap a per-document extractor so failures become data, not task errors.

    Returns an Arrow-batched UDF ``input -> struct<value, error>``.
    """

    @F.pandas_udf(EXTRACT_TYPE)
    def _run(values: pd.Series) -> pd.DataFrame:
        out_v, out_e = [], []
        for v in values:
            try:
                out_v.append(fn(v))
                out_e.append(None)
            except Exception as e:  # the whole document is skipped downstream
                out_v.append(None)
                out_e.append(f"{type(e).__name__}: {e}")
        return pd.DataFrame({"value": out_v, "error": out_e})

    return _run


def isolate_failures(rows: DataFrame, doc_col: str = "doc_id", error_col: str = "error"):
    """Any error on any row of a document drops the **whole** document.

    Returns ``(kept_rows, errors)``; ``errors`` is the side table ``(doc, error)``.
    The failing document ids are a semi-join side (AQE broadcasts it only when its
    measured size allows); no per-document window is needed.
    """
    errors = rows.where(F.col(error_col).isNotNull()).select(doc_col, error_col)
    bad = errors.select(doc_col).distinct()
    kept = rows.join(bad, on=doc_col, how="left_anti")
    return kept, errors
