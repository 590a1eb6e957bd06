"""QA datasets and result tables: scans, sinks and output naming.

CSV is read with RFC-4180 quoting (multi-line cells, doubled quotes) and the cells
pandas reads as missing are turned into NULL; NaN is turned into NULL for metrics.
Parquet is the native format; CSV export writes list columns as JSON text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparqa.functions.contexts import parse_contexts

# The cells pandas' CSV reader treats as missing.
NA_VALUES = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
             "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
QA_REQUIRED = ["question", "answer"]
GENERATED_REQUIRED = ["question", "answer", "generated_answer"]
REPAIR_REQUIRED = ["question", "answer", "generated_answer", "retrieved_contexts"]
METRIC_COLUMNS = ["bertscore_precision", "bertscore_recall", "bertscore_f1", "context_precision",
                  "context_recall", "faithfulness", "answer_relevancy"]


def require_columns(df: DataFrame, required: list[str], what: str = "Dataset") -> None:
    """Eager name check; the error lists the missing names sorted."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"{what} must contain columns {missing}.")


def null_na_cells(df: DataFrame) -> DataFrame:
    """NULL out pandas' missing-value spellings in string columns; NaN -> NULL in doubles."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            c = F.when(c.isin(NA_VALUES), F.lit(None).cast("string")).otherwise(c)
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.nanvl(c, F.lit(None).cast(f.dataType))
        out.append(c.alias(f.name))
    return df.select(*out)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    r = spark.read.option("header", True).option("multiLine", True).option("escape", '"') \
        .option("quote", '"').option("mode", "FAILFAST") \
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    if schema is not None:
        r = r.schema(schema)
    return r.csv(path)


def load_qa(spark: SparkSession, path: str, fmt: str = "csv", schema=None,
            drop_context: bool = False) -> DataFrame:
    """S5 (+S6): QA dataset with required ``question``/``answer``; extra columns pass through."""
    df = read_csv(spark, path, schema) if fmt == "csv" else spark.read.format(fmt).load(path)
    require_columns(df, QA_REQUIRED, "Dataset")
    df = null_na_cells(df)
    if drop_context:
        df = df.drop("context")
    return df


def load_generated(spark: SparkSession, path: str, fmt: str = "csv", schema=None) -> DataFrame:
    """Generated results; M2 fill on the text columns; contexts parsed (F1) or ``[]``."""
    if fmt == "csv":
        df = read_csv(spark, path, schema)
    else:
        df = spark.read.format(fmt).load(path)
    require_columns(df, GENERATED_REQUIRED, "Generated results")
    df = null_na_cells(df)
    for c in GENERATED_REQUIRED:
        df = df.withColumn(c, F.coalesce(F.col(c).cast("string"), F.lit("")))
    if "retrieved_contexts" in df.columns:
        if isinstance(df.schema["retrieved_contexts"].dataType, T.ArrayType):
            df = df.withColumn("retrieved_contexts",
                               F.coalesce("retrieved_contexts", F.array().cast("array<string>")))
        else:
            df = df.withColumn("retrieved_contexts", parse_contexts(F.col("retrieved_contexts")))
    else:
        df = df.withColumn("retrieved_contexts", F.array().cast("array<string>"))
    return df


def save_results(df: DataFrame, path: str, fmt: str = "parquet",
                 partition_by: list[str] | None = None) -> None:
    """Overwrite; parent folders are created by the writer.

    CSV cannot hold arrays, so list columns are written as JSON text.
    """
    if fmt == "csv":
        cols = [F.to_json(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.ArrayType)
                else F.col(f.name) for f in df.schema.fields]
        w = df.select(*cols).write.option("header", True).option("escape", '"') \
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    else:
        w = df.write
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.mode("overwrite").format(fmt).save(path)


def build_output_path(base: Column, suffix: Column) -> Column:
    """``<base>_<suffix><ext>``; ext is the extension of ``base`` (``.csv`` if none).

    Extension as in ``os.path.splitext``: the last '.' of the file name that has a
    non-dot character before it.
    """
    pat = r"^((?:.*/)?\.*[^./][^/]*?)(\.[^./]*)?$"
    ok = base.rlike(pat)
    stem = F.when(ok, F.regexp_extract(base, pat, 1)).otherwise(base)
    ext = F.when(ok, F.regexp_extract(base, pat, 2)).otherwise(F.lit(""))
    return F.concat(stem, F.lit("_"), suffix, F.when(ext == "", F.lit(".csv")).otherwise(ext))


def repaired_path(input_path: Column, output: Column | None = None) -> Column:
    """Explicit output, else every '.csv' in the input replaced by '_nan_fixed.csv'."""
    derived = F.replace(input_path, F.lit(".csv"), F.lit("_nan_fixed.csv"))
    return derived if output is None else F.coalesce(output, derived)


def check_not_same(input_path: str, output_path: str) -> None:
    """S10 guard: Spark cannot overwrite the table it is reading."""
    if input_path.rstrip("/") == output_path.rstrip("/"):
        raise ValueError(f"Output path equals input path: {input_path}")


def resolve_input(given: Column, base_output: Column, suffix: Column) -> Column:
    """The given generated path (shared by all experiments), else the derived one."""
    return F.coalesce(given, build_output_path(base_output, suffix))


def union_results(frames: dict[str, DataFrame], label_col: str = "label") -> DataFrame:
    """Label each result table and union by name (absent columns become NULL)."""
    out = None
    for label, df in frames.items():
        d = df.withColumn(label_col, F.lit(label))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


#: The type lattice of inferred columns: a column is as wide as its widest cell; cells that read as missing count for nothing.
TYPE_ORDER = ["void", "bigint", "double", "string"]
_INTEGER = r"^[+-]?[0-9]{1,18}$"
_DOUBLE = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]{1,3})?$"


def _rank_of(c: Column) -> Column:
    """Place of a cell's type in ``TYPE_ORDER``."""
    return F.when(c.isNull() | c.isin(*NA_VALUES), 0).when(c.rlike(_INTEGER), 1).when(c.rlike(_DOUBLE), 2).otherwise(3)


def inferred_types(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(*by, position, column, type) of a table of text cells: the least type that holds all of a column's cells.

    One aggregate pass over all columns (and files, with ``by``) at once. A column of missing cells alone is ``void``.
    """
    by = by or []
    cols = [c for c in df.columns if c not in by]
    names = F.array(*[F.lit(t) for t in TYPE_ORDER])
    wide = df.groupBy(*by).agg(*[F.coalesce(F.max(_rank_of(F.col(f"`{c}`"))), F.lit(0)).alias(c) for c in cols])
    entry = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), names[F.col(f"`{c}`")].alias("type")) for i, c in enumerate(cols)])
    return wide.select(*by, F.explode(entry).alias("e")).select(*by, "e.position", "e.column", "e.type")


def reconciled(frames: dict[str, DataFrame], label_col: str = "label") -> tuple[DataFrame, dict[str, str]]:
    """S12 over tables of text cells whose inferred types clash: one union whose columns have the least type that holds them in every file.

    The types of all files and columns are found in one pass over the labelled union and folded by the lattice (integer below double
    below string, missing cells neutral). A column that is missing everywhere is a string. Returns the union and the types.
    """
    out = union_results(frames, label_col)
    per = inferred_types(out, [label_col]).collect()  # files x columns rows
    kinds: dict[str, str] = {}
    for r in per:
        kinds[r["column"]] = max(kinds.get(r["column"], "void"), r["type"], key=TYPE_ORDER.index)
    kinds = {c: "string" if k == "void" else k for c, k in kinds.items()}
    cells = {c: F.when(~F.col(f"`{c}`").isin(*NA_VALUES), F.col(f"`{c}`")).cast(k) for c, k in kinds.items()}
    return out.select(label_col, *[cells[c].alias(c) for c in out.columns if c != label_col]), kinds
