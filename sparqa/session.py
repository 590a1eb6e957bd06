"""Session construction and cluster-facing helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, app: str = "sparqa",
              shuffle_partitions: int | None = None,
              extra: dict[str, str] | None = None) -> SparkSession:
    """Build (or reuse) a session with AQE, skew-join handling and Arrow on.

    On a cluster ``master`` is left to spark-submit; locally pass ``local[N]``.
    The web UI stays off: nothing here opens a port beyond Spark's own RPC.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # rows here are light in bytes but heavy in CPU (judging, token matching, embedding):
        # never coalesce a shuffle below 64 KB partitions, so small stages keep every core;
        # at scale partitions are far above this and nothing changes
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": os.environ.get("SPARQA_DRIVER_MEMORY", "16g"),
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for cut lineage and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``; it is only set here when
    unset (local runs and tests), to a fresh scratch folder.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    sc = _context(spark)
    if not d and sc is not None:
        d = sc.getCheckpointDir()
    if not d:
        if sc is not None and not sc.master.startswith(("local[", "local ")) and sc.master != "local":
            raise ValueError("spark.checkpoint.dir names no folder; on a cluster driver and executors need a shared one")
        d = tempfile.mkdtemp(prefix="sparqa-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if sc is None:
        return d
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def _context(spark: SparkSession):
    """The SparkContext of a classic session; None under Spark Connect."""
    try:
        return spark.sparkContext
    except Exception:
        return None


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``sparqa`` importable in every Python worker (as ``--py-files`` would).

    The package is zipped once per application and added with ``addPyFile``; workers then resolve UDFs and ``mapInPandas`` functions
    defined in ``sparqa`` regardless of their working directory.
    """
    sc = _context(spark)
    if sc is None or sc.applicationId in _SHIPPED:
        return
    import zipfile

    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    # the driver serves the file to the executors itself, so a folder of its own will do
    target = os.path.join(tempfile.mkdtemp(prefix="sparqa-zip-"), f"sparqa-{sc.applicationId}.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin repartition only when a scan yields fewer partitions than cores.

    Large inputs already split into many file splits and pass through untouched,
    so no shuffle is added at scale; a one-row-group file gets spread over the cores.
    """
    sc = _context(df.sparkSession)
    if sc is None:
        return df
    target = min_partitions or sc.defaultParallelism
    try:
        n = df.rdd.getNumPartitions()
    except Exception:
        return df
    if n < target:
        return df.repartition(target)
    return df
