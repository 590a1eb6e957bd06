"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is forced to full evaluation with the ``noop`` sink (no rows travel to
the driver). Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sparqa import get_spark  # noqa: E402
from sparqa.plans.queries import QUERIES  # noqa: E402

HEADLINE = [
    "chunk_documents", "embed_chunks", "index_corpus", "ask", "retrieve_topk", "knn_cosine",
    "run_generation", "bertscore", "experiment_stages", "judge_means", "judge_verdicts",
    "load_generated", "repair_overwrite", "merge_metrics", "describe_numeric", "describe_text",
    "rag_delta", "report_rows",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=cpus)
    times: dict[str, float | None] = {}
    rows: dict[str, int] = {}
    errors: dict[str, str] = {}
    # untimed JVM / Python-worker warm-up on the smallest table
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.format("noop").mode("overwrite").save()
    for name in names:
        t0 = time.perf_counter()
        try:
            df = QUERIES[name](spark, sf_dir)
            df.write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - t0, 3)
        except Exception as e:  # keep the one-line report even if a query fails
            times[name] = None
            errors[name] = f"{type(e).__name__}: {str(e)[:200]}"
    if "ask" in names and times.get("ask") is not None:
        rows["ask"] = QUERIES["ask"](spark, sf_dir).count()
    sf = os.path.basename(sf_dir).removeprefix("sf")
    out = {"metric": "headline_total", "value": round(sum(t for t in times.values() if t is not None), 3),
           "unit": "sec", "queries": times, "sf": sf, "cpus": cpus, "rows": rows}
    if errors:
        out["errors"] = errors
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
