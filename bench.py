"""Bench: headline queries at $BENCH_SF_DIR (default sf0.1) on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value" (sum of per-query seconds), "unit", "queries", "sf"}.
Each query is fully executed (written to a no-op sink) once after a warm-up of the session.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lookalike.plans.catalog import QUERIES  # noqa: E402
from lookalike.session import local_session  # noqa: E402

HEADLINE = [
    "precise_lookalikes", "nearest_lookalikes", "sampled_lookalikes", "similarity_summary",
    "quality_report", "describe_features", "correlation_matrix", "iqr_bounds", "winsorize_iqr",
    "missing_profile", "median_fill", "segment_profiles", "silhouette", "inertia_curve",
    "stratified_split", "classification_report", "confusion_matrix", "knn_impute", "isolation_forest",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(cpus) * 2 if cpus.isdigit() else 16, app="lookalike-bench")
    # warm the JVM and the Python workers once (no result of a timed query is reused)
    QUERIES["segment_sizes"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    spark.range(64, numPartitions=int(cpus) if cpus.isdigit() else 8).mapInPandas(
        lambda it: it, "id long").write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_seconds_headline_queries", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
