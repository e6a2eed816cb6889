"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value", "unit", "queries", "sf"}.
Each query is executed in full with the ``noop`` sink (no collect).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "dec_10_decision_summary",
    "scl_22_decision_record",
    "dec_03_narrative",
    "dec_05_budget",
    "src_10_version_as_of",
    "agg_29_approval_drift",
    "agg_20_22_ranking_metrics",
    "agg_13_calibration_table",
    "agg_08_correlation",
    "agg_06_density_histogram",
    "agg_11_grade_rates",
    "set_01_training_set",
    "agg_33_medians",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from kreditflow.catalog import queries
    from kreditflow.session import build_session

    spark = build_session(f"local[{cpus}]", app="kreditflow-bench", shuffle_partitions=int(cpus) * 2)
    qs = queries()
    only = sys.argv[1:]
    names = [n for n in HEADLINE if not only or n in only]
    # warm-up: JVM, codegen caches and file listing
    qs["agg_35_row_counts"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        t0 = time.perf_counter()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
