"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints ONE JSON line.

Each query is executed in full through the ``noop`` sink (no collect), after
one untimed warm-up of the JVM.  Rates for the feature build and the point-in-
time lookup are reported next to the wall times.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from riskloom.plans.catalog import QUERIES  # noqa: E402
from riskloom.session import local_session  # noqa: E402

HEADLINE = ["features_batch", "features_pit", "history_lookup", "cold_start_flags", "rules_batch",
            "fusion_decisions", "time_split", "top_k_review", "ranking_metrics", "threshold_sweep",
            "calibration_curve_quantile", "amount_describe_by_label", "stream_velocity"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in QUERIES]
    spark = local_session(cpus, int(cpus) * 2 if cpus.isdigit() else 16, "riskloom-bench")
    # untimed JVM / codegen warm-up on the smallest data set (not the measured one)
    warm = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    for w in ("features_batch", "ranking_metrics"):
        QUERIES[w](spark, warm).write.format("noop").mode("overwrite").save()
    times = {}
    for n in names:
        t0 = time.time()
        QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.time() - t0, 3)
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    extra = {}
    if "features_batch" in times:
        extra["feature_build_rows_per_s"] = round(rows / times["features_batch"], 1)
    if "history_lookup" in times:
        from riskloom.plans.catalog import PROBE_START
        from pyspark.sql import functions as F
        from riskloom.sources import bindings as B
        probes = B.transactions(spark, sf_dir).where(F.col("TransactionDT") >= PROBE_START).count()
        extra["pit_lookup_probes_per_s"] = round(probes / times["history_lookup"], 1)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": cpus, "events_rows": rows, **extra}))
    spark.stop()


if __name__ == "__main__":
    main()
