"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "packets_from_captures", "capture_totals", "external_ip_traffic", "flow_ids", "sliding_windows", "window_native",
    "window_features", "score_windows", "anomaly_flags", "score_profile", "hdr_threshold", "gap_threshold",
    "final_threshold", "training_progress", "registry_audit", "rule_match", "alert_rollup", "device_report_join",
    "error_streak",
]


def main() -> None:
    from fluxwarden.plans.catalog import QUERIES
    from fluxwarden.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", cores)
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").count().collect()
    times = {}
    for key in sys.argv[1:] or HEADLINE:
        start = time.time()
        QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[key] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")), "cores": cores,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
