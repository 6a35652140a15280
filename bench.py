"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from registered import all_queries  # noqa: E402
from registered.inputs import Inputs  # noqa: E402
from tools.local_session import local_session  # noqa: E402

HEADLINE = [
    "rule_duplicate_key", "rule_temporal_leakage", "engine_violations", "engine_quarantine_flags", "load_summary",
    "clean_repair_customers", "clean_cascade_loans", "point_in_time_join", "asof_join_events", "ratio_features",
    "behavioural_features", "temporal_split", "quantile_bands", "numeric_summary", "default_rate_by_decile",
    "iv_table", "correlation_matrix", "metric_suite", "segment_metrics", "lift_gains", "optimise_threshold",
    "recommend", "numeric_psi", "ks_statistics", "operational_metrics", "segment_table", "stream_operational_tumbling",
    "training_data", "score_batch", "monitoring_cycle",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")))
    queries = all_queries()
    only = [q for q in os.environ.get("BENCH_ONLY", "").split(",") if q]
    seconds: dict[str, float] = {}
    # The derived credit tables stand for stored tables; writing them is timed on its own.
    t0 = time.time()
    Inputs(spark, folder).credit()
    for name in ("customers_loaded", "loans_loaded"):
        Inputs(spark, folder).stored(name)
    seconds["write_credit_tables"] = round(time.time() - t0, 3)
    for name in only or HEADLINE:
        t0 = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - t0, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": folder.rstrip("/").split("sf")[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
