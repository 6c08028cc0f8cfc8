"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line. Each is run once unmeasured, then BENCH_RUNS times; the best counts."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

HEADLINE = [
    "pricing_summary", "scan_project", "join_inner", "join_multiway", "join_asof", "join_range", "agg_hash", "agg_count_distinct", "agg_cube", "agg_median_percentile", "window_ranks", "window_running_sum", "window_topk_per_group", "topk", "subquery_correlated",
    "set_intersect", "scalar_strings", "json_filter_language", "vector_knn", "vector_batch_knn", "stream_read_many", "group_pending_summary", "cdc_snapshot_diff", "cdc_replay", "kv_incr", "mvcc_snapshot", "time_tumbling", "time_sessions",
]


def main() -> None:
    root = Path(__file__).resolve().parent
    sys.path.insert(0, str(root))
    os.environ["PYTHONPATH"] = f"{root}:{os.environ.get('PYTHONPATH', '')}"
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    from lodestone.registry import QUERIES
    from lodestone.session import session

    spark = session(f"local[{cpus}]", int(cpus), spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        times = []
        for _ in range(1 + int(os.environ.get("BENCH_RUNS", "2"))):
            began = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(min(times[1:]), 4)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "sf": folder.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
