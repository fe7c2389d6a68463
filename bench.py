"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR  tables (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
BENCH_RUNS    timed runs per query after one warm-up (default 3; the median counts)
BENCH_ONLY    comma-separated query names, or "all" for every registered query
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from siftmap import catalog  # noqa: E402
from siftmap.session import build_session  # noqa: E402

HEADLINE = [
    "screening_rank", "screening_stop_rank", "recall_curve", "wss95", "screening_queue_page", "latest_decision_per_doc",
    "evidence_map", "cluster_top_titles", "evidence_map_pivot", "kmeans_assign", "cluster_quality_dbi",
    "gap_by_region", "gap_gini", "gap_region_sector", "adaptation_outcome_summary",
    "cluster_yearly", "living_evidence_alerts", "forecast_yearly",
    "label_gold", "label_agreement", "label_queue", "active_learning_select",
    "dataset_recipe_screening", "content_hash",
    "second_opinion_parse", "json_array_explode", "citation_extract", "chunk_documents", "weak_label_keywords",
    "vector_search", "grounded_passages",
    "model_promote", "quality_gate", "cost_ledger", "override_rate", "score_psi",
]


def main() -> None:
    base = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    catalog.load()
    only = os.environ.get("BENCH_ONLY")
    names = list(catalog.QUERIES) if only == "all" else only.split(",") if only else HEADLINE
    spark = build_session(
        "siftmap-bench", f"local[{cpus}]", spark__sql__shuffle__partitions=str(cpus), spark__driver__memory="12g",
        spark__ui__enabled="false", spark__log__level="ERROR",
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            catalog.QUERIES[name](spark, base).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    out = {"metric": "sum of median seconds per query, noop sink, warm", "value": round(sum(seconds.values()), 3), "unit": "sec",
           "queries": seconds, "sf": os.path.basename(base.rstrip("/")).removeprefix("sf"), "cpus": cpus, "runs": runs}
    print(json.dumps(out))


if __name__ == "__main__":
    main()
