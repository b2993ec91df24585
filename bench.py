"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs twice: the first run compiles its code, the second is timed (planning included).
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from flowlens.plans import QUERIES  # noqa: E402
from flowlens.session import session  # noqa: E402

HEADLINE = (
    "trailing_features", "graph_edges_aligned", "graph_nodes_aligned", "window_vectors", "trade_graph_vectors",
    "anchored_windows", "cadence_sweep", "attack_intervals", "outside_attack_rows", "flow_assembly",
    "stride_sample", "class_split", "label_quality", "class_medians", "score_stats", "auc", "best_f1_threshold",
    "psi_by_feature", "ks_by_feature", "decision_pipeline", "blocked_asof", "audit_chain_verify", "fast_lane_actions",
    "read_ids2018", "read_dns_guarded", "stream_trailing_features", "stream_aligned_edges",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
                    spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
