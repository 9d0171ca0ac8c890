"""Headline queries, timed; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidewater.plans.catalog import REGISTRY  # noqa: E402
from tidewater.session import local_session  # noqa: E402

HEADLINE = [
    "nn_exact_l2",
    "knn_topk_exact",
    "kmeans_iter_20",
    "ivf_search_nprobe10",
    "edges_undirected_whole",
    "degree_stats_whole",
    "csr_edges_whole",
    "bfs_frontier_sizes_whole",
    "gather_by_index",
    "tier_hits_3",
    "cache_fifo_sim",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, cpus)
    spark.sparkContext.setLogLevel("ERROR")
    REGISTRY["degree_table"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    times = {}
    for name in HEADLINE:
        t = time.perf_counter()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)
        spark.catalog.clearCache()
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
