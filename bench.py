"""Time the headline queries; prints one JSON line.

Derived inputs are written once before the clock starts (reported as
``setup``); each query is then run to completion, uncached, into a no-op
sink, and the median of BENCH_RUNS runs is kept.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from terrane.plans.catalog import QUERIES
from terrane.plans.catalog_hierarchy import tree_labels
from terrane.plans.catalog_retrieval import sections
from terrane.plans.code import source_files
from terrane.plans.derived import view
from terrane.plans.views import VIEWS
from tools.local import local_session

HEADLINE = [
    "risky_modules", "resolve_imports", "build_graph", "node_risk", "k_hop", "connected_components", "rollup_edges",
    "chunk_tokens", "merge_small_chunks", "pack_sections", "hash_embed", "knn", "extract_corpus",
    "topic_attempts", "profile_report",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    start = time.time()
    for name in VIEWS:
        view(spark, sf_dir, name)
    source_files(spark, sf_dir)
    sections(spark, sf_dir)
    tree_labels(spark, sf_dir)
    setup = time.time() - start
    timings = {}
    for name in names:
        taken = []
        for _ in range(runs):
            start = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.time() - start)
        timings[name] = round(statistics.median(taken), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "setup": round(setup, 3), "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
