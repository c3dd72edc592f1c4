"""Headline queries on local[BENCH_CPUS] over BENCH_SF_DIR; prints one JSON line.

``label_hierarchy`` is the labelling by itself; queries after it read its table. Every
result is computed in full (no-op sink).
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ramify.plans import catalog, views  # noqa: E402
from ramify.session import build_session  # noqa: E402
from ramify.store import release  # noqa: E402

HEADLINE = [
    "leaf_counts_and_paths",
    "build_hierarchy",
    "build_hierarchy_paths",
    "build_hierarchy_deep",
    "label_without_paths",
    "interval_labels",
    "bfs_ids",
    "sibling_order",
    "subtree",
    "is_in_subtree",
    "rollup_value",
    "random_leaf",
    "drop_duplicate_leaves",
    "drop_placeholder_deep",
    "titlecase_names",
    "apply_common_names",
    "search",
    "search_first_candidates",
    "search_terms",
    "resolve_path",
    "cull_viewports",
    "pick",
    "label_candidates",
    "circle_layout",
    "write_layout_parts",
    "adjacency_export",
    "shard_by_budget",
    "read_opentree_taxonomy",
    "flatten_tree_json",
    "read_tree_json",
    "merge_key_maps",
    "ewma_lag",
    "event_rate",
    "event_rate_closing",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    shared = tempfile.mkdtemp(prefix="bench-")  # one machine: shared by all of it
    spark = build_session("bench", master=f"local[{cpus}]", shuffle_partitions=cpus, checkpoint_dir=shared)
    views.table(spark, sf_dir, "nation").count()
    seconds: dict[str, float] = {}
    names = sys.argv[1:] or HEADLINE
    if names == HEADLINE:
        start = time.perf_counter()
        views.labelled(spark, sf_dir, "geo")
        seconds["label_hierarchy"] = round(time.perf_counter() - start, 3)
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    release(spark)
    spark.stop()
    result = {
        "metric": "total time of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
