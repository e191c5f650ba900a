"""Headline queries, warm, written to the no-op sink. Prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from weftline.registry import all_queries  # noqa: E402
from weftline.session import local_session  # noqa: E402

HEADLINE = [
    "metrics_snapshot", "latency_percentiles_by_type", "regression_status", "consecutive_errors", "hit_rate",
    "index_summary", "embedding_stats", "recent_messages", "upsert_files", "cascade_delete", "snapshot_diff", "lru_survivors",
    "command_risk", "intent_plan", "nl_action", "plan_tasks",
    "text_metrics", "grep_regex", "rename_word", "line_chunks", "text_chunks", "fuzzy_match",
    "symbols", "file_metrics", "lint_issues", "review_grade", "diff_text", "git_diff_hunks",
    "cosine_topk", "centroid_by_label", "bm25_top50", "hybrid_search", "hybrid_benchmark", "cluster_tree", "tree_search",
    "token_budget", "project_metrics", "stream_counters", "stream_responses",
]


def run(query, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    query.run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    known = all_queries()
    names = sys.argv[1:] or HEADLINE
    times = {}
    for name in names:
        run(known[name], spark, sf_dir)
        times[name] = round(min(run(known[name], spark, sf_dir) for _ in range(2)), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
