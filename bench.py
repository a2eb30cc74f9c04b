"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [query ...]
"""

from __future__ import annotations

import json
import os
import sys
import time

from millrace.catalog import load_all
from millrace.session import local_session

HEADLINE = [
    "profile_columns",
    "profile_correlations",
    "raw_string_profile",
    "quality_gate",
    "infer_hints",
    "source_roles",
    "impute_apply",
    "stratified_holdout",
    "fold_assign_stratified",
    "prep_audit",
    "evaluation_bundle",
    "regression_metrics",
    "submission_contract",
    "span_pairing",
    "active_agent_ffill",
    "agent_final_state",
    "agent_edges",
    "asof_correlation",
    "event_tree",
    "process_view",
    "run_fact_row",
    "comm_summary",
    "cumulative_spend",
    "spend_apportion",
    "run_catalog",
    "badges",
    "chunk_documents",
    "dedupe_passages",
    "keyword_topk",
    "embedding_topk",
    "extract_json",
    "contract_errors",
    "csv_roundtrip",
    "jsonl_tolerant",
    "tfidf_features",
    "text_baseline_cv",
    "tabular_baseline_cv",
    "score_and_submit",
    "live_summary",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    queries, _ = load_all()
    names = sys.argv[1:] or HEADLINE
    # One untimed query, so that JVM start-up is not charged to the first headline.
    queries["profile_duplicate_keys"](spark, sf_dir).collect()
    seconds = {}
    for name in names:
        started = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
