"""Headline queries: python bench.py -> one JSON line."""

from __future__ import annotations

import json
import os
import time

from roomgraph.plans.all_queries import QUERIES
from roomgraph.session import build_session

HEADLINE = [
    "relations_on", "relations_near", "on_support", "locate_top", "where_is", "retrieval_answer",
    "lift_boxes", "class_votes", "nms_keep", "reid_best", "kb_topk", "relation_upsert",
    "gate_replay", "parse_outputs", "redact_counts", "injection_scan", "read_segments",
    "kb_chunks", "latency_pcts", "relations_above", "instance_rollup", "novel_candidates",
    "confirm_upgrade", "correction_log", "shape_replies", "relational_query", "relation_text",
    "jump_filter", "candidate_pool_placed",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/region.parquet").count()
    took: dict[str, float] = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec",
        "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
