"""Time the headline queries and print one JSON line.

BENCH_SF_DIR  folder of the test tables (default /root/testdata/sf0.1)
BENCH_CPUS    cores for the local master (default 8)
BENCH_QUERIES comma-separated names instead of the headline set; ``all`` for every query
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from lodestone.plans import PLANS
from lodestone.session import build_session

HEADLINE = (
    # SQL and reports
    "count_rows", "list_columns", "regex_top5", "ilike_count", "bounded_query", "schema_digest", "fk_check",
    "top_recipients", "top_counterparts", "pass_rate", "recall_pivot", "recall_at_k",
    # files and sinks
    "load_ask_items", "load_search_maps", "export_fiscal_year", "ingest_selected", "score_responses",
    # building the store
    "embed_column", "build_postings", "upsert_embeddings", "embedding_health", "embedding_health_sketched", "collapsed_vectors",
    "perturb_queries", "stratified_sample", "embed_batches",
    # search: one batch of queries against the whole store
    "search_eval_names", "search_eval", "hybrid_search", "hybrid_search_table", "rrf_fuse", "keyword_topk", "keyword_topk_indexed",
    "match_all_terms", "keyword_ts_rank", "keyword_after_upsert", "search_text", "lexicon_search", "knn_cosine", "knn_lsh", "knn_pruned",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    names = HEADLINE if not chosen else tuple(PLANS) if chosen == "all" else tuple(chosen.split(","))
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start the executor threads and Python workers before the clock runs.
    spark.range(1000).mapInArrow(lambda batches: batches, "id long").count()

    seconds: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        PLANS[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name:26} {seconds[name]:8.3f}", file=sys.stderr)
    found = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(found.group(1)) if found else folder,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
