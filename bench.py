"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8) and
BENCH_QUERIES (names, comma-separated) set what runs.  Every query is run once
unmeasured and once measured, into a sink that keeps nothing.
"""

from __future__ import annotations

import json
import os
import sys
import time

from waymark.plans.registry import load_all
from waymark.session import local_session

HEADLINE = [
    "facets_all", "search_page", "nearest_topk", "grid_clusters", "colocated_members", "region_tree", "relaxation_ladder",
    "region_cat_matrix", "numbered_places", "place_table", "landed_rows", "dup_suffix_id", "keep_first", "brand_detect",
    "keyword_matrix", "publish_guard", "reconcile_upsert", "corpus_chunks", "corpus_dedupe", "vector_topk",
    "page_links", "page_dictionary", "page_delta", "feed_items", "admission_hourly", "daily_visits", "session_first",
    "conv_last_turns", "corpus_union", "chunk_store", "publish_swap", "document_files", "vector_topk_many_queries",
    "page_dictionary_by_seed", "stream_daily_visits", "stream_admission_hourly",
    "page_text", "table_chunks", "nightly_places", "nightly_survey", "reconcile_guarded",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    registered, seconds = load_all(), {}
    for name in names:
        for _ in range(2):
            start = time.perf_counter()
            registered[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
