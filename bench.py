"""Times the headline queries and prints one JSON line.

Reads $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS]. Every query is
planned and run to its end (all rows produced, none fetched); the best of two runs counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "search_literal", "search_page", "page_totals", "facet_siblings", "facet_display",
    "posting_summary", "posting_detail", "board_counts", "board_conflicts",
    "backfill_candidates", "backfill_summary", "parse_messages", "bronze_upsert",
    "run_registry", "tombstone", "silver_upsert", "route_rules", "json_detail_map",
    "json_index_explode", "posting_filters", "silver_rows", "shape_refusals", "pay_rules",
    "pay_columns", "metadata_rules", "url_functions", "decode_body", "page_links",
    "frontier", "clean_pages", "clean_nodes", "to_markdown", "extract_fields",
    "request_dedup", "lease_state", "snapshot_links", "snapshot_fields", "foreign_documents",
    "trim_budget", "stream_bronze",
)


def main() -> None:
    from gleanwork.queries import QUERIES
    from gleanwork.session import builder

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = (
        builder("bench")
        .master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    times: dict[str, float] = {}
    for name in names:
        runs = 1 if name.startswith("stream_") else 2
        best = float("inf")
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - start)
        times[name] = round(best, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
