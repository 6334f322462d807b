"""Headline queries at one scale; prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the cores. Every query runs whole and
into a sink that drops the rows; the time is the best of BENCH_RUNS runs.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "search_price_asc", "search_far_page", "search_keyset_page", "search_filters", "search_count", "jan_cheapest_all", "jan_ranked_all",
    "product_detail_nested", "snapshot_latest", "daily_history", "change_log", "snapshot_upsert", "priced_history_changes",
    "merge_items_fold", "ranking_live", "ranking_daily_all", "price_slices", "retention_items", "new_jobs_anti", "quality_fill",
    "quality_required", "url_canonical", "api_ingest", "list_ingest", "detail_ingest", "browse_ingest",
)


def main() -> None:
    from offerlens.plans.queries import REGISTRY
    from offerlens.session import build_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    wanted = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g", "spark.log.level": "ERROR"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/lineitem.parquet").write.format("noop").mode("overwrite").save()
    times = {}
    for name in wanted:
        best = None
        for _ in range(runs):
            start = time.perf_counter()
            REGISTRY[name](spark, folder).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
        print(f"{name:28s} {best:8.3f}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total seconds over headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
