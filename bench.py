"""Benchmark: run the headline jobs on ``$BENCH_SF_DIR`` (default sf0.1) on
``local[$BENCH_CPUS]`` and print one JSON line.

Each query is fully evaluated with the ``noop`` sink (no collect to the
driver); after one warm-up pass every query is timed ``$BENCH_REPEAT`` times
(default 3) and the median is reported. ``value`` is the sum of medians.
``BENCH_QUERIES=all`` times every registered query; a comma list picks some.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "user_segments", "dwd_order_details", "product_stats", "product_ranking", "realtime_dashboard",
    "sales_trend", "agent_workload", "agent_ranking", "status_distribution", "hourly_ticket_trend",
    "smart_grid_summary", "region_report_extended", "latest_status", "equipment_daily_summary",
    "alarm_status_join", "fault_analysis", "apply_changes", "upsert_row", "unified_tier_query",
    "layer_row_counts",
]
# run once: the change files are landed before the clock starts, the streaming is timed
ONCE = ["incremental_user_stats"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    from tidemark.plans.catalog import queries
    from tidemark.session import get_session
    spark = get_session(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2, app_name="tidemark-bench",
                        conf={"spark.driver.memory": "16g"})
    qs = queries()
    pick = os.environ.get("BENCH_QUERIES")
    if pick == "all":
        names, once = [n for n in qs if n not in ONCE], [n for n in ONCE if n in qs]
    elif pick:
        chosen = [n.strip() for n in pick.split(",") if n.strip()]
        names, once = [n for n in chosen if n not in ONCE], [n for n in chosen if n in ONCE]
    else:
        names, once = HEADLINE, ONCE

    def run(name: str) -> float:
        t0 = time.perf_counter()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    for n in names:  # warm-up: JIT, file listing cache, Python imports
        run(n)
    results = {}
    for n in names:
        results[n] = round(statistics.median(run(n) for _ in range(repeat)), 3)
    from tidemark.sources.tables import Tables
    from tidemark.streaming.incremental import replay_chain, stage_chain
    for n in once:
        landed = stage_chain(spark, Tables(spark, sf_dir))
        t0 = time.perf_counter()
        replay_chain(spark, landed).user_stats().write.format("noop").mode("overwrite").save()
        results[n] = round(time.perf_counter() - t0, 3)
    extra = {"batch_jobs_sec": round(sum(v for k, v in results.items() if k not in ONCE), 3)}
    if "incremental_user_stats" in results:
        # change rows streamed: one create per user, create + final event per order
        t = Tables(spark, sf_dir)
        n_rows = t.customer.count() + 2 * t.orders.count()
        extra["incremental_change_rows"] = n_rows
        extra["incremental_rows_per_sec"] = round(n_rows / results["incremental_user_stats"], 1)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "sum_of_median_query_seconds", "value": round(sum(results.values()), 3),
                      "unit": "sec", "queries": results, "sf": float(m.group(1)) if m else None,
                      "cpus": int(cpus), "repeat": repeat, **extra}))


if __name__ == "__main__":
    main()
