"""Times the headline queries and prints one JSON line.

Reports and metrics read line and order tables that are written once; that is timed as its own entry and is part of
the total. Staging and fact queries run from the raw feeds.

BENCH_SF_DIR  folder with the parquet tables (default /root/testdata/sf0.1)
BENCH_CPUS    cores of the local session (default: all)
BENCH_QUERIES comma-separated names instead of the headline list
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from catalogue.queries import QUERIES, prepare  # noqa: E402
from tillmark.session import local_session  # noqa: E402

HEADLINE = [
    "rpt_monthly_sales",
    "rpt_monthly_category_margin",
    "rpt_monthly_marketing",
    "rpt_monthly_delivery",
    "rpt_top_products",
    "rpt_ledger_reconciliation",
    "q_running_total",
    "q_rank_within_group",
    "q_cohort_retention",
    "q_period_over_period",
    "q_dedup_audit",
    "metric_simple",
    "metric_ratio",
    "metric_multi_fact",
    "metric_by_dimension",
    "metric_filters",
    "metric_date_range",
    "stg_pos_lines",
    "int_sales_lines",
    "fct_sales_lines",
    "fct_orders",
    "dim_products",
    "scan_union_by_name",
    "dq_unique",
    "dq_relationships",
    "dq_freshness",
    "dq_results",
    "recon_raw_vs_ledger",
    "recon_orders_vs_shipments",
    "naive_monthly_sales",
    "weekly_best_worst_channel",
    "grounding_check",
    "score_answers",
    "score_summary",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(cores=cores, partitions=cores, app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/region.parquet").count()
    times: dict[str, float] = {}
    start = time.perf_counter()
    prepare(spark, folder)
    times["write_marts_and_landing"] = round(time.perf_counter() - start, 3)
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    sf = Path(folder).name.removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
