"""Time the headline queries; prints one JSON line.

Each query runs twice and the second run counts.  Results go to Spark's no-op
sink, so that every row and column is computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from cutover.plans import all_queries  # noqa: E402
from cutover.session import local_session, staged  # noqa: E402

HEADLINE = [
    "flagship_reconcile_summary", "r04_positional_cells", "r08_keyed_diff", "r08_multiset_diff", "r11_sampled_match", "s01_status_summary",
    "f07_plan_types", "f12_worklist", "d05_dictionary", "d10_dictionary_subset", "l07_overflow_check", "l09_foreign_keys", "l10_key_checks",
    "t03_targets", "c06_fragments", "c08_complexity_corpus", "c12_scenarios", "q04_customer_detail", "q10_customer_order_summary",
    "q17_monthly_sales_rollup", "q18_sales_ranking", "q19_sales_by_category", "q20_merge_orders", "q24_org_chart", "q28_salary_ranking",
    "q35_sales_performance", "q37_order_summary_view", "q45_check_windows",
]


def timed(spark, folder: str, name: str) -> float:
    with staged(spark):
        started = time.perf_counter()
        all_queries()[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        timed(spark, folder, name)
        seconds[name] = round(timed(spark, folder, name), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": float(Path(folder).name.removeprefix("sf") or 0)}))
    spark.stop()


if __name__ == "__main__":
    main()
