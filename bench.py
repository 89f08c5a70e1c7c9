"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose data and cores; query names (or
prefixes) on the command line replace the headline set.
"""

from __future__ import annotations

import json
import os
import sys
import time

from evalframe.plans import load_all
from evalframe.plans.registry import QUERIES
from evalframe.runtime import drop_scratch, session

HEADLINE = [
    "Q13_prepare",
    "R02_pair_queries",
    "X04_split_instances",
    "X05_split_aligned",
    "M05_roc_auc",
    "M09_brier_score",
    "M12_all_metrics",
    "M15_baselines_total",
    "M19_test_report",
    "M20_test_report_per_task",
    "M21_stats_sweep",
    "M28_accuracy_bounds",
    "C03_report_in_distribution",
    "K02_order_faults",
    "K05_shot_violations",
    "A02_assessor_report",
    "A02_newton_report",
    "S01_logs_to_report",
    "S01_scan_queries",
    "C24_token_histogram",
    "Q10_describe_columns",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    load_all()
    wanted = sys.argv[1:]
    names = [n for n in QUERIES if any(n.startswith(w) for w in wanted)] if wanted else HEADLINE
    spark = session("bench", f"local[{cpus}]", shuffle_partitions=int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["M01_accuracy"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up: a join and an aggregation
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    sf = float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"))
    drop_scratch(spark)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
