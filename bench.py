"""Times the headline event-log queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the data and the cores.  Every
query is run once to warm up and then timed; its value is the least of BENCH_REPEATS (default 2) runs.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "traces_order_lines", "prevalence_user_days", "prevalence_customer_orders", "prevalence_order_lines", "prevalence_users",
    "measures_customer_orders_positive", "label_permutation_test", "permuted_traces", "support_confidence", "calibrated_threshold",
    "fisher_scores", "frequent_itemsets", "feature_scores", "fdr_step_up", "q_values", "null_share_adaptive",
]


def permutation_2000(spark, sf_dir):
    """The unsigned difference test with 2000 label permutations."""
    from tracegauge.operators import measures, tests_of_difference
    from tracegauge.operators.statistics import alphabet
    from tracegauge.plans import logs

    t = logs.user_days(spark, sf_dir)
    return tests_of_difference.difference_test(t, measures.candidates(alphabet(t)), 2000)


def main() -> None:
    from pyspark.sql import SparkSession

    from tracegauge.plans import catalog

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g")).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="bench-")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    todo = {n: catalog.queries()[n] for n in HEADLINE} | {"permutation_2000": permutation_2000}
    took: dict[str, float] = {}
    for name, f in todo.items():
        runs = []
        for i in range(1 + int(os.environ.get("BENCH_REPEATS", "2"))):
            began = time.perf_counter()
            f(spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(min(runs[1:] or runs), 3)
        print(f"{name}: {took[name]}", file=sys.stderr)
    spark.stop()
    print(json.dumps({"metric": "total seconds of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
