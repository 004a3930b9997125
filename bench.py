"""Wall-clock of the headline queries, one JSON line.

Each query runs once cold, then ``BENCH_RUNS`` times; the median counts. Two
queries are also timed in the form they replace: one filtered aggregate per
subgroup and level, and a window over the whole table.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession, Window, functions as F  # noqa: E402

from registry import QUERIES, reports  # noqa: E402
from registry.views import assessment  # noqa: E402
from tallymark.operators.settle import clear_settled, settle  # noqa: E402
from tallymark.plans.reports import LEVELS, growth_rates, report_subgroups  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
MEMORY = os.environ.get("BENCH_MEMORY", "16g")

HEADLINE = [
    "best_record", "student_year_max", "growth_standards", "student_growth", "student_table", "subgroup_rates",
    "indicator_output", "release_table", "reconcile_mismatch", "duplicate_audit", "flag_lookup",
    "carry_forward_records",
]


def rates_by_expansion(spark, sf_dir, students):
    return growth_rates(students)


def rates_by_filters(spark, sf_dir, students):
    parts = [
        growth_rates(students.where(condition), {level: keys}, subgroups=[(label, F.lit(True))])
        for level, keys in LEVELS.items()
        for label, condition in report_subgroups()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def carry_by_global_window(spark, sf_dir, _):
    w = Window.orderBy("school", "id", "k1", "k2", "k3", "k4").rowsBetween(Window.unboundedPreceding, 0)
    return assessment(spark, sf_dir).select("school", "id", F.last("pl_comp", ignorenulls=True).over(w).alias("carried"))


def measure(make) -> float:
    times = []
    for _ in range(RUNS + 1):
        start = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        times.append(time.perf_counter() - start)
    return round(statistics.median(times[1:]), 3)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", MEMORY)
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {q: measure(lambda q=q: QUERIES[q](spark, SF_DIR)) for q in HEADLINE}

    students = settle(reports.students(spark, SF_DIR))
    compared = {
        "rates_by_expansion": lambda: rates_by_expansion(spark, SF_DIR, students),
        "rates_by_filters": lambda: rates_by_filters(spark, SF_DIR, students),
        "carry_by_global_window": lambda: carry_by_global_window(spark, SF_DIR, students),
    }
    alternatives = {q: measure(make) for q, make in compared.items()}
    clear_settled(spark)
    print(json.dumps({
        "metric": "headline queries, sum of medians",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "compared_forms": alternatives,
        "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
        "cores": int(CPUS),
        "driver_memory": MEMORY,
        "shuffle_partitions": int(CPUS),
        "warm_runs": RUNS,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
