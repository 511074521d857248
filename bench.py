"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR, BENCH_CPUS and BENCH_RUNS choose tables, threads and timed runs; query
names as arguments replace the default list. Each query is built and its whole result
computed (written to the no-op sink); one untimed run warms up, the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from checks import queries
from checks.compare import session
from litrewise.placement import settled_within

HEADLINE = [
    "clean_prices",
    "national_daily_avg",
    "weekly_avg",
    "price_index",
    "dept_avg_index",
    "coord_avg_index",
    "kpis",
    "features_full",
    "split_dynamic",
    "eval_metrics",
    "model_lr",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    registered = queries.registered()
    timings: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        seconds = []
        for _ in range(runs + 1):
            started = time.perf_counter()
            with settled_within(spark):
                registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds.append(time.perf_counter() - started)
        timings[name] = round(statistics.median(seconds[1:]), 3)
    spark.stop()
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
