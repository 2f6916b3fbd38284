"""Headline queries, timed. Prints one JSON line.

BENCH_SF_DIR is the folder of tables (default /root/testdata/sf0.1), BENCH_CPUS the number of cores (default 8).
Every query is planned and run to its last row without fetching the rows; the first run warms up, the second counts.
"""

from __future__ import annotations

import json
import os
import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

from tallywell.queries import REGISTRY  # noqa: E402
from tallywell.session import build_session  # noqa: E402

HEADLINE = [
    "monthly_order_rate",
    "coarser_periods",
    "carried_forward",
    "monthly_facts",
    "employment_measures",
    "headcount_by_dimension",
    "rolled_up_values",
    "registry_summary",
    "dimension_trend",
    "top_values_and_other",
    "movers",
    "percent_positive",
    "rolling_four_quarters",
    "geographic_distribution",
    "matched_units",
    "rosters",
    "career_timelines",
    "average_ranks",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cores}]",
        **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": cores,
           "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g")},
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds, cold = {}, {}
    for name in HEADLINE:
        for kept in (cold, seconds):
            started = time.perf_counter()
            REGISTRY[name].run(spark, folder).write.format("noop").mode("overwrite").save()
            kept[name] = round(time.perf_counter() - started, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline queries, total of warm runs", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "cold": cold, "sf": pathlib.Path(folder).name.removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
