"""Headline queries, warm, median of three; prints one JSON line.

``BENCH_SF_DIR`` names the data (default sf0.1), ``BENCH_CPUS`` the local cores.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from panelweave.catalog import QUERIES  # noqa: E402
from panelweave.session import get_spark  # noqa: E402

HEADLINE = [
    "w01_grouped_lag",
    "w12_cross_series",
    "w14_fill_both_ways",
    "w18_monthly_interpolation",
    "a01_date_statistics",
    "a04_interval_allocation",
    "a16_describe_whole",
    "a26_boxplot",
    "f08_landed_eur_price",
    "j01_full_join_rates",
    "c02_spearman_lines",
    "c04_lagged_corr",
    "c08_autocorrelation",
    "c10_decomposition",
    "m01_adaptive_split",
    "m05_weights_balanced",
    "m18_ar1_baseline",
    "silver_europe_grouped",
    "silver_asia_grouped",
    "gold_long_h3",
    "gold_wide_h3",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = get_spark(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in names:
        times = []
        for _ in range(repeats + 1):  # the first run warms up
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        took[name] = round(statistics.median(times[1:]), 3)
        print(name, took[name], file=sys.stderr, flush=True)
    spark.stop()
    out = {
        "metric": "sum of warm medians",
        "value": round(sum(took.values()), 3),
        "unit": "sec",
        "queries": took,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(out))


if __name__ == "__main__":
    main()
