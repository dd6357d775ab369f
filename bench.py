"""Headline timings: one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8).
Every query runs in full into the ``noop`` sink after one warm-up query.
"""

from __future__ import annotations

import json
import os
import time

from raingrid.plans import catalog, q_sources
from raingrid.session import local_session

HEADLINE = (
    "planting_advice", "mooring_table", "read_mooring_text", "read_station_csv", "describe_by",
    "complete_grid", "outer_merge", "interpolate", "gap_routed_fill", "temperature_relation_fill",
    "humidity_from_dewpoint", "wind_direction_fill", "cardinal_clean", "regression_fill",
    "month_climatology", "wind_rose_table", "correlation", "linear_trend", "sma", "acf",
    "decompose_additive", "holt_winters_additive", "holt_winters_yearly", "hw_grid_search_long",
    "offset_search", "lag_regression", "planting_calendar", "decide_monthly",
    "parse_value_codes", "exact_quantiles",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, "raingrid-bench")
    spark.sparkContext.setLogLevel("ERROR")
    table = catalog.queries()
    # The text files that some queries read are written before the clock starts.
    q_sources.mooring_files(spark, sf)
    q_sources.station_files(spark, sf)
    table["value_counts"](spark, sf).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        began = time.perf_counter()
        table[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
