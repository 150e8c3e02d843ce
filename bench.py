"""Time the headline queries; prints one JSON line.

Each query is written to Spark's no-op sink, twice; the better time counts.
"""

from __future__ import annotations

import json
import os
import time

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
QUERIES = (
    "downsample_events", "bucket_1h_avg", "first_last", "rate_by_user", "native_moving_average", "rolling_std", "zscore", "asof_join", "lww_dedup", "last_value", "rollup_hourly",
    "detect_zscore", "detect_iqr", "detect_moving_average", "forecast_ses", "forecast_arima", "stl_decompose", "promql_rate", "promql_agg_sum", "promql_group_left",
    "join_inner", "grouping_cube", "topk_per_group", "window_rank", "tpch_q1", "tpch_q5",
)


def main() -> None:
    from tempora import catalog
    from tempora.session import local_session

    spark = local_session(cores=CPUS, shuffle_partitions=int(CPUS))
    times = {}
    for name in QUERIES:
        best = None
        for _ in range(2):
            began = time.perf_counter()
            catalog.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - began
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
