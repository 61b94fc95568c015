"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the threads.
Every query is built from the raw tables and collected to a no-op sink; the better of two runs
counts, so that the first one pays for class loading and code generation.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from velotide.registry import load  # noqa: E402
from velotide.session import build_session  # noqa: E402

HEADLINES = (
    "b15_rule_counts",
    "b16_distinct_trips",
    "b16_distinct_lineitems",
    "c2_station_stats",
    "c8_crosswalk",
    "d5_hourly_zero_filled",
    "d5_user_hourly_zero_filled",
    "d7_closure_mask",
    "d8_closure_mask_as_of",
    "f6_feature_table",
    "g12_rolling_backtest",
    "g12_user_backtest",
    "g4_additive_regression",
    "i4_scored_table",
    "i8_interval_report",
    "j4_daily_errors",
    "k1_classes",
    "m3_centred_mean_shipped",
    "m15_net_flow_matrix",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = sys.argv[1:] or HEADLINES
    spark = build_session(
        "velotide-bench",
        master=f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()
    times: dict[str, float] = {}
    for key in chosen:
        runs = []
        for _run in range(2):
            began = time.perf_counter()
            queries[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        times[key] = round(min(runs), 3)
        print(f"{key}: {runs[0]:.2f}s {runs[1]:.2f}s", file=sys.stderr, flush=True)
    spark.stop()
    result = {
        "metric": "total wall time of the headline queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
