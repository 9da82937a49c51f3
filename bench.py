"""Wall time of catalogue queries, as one JSON line.

BENCH_SF_DIR   table folder (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_QUERIES  comma-separated names, or "all" (default: the headline list below)
"""

from __future__ import annotations

import json
import os
import sys
import time

from panelcast.plans.catalogue import QUERIES
from panelcast.session import build_session

HEADLINE = [
    "P1P2_parse", "C2_clean_panel", "P5_profile", "P6_validation", "P7_quality", "S1_csv", "S12_increments",
    "A2_summary", "A3_demand_stats", "A7_resample_month", "J7_gap_fill", "A9_box", "A11_corr", "A12_acf", "A12_pacf", "A13_iqr",
    "F2_lag", "F3_rolling", "F5_windows", "X4_split", "Z3_standard", "T2_top_products",
    "M4_ar1", "M17_submission", "A14_metrics", "K3_pivot", "M4_arima", "M2_windows_linear", "M3_recursive", "M6_residual", "M8_hybrid",
    "I5_recommend", "I6_projection", "I8_stockout", "L11_report", "R4_merge",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if wanted == "all" else wanted.split(",") if wanted else HEADLINE
    spark = build_session(
        "panelcast-bench",
        **{
            "spark.master": f"local[{cpus}]", "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g",
            "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()  # start executors and the reader
    seconds = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total wall time of the headline queries" if names == HEADLINE else "total wall time",
        "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
