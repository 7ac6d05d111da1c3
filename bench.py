"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the cores.  Each query is written to
the `noop` sink, so nothing it returns is pruned; a warm-up run of a small
query comes first, each figure is the better of two runs.
"""

from __future__ import annotations

import json
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = f"{HERE}:{os.environ.get('PYTHONPATH', '')}"
os.environ.setdefault("OMP_NUM_THREADS", "1")

HEADLINE = [
    "mp_self_norm_k1", "mp_self_norm_topk", "mp_left_right", "mp_self_raw_k1", "mp_self_raw_topk", "mp_ab_norm",
    "mp_by_series", "mp_nonfinite_windows", "mp_sql_tier", "mp_long_series", "mass_norm", "mass_long_series",
    "match_default_threshold", "match_topk", "discords_top10", "pan_binary", "rolling_mean_std", "window_is_constant",
]


def main() -> None:
    from pyspark.sql import SparkSession

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from tessella.queries import QUERIES

    QUERIES["mp_self_norm_k1"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):
            t = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - t)
            if runs[0] > 30:
                break
        took[name] = round(min(runs), 3)
    n = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    l = n - 50 + 1
    rate = l * l / took["mp_long_series"]
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cores": int(cpus),
        "mp_long_series": {"n": n, "m": 50, "k": 1, "pairs_per_second": round(rate)},
    }))


if __name__ == "__main__":
    main()
