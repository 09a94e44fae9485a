"""Time the headline queries; prints one JSON line.

Every query runs once to warm up and then twice; the median counts. Panels are built before,
and their build time is reported as ``panels``.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "signal_metrics_panel", "momentum_signal", "carry_signal", "ic_by_date", "ic_decay_halflife", "rolling_spearman", "signal_metrics_single",
    "resample_last", "resample_sum_returns", "price_panel", "asof_signal", "flag_outliers", "rolling_zscore",
    "construct_portfolio", "net_limit_unbounded", "backtest", "walk_forward_expanding", "walk_forward_rolling",
    "return_stats", "drawdown_duration", "pbo_cscv", "spa_test", "deflated_sharpe", "vintage_as_of", "incremental_ingest", "momentum_signal_unbounded",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from isochrone.functions.spark import scratch_folder
    from isochrone.plans import QUERIES, panels, portfolio_queries, overfit_queries

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("isochrone-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        # the bench data is small: keep all cores busy instead of merging shuffle partitions up to 1 MB
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.driver.memory", "16g").config("spark.checkpoint.dir", f"file://{scratch_folder()}").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    timings: dict[str, float] = {}
    started = time.perf_counter()
    for build in ("supp_m", "supp_x", "supp_d", "rate_m", "brand_m", "nation_m", "nation_d", "prio_d", "event_h"):
        getattr(panels, build)(spark, sf_dir)
    overfit_queries.brand_returns(spark, sf_dir)
    timings["panels"] = round(time.perf_counter() - started, 3)
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    for name in names:
        runs = []
        for i in range(repeats + 1):
            t = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t)
        timings[name] = round(statistics.median(runs[1:]), 3)
        print(name, [round(r, 2) for r in runs], file=sys.stderr, flush=True)
    total = round(sum(v for k, v in timings.items()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": timings, "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", "")}))


if __name__ == "__main__":
    main()
