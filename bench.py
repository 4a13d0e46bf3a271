"""Benchmark the headline queries and print ONE JSON line.

Environment: ``BENCH_SF_DIR`` (default /root/testdata/sf0.1), ``BENCH_CPUS``
(default 8, the ``local[N]`` width), ``BENCH_RUNS`` (warm runs, default 3).

Each query is timed from building its plan over the Parquet tables to the
result collected on the driver: once cold (its first execution, after one
untimed JVM warm-up query) and ``BENCH_RUNS`` times warm; the reported
per-query value is the best warm time, with the median beside it.

Two further steps: ``csv`` runs the price correlation from raw CSV files of the
same measurements (the reference's slow runs read CSV), and ``larger`` repeats
two queries on ``BENCH_COPIES`` (default 4) copies of lineitem with shifted
keys, which shows how time grows with the data.  ``tlcc_8`` / ``tlcc_64`` /
``tlcc_112`` are the correlation shapes of the reference's timing table
(4 x 1 x 2, 4 x 4 x 4, 4 x 4 x 7).
"""

from __future__ import annotations

import json
import os
import re
import shutil
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "tlcc_8", "tlcc_64", "tlcc_112",          # the reference's timing shapes
    "tlcc_price", "tlcc_by_site", "tlcc_calendar",
    "cost_score", "heatmap_weights", "zscore_maxabs_chain", "clean_measurements",
]


def timed(f) -> float:
    t = time.time()
    f().toArrow()
    return round(time.time() - t, 3)


def csv_step(spark, sf_dir: str) -> dict[str, float]:
    """The price correlation from raw CSV: scan, typing, pivot, all lags."""
    from lagscope.operators import reshape, series, xcorr
    from lagscope.plans.catalog import FLAGS, PRICE_LAGS, prices
    from lagscope.sources import measurements, tables

    folder = tempfile.mkdtemp(prefix="lagscope-bench-")
    try:
        raw = tables.lineitem_raw_measurements(spark, sf_dir).drop("Site Num")
        raw.write.option("header", True).csv(f"{folder}/raw")
        paths = measurements.resolve_paths(spark, [f"{folder}/raw/*.csv"])

        def run():
            long = measurements.normalize_measurements(measurements.read_raw_measurements(spark, paths))
            d = series.daily_mean(reshape.pivot_wide(long, FLAGS), FLAGS)
            return xcorr.lagged_correlation(d, prices(spark, sf_dir), PRICE_LAGS, FLAGS, ["price"])

        return {"cold": timed(run), "warm": min(timed(run) for _ in range(2))}
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def larger_step(spark, sf_dir: str) -> dict[str, float]:
    """Best of two on so many copies of lineitem; the other tables as they are."""
    from pyspark.sql import functions as F

    from lagscope.plans.catalog import QUERIES

    copies = int(os.environ.get("BENCH_COPIES", "4"))
    folder = tempfile.mkdtemp(prefix="lagscope-bench-")
    try:
        for name in os.listdir(sf_dir):
            if name != "lineitem.parquet":
                os.symlink(os.path.join(sf_dir, name), os.path.join(folder, name))
        li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
        shifted = li.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
        (shifted.withColumn("l_orderkey", F.col("l_orderkey") + F.col("k").cast("long") * 1_000_000_000).drop("k")
         .write.parquet(f"{folder}/lineitem.parquet"))
        out = {"copies": copies}
        for name in ("tlcc_8", "tlcc_price"):
            QUERIES[name](spark, folder).toArrow()
            out[name] = min(timed(lambda: QUERIES[name](spark, folder)) for _ in range(2))
        return out
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    from lagscope.plans.catalog import QUERIES
    from lagscope.session import build_session

    t0 = time.time()
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=cpus, app="lagscope-bench")
    startup = time.time() - t0
    # the benchmark tables are one row group each: deal the scan to all cores
    spark.conf.set("lagscope.scan.partitions", str(cpus))
    # one untimed pass warms the JVM (class loading, JIT, codegen caches);
    # reported separately, like the warm-up runs of the reference's table
    t = time.time()
    QUERIES[HEADLINE[0]](spark, sf_dir).toArrow()
    warmup = time.time() - t
    cold, warm, middle, rows = {}, {}, {}, {}
    for name in HEADLINE:
        times = []
        for i in range(runs + 1):
            t = time.time()
            out = QUERIES[name](spark, sf_dir).toArrow()   # collected to the driver (Arrow batches)
            times.append(time.time() - t)
        rows[name] = out.num_rows
        cold[name] = round(times[0], 3)
        warm[name] = round(min(times[1:]), 3)
        middle[name] = round(statistics.median(times[1:]), 3)
    extra = {"csv": csv_step(spark, sf_dir), "larger": larger_step(spark, sf_dir)}
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_total_warm",
        "value": round(sum(warm.values()), 3),
        "unit": "sec",
        "queries": warm,
        "median": middle,
        "cold": cold,
        **extra,
        "cold_total": round(sum(cold.values()), 3),
        "rows": rows,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
        "session_startup_sec": round(startup, 3),
        "jvm_warmup_sec": round(warmup, 3),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
