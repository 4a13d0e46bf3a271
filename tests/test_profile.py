"""One-pass profile: merged moments against the direct statistics, one scan."""

import numpy as np
import pytest
from fixtures import write_tree
from pyspark.sql import functions as F

from lagscope.operators import clean, profile, reshape, scale
from lagscope.plans import jobs
from lagscope.sources import measurements


def test_moments_merge_to_the_whole(spark):
    rng = np.random.default_rng(1)
    rows = [(int(k), None if rng.random() < 0.1 else float(1e9 + v), None) for k, v in
            zip(rng.integers(0, 40, 2000), rng.normal(size=2000))]
    rows += [(50, 5.0, None), (None, 7.0, None), (None, 9.0, None)]
    df = spark.createDataFrame(rows, "k int, v double, w double").repartition(5)
    df = df.withColumn("g", F.when(F.col("k") < 20, F.col("k") % 3))
    parts = profile.moments(df, ["g", "k"], ["v", "w"])
    got = {r.column: r for r in profile.merged(parts, ["v", "w"]).collect()}
    want = {r.column: r for r in profile.summary(df, ["v", "w"]).collect()}
    assert (got["v"]["count"], got["v"]["min"], got["v"]["max"]) == (want["v"]["count"], want["v"]["min"], want["v"]["max"])
    assert got["v"]["mean"] == pytest.approx(want["v"]["mean"], rel=1e-12)
    assert got["v"]["stddev"] == pytest.approx(want["v"]["stddev"], rel=1e-9)
    assert tuple(got["w"])[1:] == (0, None, None, None, None)
    by = {r.g: r for r in profile.merged(parts, ["v"], ["g"]).collect()}
    direct = df.groupBy("g").agg(F.count("v").alias("n"), F.avg("v").alias("m"), F.stddev_samp("v").alias("s")).collect()
    assert set(by) == {r.g for r in direct} and None in by
    for r in direct:
        assert by[r.g]["count"] == r.n and by[r.g]["mean"] == pytest.approx(r.m, rel=1e-12)
        assert by[r.g]["stddev"] == pytest.approx(r.s, rel=1e-6)


def test_profile_reads_the_files_once(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "air")
    write_tree(root)
    seen = spark.sparkContext.accumulator(0)
    real = measurements.read_measurements
    long = real(spark, root, ["gasses/*"], [2019])
    rows = long.count()

    def counted(*args):
        df = real(*args)

        def count(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        return df.mapInArrow(count, df.schema)

    monkeypatch.setattr(measurements, "read_measurements", counted)
    got = jobs.profile_dataset(spark, root, [2019])
    tables = {k: df.collect() for k, df in got.items()}
    assert seen.value == rows > 0
    # the same tables as asked of the raw rows one by one
    want = {r.column: r for r in profile.summary(long, ["lat", "lon", "value"]).collect()}
    for r in tables["summary"]:
        assert r["count"] == want[r.column]["count"] and r["min"] == want[r.column]["min"] and r["max"] == want[r.column]["max"]
        assert r["mean"] == pytest.approx(want[r.column]["mean"], rel=1e-12)
        assert r["stddev"] == pytest.approx(want[r.column]["stddev"], rel=1e-9)
    assert sorted(tables["units"]) == sorted(profile.distinct_units(long).collect())
    assert sorted(tables["criteria"]) == sorted(clean.distinct_values(long, "criteria").collect())
    wide, _, labels = reshape.discover_pivot(long)
    plain = {(r.lat, r.lon, r.date): r for r in scale.zscore_max_abs(wide, labels).collect()}
    assert len(plain) == len(tables["scaled"])
    for r in tables["scaled"]:
        for c in labels:
            assert r[c] == pytest.approx(plain[(r.lat, r.lon, r.date)][c], abs=1e-9)
    assert {(r.criteria, r.unit) for r in tables["by_criterion"]} == {
        (r.criteria, r.unit) for r in long.select("criteria", "unit").distinct().collect()}
