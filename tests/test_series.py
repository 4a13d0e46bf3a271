import datetime as dt

import numpy as np
import pandas as pd
import pytest
from conftest import approx_list

from lagscope.operators import series


def _daily(spark, vals, start=dt.date(2019, 1, 1), site=0):
    return spark.createDataFrame(
        [(site, start + dt.timedelta(days=i), float(v)) for i, v in enumerate(vals)], "site int, date date, v double")


def _ordered(df, col):
    return [r[col] for r in df.orderBy("site", "date").collect()]


def test_sma_centered(spark):
    out = series.sma(_daily(spark, [1, 2, 4, 8, 16]), ["site"], ["v"], periods=1)
    approx_list(_ordered(out, "v_sma1"), [1.5, 2.3333333333, 4.6666666667, 9.3333333333, 12.0])


def test_sma_trailing_full_windows_only(spark):
    vals = [1, 2, 4, 8, 16, 32, 64, 128]
    out = _ordered(series.sma(_daily(spark, vals), ["site"], ["v"], periods=7, trailing=True), "v_ma7")
    ret = np.cumsum(vals, dtype=float)
    ret[7:] = ret[7:] - ret[:-7]
    expected = list(ret[6:] / 7)
    assert out[:6] == [None] * 6
    approx_list(out[6:], expected)


def test_shift(spark):
    df = _daily(spark, [1, 2, 3, 4])
    approx_list(_ordered(series.shift(df, ["site"], "v", 1), "v_shift1"), [1, 2, 3])
    approx_list(_ordered(series.shift(df, ["site"], "v", 1, pad=0.0), "v_shift1"), [0, 1, 2, 3])
    approx_list(_ordered(series.shift(df, ["site"], "v", -1), "v_shift-1"), [2, 3, 4])
    approx_list(_ordered(series.shift(df, ["site"], "v", -1, pad=0.0), "v_shift-1"), [2, 3, 4, 0])


def test_ema_span3(spark):
    out = series.ema(_daily(spark, [1, 2, 4]), ["site"], ["v"], span=3)
    approx_list(_ordered(out, "v_ema"), [1.0, 1.6666666667, 3.0])


def test_ema_matches_pandas_on_longer_series(spark):
    rng = np.random.default_rng(1)
    vals = rng.normal(size=200)
    out = _ordered(series.ema(_daily(spark, vals), ["site"], ["v"], span=5), "v_ema")
    approx_list(out, list(pd.Series(vals).ewm(span=5).mean()), tol=1e-12)


@pytest.mark.parametrize("span", [1, 1.5, 3, 40, 4000])
def test_ema_over_chunks_gaps_and_groups(spark, span):
    rng = np.random.default_rng(2)
    vals = [None if rng.random() < 0.2 else float(v) for v in rng.normal(size=1300)]
    vals[:3] = [None, None, 5.0]
    rows = [(s, dt.date(2015, 1, 1) + dt.timedelta(days=i), v) for s in (0, None) for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "site int, date date, v double").repartition(3)
    out = series.ema(df, ["site"], ["v"], span=span)
    want = pd.Series(vals, dtype="float64").ewm(span=span).mean()
    for s in (0, None):
        got = [r.v_ema for r in sorted(out.collect(), key=lambda r: r.date) if r.site == s]
        approx_list(got, [None if np.isnan(x) else x for x in want], tol=1e-9)


def test_ema_national_series(spark):
    out = series.ema(_daily(spark, [1, 2, 4]).drop("site"), [], ["v"], span=3)
    approx_list([r.v_ema for r in out.orderBy("date").collect()], [1.0, 1.6666666667, 3.0])


def test_gradient(spark):
    out = series.gradient(_daily(spark, [1, 2, 4, 8, 16]), ["site"], ["v"])
    approx_list(_ordered(out, "v_grad"), [0.05415304, 0.08122955, 0.16245911, 0.32491822, 0.43322429], tol=1e-8)
    x = np.array([1, 2, 4, 8, 16.0])
    approx_list(_ordered(out, "v_grad"), list(np.gradient(x) / np.sqrt(np.sum(x ** 2))), tol=1e-15)


def test_deseason_day_of_month(spark):
    df = spark.createDataFrame([(dt.date(2019, 1, 1), 2.0), (dt.date(2019, 2, 1), 4.0), (dt.date(2019, 1, 2), 7.0)],
                               "date date, v double")
    out = {r.date: r.v for r in series.deseason(df, "v", "date", "daily").collect()}
    assert out == {dt.date(2019, 1, 1): -1.0, dt.date(2019, 2, 1): 1.0, dt.date(2019, 1, 2): 0.0}


def test_deseason_drops_null_bucket_and_rejects_unknown(spark):
    df = spark.createDataFrame([(dt.date(2019, 1, 1), 2.0), (None, 4.0)], "date date, v double")
    assert series.deseason(df, "v", "date", "monthly").count() == 1
    with pytest.raises(ValueError):
        series.deseason(df, "v", "date", "weekly")


def test_daily_mean_and_climatology(spark):
    df = spark.createDataFrame([
        (dt.date(2019, 1, 1), 1.0), (dt.date(2019, 1, 1), 3.0), (dt.date(2020, 1, 1), 6.0)], "date date, a double")
    d = {r.date: (r.a, r.year, r.dayofyear) for r in series.daily_mean(df, ["a"]).collect()}
    assert d[dt.date(2019, 1, 1)] == (2.0, 2019, 1)
    c = series.climatology(series.daily_mean(df, ["a"]), ["a"]).collect()
    assert [(r.dayofyear, r.a) for r in c] == [(1, 4.0)]


def test_bucket_mean_hourly(spark):
    df = spark.createDataFrame([(0, dt.datetime(2024, 1, 1, 3, 5), 1.0), (0, dt.datetime(2024, 1, 1, 3, 55), 3.0),
                                (0, dt.datetime(2024, 1, 1, 4, 0), 7.0)], "site int, ts timestamp, v double")
    got = sorted((r.ts.hour, r.v) for r in series.bucket_mean(df, ["site"], ["v"], "ts", "hour").collect())
    assert got == [(3, 2.0), (4, 7.0)]
