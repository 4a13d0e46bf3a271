import datetime as dt

import numpy as np
import pandas as pd

from lagscope.operators import score, spatial

D0 = dt.date(2019, 1, 1)


def test_heat_points_repeat_by_weight(spark):
    w = spark.createDataFrame([(1.0, 2.0, 3), (5.0, 6.0, 0)], "lat double, lon double, weight int")
    assert sorted(tuple(r) for r in spatial.heat_points(w).collect()) == [(1.0, 2.0)] * 3


def test_heat_weights_truncate(spark):
    # one feature, z-scores known: values 0, 0, 3 -> z = -0.577, -0.577, 1.155
    df = spark.createDataFrame([(1.0, 1.0, dt.date(2018, 1, 1), 0.0), (1.0, 1.0, dt.date(2019, 1, 1), 0.0),
                                (2.0, 2.0, dt.date(2019, 1, 1), 3.0)], "lat double, lon double, date date, a double")
    out = {r.lat: r.weight for r in spatial.heat_weights(df, ["a"], year=2019).collect()}
    assert out == {1.0: 5, 2.0: 11}   # fit on all years, then filtered


def test_latest_per_site(spark):
    df = spark.createDataFrame([(1.0, 1.0, D0, 5.0), (1.0, 1.0, D0 + dt.timedelta(days=3), 7.0),
                                (2.0, 2.0, D0, 9.0)], "lat double, lon double, date date, a double")
    got = sorted(tuple(r) for r in spatial.latest_per_site(df, ["a"]).collect())
    assert got == [(1.0, 1.0, D0 + dt.timedelta(days=3), 7.0), (2.0, 2.0, D0, 9.0)]


def test_spatial_density(spark):
    df = spark.createDataFrame([(1.01, 2.04, 3), (1.04, 2.01, 1), (5.0, 6.0, 2)], "lat double, lon double, weight int")
    got = sorted(tuple(r) for r in spatial.spatial_density(df, 1, "weight").collect())
    assert got == [(1.0, 2.0, 2, 4), (5.0, 6.0, 1, 2)]


def _brute_cost(pdf, price, lag, latest_priced=False):
    cols = ["a", "b"]
    pdf = pdf.sort_values(["lat", "lon", "date"]).copy()
    for c in cols:
        pdf[c + "_s"] = pdf.groupby(["lat", "lon"])[c].transform(
            lambda s: s.rolling(2 * lag + 1, center=True, min_periods=1).mean())
    sc = [c + "_s" for c in cols]
    z = (pdf[sc] - pdf[sc].mean()) / pdf[sc].std(ddof=1)
    pdf["norm"] = np.sqrt((z ** 2).sum(axis=1))
    pz = price.copy()
    pz["price_norm"] = ((pz.price - pz.price.mean()) / pz.price.std(ddof=1)).abs()
    cand = pdf[pdf.date.isin(pz.date)] if latest_priced else pdf
    latest = cand.loc[cand.groupby(["lat", "lon"]).date.idxmax()]
    j = latest.merge(pz, on="date")
    j["score"] = j.norm / j.price_norm
    return {(r.lat, r.lon): r.score for r in j.itertuples()}


def test_cost_score_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = []
    for site in range(3):
        for d in range(40 - site * 5):
            rows.append((float(site), float(site), D0 + dt.timedelta(days=d), *rng.normal(size=2)))
    pdf = pd.DataFrame(rows, columns=["lat", "lon", "date", "a", "b"])
    price = pd.DataFrame({"date": [D0 + dt.timedelta(days=d) for d in range(0, 38)],
                          "price": rng.normal(size=38) + 50})
    wide = spark.createDataFrame(pdf)
    p = spark.createDataFrame(price)
    for latest_priced in (False, True):
        got = {(r.lat, r.lon): r.score for r in
               score.cost_score(wide, ["a", "b"], p, lag=3, latest_priced=latest_priced).collect()}
        want = _brute_cost(pdf, price, 3, latest_priced)
        assert got.keys() == want.keys()
        for k in want:
            assert abs(got[k] - want[k]) < 1e-9
