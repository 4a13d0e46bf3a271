import datetime as dt

import numpy as np
from conftest import approx_list

from lagscope.operators import xcorr

D0 = dt.date(2019, 1, 1)


def _wide(spark, cols: dict, days=None, by=None):
    n = len(next(iter(cols.values())))
    days = days or [D0 + dt.timedelta(days=i) for i in range(n)]
    names = list(cols)
    data = [((by,) if by is not None else ()) + (days[i], *[float(cols[c][i]) for c in names]) for i in range(n)]
    schema = ("site int, " if by is not None else "") + "date date, " + ", ".join(f"{c} double" for c in names)
    return spark.createDataFrame(data, schema)


def _by_lag(df):
    return {r.lag: r for r in df.collect()}


def test_tlcc_hand_computed(spark):
    x = _wide(spark, {"x": [1, 2, 4, 8, 16]})
    y = _wide(spark, {"y": [3, 1, 2, 5, 4]})
    out = _by_lag(xcorr.lagged_correlation(x, y, [-2, -1, 0, 1, 2], ["x"], ["y"]))
    approx_list([out[lag].r for lag in (-2, -1, 0, 1, 2)],
                [-0.3273268354, 0.7408237819, 0.6221710168, 0.7077213895, 0.5])
    assert [out[lag].n for lag in (-2, -1, 0, 1, 2)] == [3, 4, 5, 4, 3]


def _array_tlcc(a, b, lag):
    """Reference definition: x[i] paired with y[i + lag]."""
    n = len(a)
    pairs = [(a[i], b[i + lag]) for i in range(n) if 0 <= i + lag < n]
    xs, ys = zip(*pairs)
    return np.corrcoef(xs, ys)[0, 1]


def test_tlcc_matches_array_definition(spark):
    rng = np.random.default_rng(7)
    a, b, c = rng.normal(size=(3, 60))
    x = _wide(spark, {"a": a, "b": b})
    y = _wide(spark, {"c": c})
    lags = [-7, -3, 0, 2, 9]
    out = xcorr.lagged_correlation(x, y, lags, ["a", "b"], ["c"]).collect()
    assert len(out) == 2 * 1 * len(lags)
    src = {"a": a, "b": b}
    for r in out:
        assert abs(r.r - _array_tlcc(src[r.series_x], c, r.lag)) < 1e-12


def test_positions_count_joined_days_only(spark):
    days = [D0 + dt.timedelta(days=i) for i in (0, 1, 5, 6, 9)]
    x = _wide(spark, {"x": [1, 2, 4, 8, 16]}, days=days)
    y = _wide(spark, {"y": [3, 1, 2, 5, 4]}, days=days)
    out = _by_lag(xcorr.lagged_correlation(x, y, [2], ["x"], ["y"]))
    assert abs(out[2].r - 0.5) < 1e-12
    cal = xcorr.lagged_correlation(x, y, [1], ["x"], ["y"], unit="days").collect()
    assert len(cal) == 1 and cal[0].n == 2  # (day0,day1) and (day5,day6)


def test_invariants(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(2, 40))
    w = _wide(spark, {"a": a, "b": b})
    lags = [-5, 0, 5]
    auto = {(r.series_x, r.series_y, r.lag): r.r for r in xcorr.auto_correlation(w, lags, ["a", "b"]).collect()}
    assert len(auto) == 2 * 2 * len(lags)                      # |X| |Y| |lags|
    assert abs(auto[("a", "a", 0)] - 1.0) < 1e-12              # r(x, x, 0) = 1
    assert abs(auto[("a", "b", 0)] - auto[("b", "a", 0)]) < 1e-12
    for lag in lags:                                           # r(x, y, l) = r(y, x, -l)
        assert abs(auto[("a", "b", lag)] - auto[("b", "a", -lag)]) < 1e-12
    scaled = _wide(spark, {"a": a * 3.5 + 10, "b": b})         # affine invariance
    sc = {(r.series_x, r.series_y, r.lag): r.r for r in xcorr.auto_correlation(scaled, lags, ["a", "b"]).collect()}
    for k, v in auto.items():
        assert abs(sc[k] - v) < 1e-12


def test_constant_series_gives_null(spark):
    x = _wide(spark, {"x": [1, 1, 1, 1]})
    y = _wide(spark, {"y": [1, 2, 3, 4]})
    assert xcorr.lagged_correlation(x, y, [0], ["x"], ["y"]).first().r is None


def test_incomplete_rows_are_not_days(spark):
    x = spark.createDataFrame([(D0 + dt.timedelta(days=i), float(i), None if i == 2 else float(i * i))
                               for i in range(6)], "date date, a double, b double")
    y = _wide(spark, {"y": [5, 3, 2, 8, 1, 0]})
    out = {r.series_x: r.n for r in xcorr.lagged_correlation(x, y, [0], ["a", "b"], ["y"]).collect()}
    assert out == {"a": 5, "b": 5}


def test_by_site_equals_separate_runs(spark):
    rng = np.random.default_rng(11)
    a0, a1, p = rng.normal(size=(3, 30))
    x = _wide(spark, {"a": a0}, by=0).unionByName(_wide(spark, {"a": a1}, by=1))
    y = _wide(spark, {"p": p}, by=0).unionByName(_wide(spark, {"p": p}, by=1))
    out = {(r.site, r.lag): r.r for r in xcorr.lagged_correlation(x, y, [-2, 0, 3], ["a"], ["p"], by=["site"]).collect()}
    for site, a in ((0, a0), (1, a1)):
        for lag in (-2, 0, 3):
            assert abs(out[(site, lag)] - _array_tlcc(a, p, lag)) < 1e-12


def test_correlation_matrix_family(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=50)
    b = a * 0.9 + rng.normal(size=50) * 0.1
    c = rng.normal(size=50)
    w = _wide(spark, {"a": a, "b": b, "c": c})
    cm = xcorr.correlation_matrix(w, ["a", "b", "c"])
    got = {(r.series_a, r.series_b): r.r for r in cm.collect()}
    ref = np.corrcoef([a, b, c])
    names = ["a", "b", "c"]
    assert len(got) == 9
    for i, s in enumerate(names):
        for j, t in enumerate(names):
            assert abs(got[(s, t)] - ref[i, j]) < 1e-12
    mass = {r.series_a: r.mass for r in xcorr.correlation_mass(cm).collect()}
    np.fill_diagonal(ref, 0)
    for i, s in enumerate(names):
        assert abs(mass[s] - np.linalg.norm(ref[i], 1)) < 1e-12
    adj = {(r.series_a, r.series_b): r.adj for r in xcorr.adjacency(cm, 0.8).collect()}
    assert adj[("a", "b")] == 1 and adj[("a", "a")] == 0 and adj[("a", "c")] == 0


def test_many_series_spread_path(spark):
    rng = np.random.default_rng(21)
    cols = {f"s{i}": rng.normal(size=45) for i in range(9)}
    w = _wide(spark, cols)
    lags = [-4, -2, 0, 1, 3]
    out = xcorr.auto_correlation(w, lags, list(cols)).collect()
    assert len(out) == 9 * 9 * 5
    for r in out[:40]:
        assert abs(r.r - _array_tlcc(cols[r.series_x], cols[r.series_y], r.lag)) < 1e-12


def test_correlation_matrix_keeps_pairs_without_overlap(spark):
    rows = [(D0 + dt.timedelta(days=i), float(i), float(i * i) if i < 4 else None, None if i < 4 else float(i))
            for i in range(8)]
    w = spark.createDataFrame(rows, "date date, a double, b double, c double")
    got = {(r.series_a, r.series_b): r.r for r in xcorr.correlation_matrix(w, ["a", "b", "c"]).collect()}
    assert len(got) == 9
    assert got[("b", "c")] is None and got[("c", "b")] is None       # b and c never overlap
    assert abs(got[("a", "c")] - 1.0) < 1e-12


def test_every_cell_has_a_row(spark):
    x = _wide(spark, {"a": [1.0, 2.0, 3.0], "b": [2.0, 1.0, 5.0]}, by=0).unionByName(
        _wide(spark, {"a": [1.0], "b": [1.0]}, by=1).selectExpr("site", "date", "a", "nullif(b, 1.0) AS b"))
    y = _wide(spark, {"p": [1.0, 5.0, 2.0]}, by=0)
    for unit in ("rows", "days"):
        out = xcorr.lagged_correlation(x, y, [-9, 0, 1], ["a", "b"], ["p"], by=["site"], unit=unit).collect()
        got = {(r.site, r.series_x, r.lag): (r.n, r.r) for r in out}
        assert len(out) == 2 * 2 * 3
        assert got[(0, "a", -9)] == (0, None) and got[(1, "b", 0)] == (0, None) and got[(0, "b", 0)][0] == 3
    line = _wide(spark, {"a": [float(i) / 3 for i in range(40)]})
    assert all(r.r is None or abs(r.r) <= 1.0 for r in xcorr.auto_correlation(line, [0, 1, 2, 3], ["a"]).collect())


def test_long_and_wide_matrices_agree(spark):
    rng = np.random.default_rng(8)
    rows = [(i, s, float(v)) for i in range(40) for s, v in zip("abcd", rng.normal(size=4)) if rng.random() < 0.8]
    rows += [(100, "lonely", 1.0)]
    long = spark.createDataFrame(rows, "k int, series string, value double")
    names = ["a", "b", "c", "d", "lonely"]
    wide = long.groupBy("k").pivot("series", names).sum("value")
    a = {(r.series_a, r.series_b): r.r for r in xcorr.correlation_matrix_long(long, "k").collect()}
    b = {(r.series_a, r.series_b): r.r for r in xcorr.correlation_matrix(wide, names).collect()}
    assert a.keys() == b.keys() and len(a) == 25 and a[("a", "lonely")] is None
    assert all((a[k] is None) == (b[k] is None) and (a[k] is None or abs(a[k] - b[k]) < 1e-12) for k in a)


def test_many_series_and_lags_in_blocks(spark):
    """60 x 60 series at nine lags over several chunks: what is shuffled last
    is a row per block pair and task, not a row per day and cell."""
    rng = np.random.default_rng(2)
    k, n, lags = 60, 1300, [-90, -60, -30, -10, 0, 10, 30, 60, 90]
    data = rng.normal(size=(n, k)).cumsum(axis=0) + 1e6
    names = [f"s{i:02d}" for i in range(k)]
    days = [D0 + dt.timedelta(days=i) for i in range(n)]
    w = spark.createDataFrame([(d, *map(float, row)) for d, row in zip(days, data)],
                              "date date, " + ", ".join(f"{c} double" for c in names)).repartition(4)
    for block in (16, 64):
        units = xcorr._units(xcorr._joined_days(w, w, names, names, [], "date"), [], lags, k, k, block)
        moments = xcorr._block_moments(units, [], lags)
        pairs = (-(-k // block)) ** 2
        assert moments.count() <= pairs * 8
        got = {(r.series_x, r.series_y, r.lag): (r.n, r.r)
               for r in xcorr.auto_correlation(w, lags, names, block=block).collect()}
        assert len(got) == k * k * len(lags)
        for lag in lags:
            a, b = (data[:n - lag], data[lag:]) if lag >= 0 else (data[-lag:], data[:n + lag])
            ref = np.corrcoef(a.T, b.T)[:k, k:]
            for i in range(0, k, 7):
                for j in range(k):
                    m, r = got[(names[i], names[j], lag)]
                    assert m == n - abs(lag) and abs(r - ref[i, j]) < 1e-9


def test_calendar_lags_over_chunks(spark):
    """Days with gaps, far lags, groups of which one has no y at all."""
    rng = np.random.default_rng(6)
    at = np.sort(rng.choice(2500, 1500, replace=False))
    a, p = rng.normal(size=(2, len(at)))
    days = [D0 + dt.timedelta(days=int(i)) for i in at]
    x = _wide(spark, {"a": a}, days, by=0).unionByName(_wide(spark, {"a": a[:9]}, days[:9], by=1))
    y = _wide(spark, {"p": p}, days, by=0).unionByName(_wide(spark, {"p": p[:9]}, days[:9], by=2))
    lags = [-800, -3, 0, 511, 512, 1200]
    got = {(r.site, r.lag): (r.n, r.r) for r in
           xcorr.lagged_correlation(x, y, lags, ["a"], ["p"], by=["site"], unit="days").collect()}
    assert set(got) == {(s, lag) for s in (0, 1) for lag in lags}
    there = dict(zip(at.tolist(), p))
    for lag in lags:
        pairs = [(v, there[i + lag]) for i, v in zip(at.tolist(), a) if i + lag in there]
        assert got[(0, lag)][0] == len(pairs) and abs(got[(0, lag)][1] - np.corrcoef(np.array(pairs).T)[0, 1]) < 1e-12
        assert got[(1, lag)] == (0, None)


def test_constant_over_many_chunks_and_no_days(spark):
    w = _wide(spark, {"a": [0.1] * 1500, "b": np.arange(1500.0)})
    got = {(r.series_x, r.series_y): r.r for r in xcorr.auto_correlation(w, [0], ["a", "b"]).collect()}
    assert got[("a", "b")] is None and got[("a", "a")] is None and abs(got[("b", "b")] - 1) < 1e-12
    none = xcorr.lagged_correlation(w.where("a > 1"), w, [0, 5], ["a"], ["b"])
    assert sorted((r.lag, r.n, r.r) for r in none.collect()) == [(0, 0, None), (5, 0, None)]
    assert xcorr.lagged_correlation(w.where("a > 1"), w, [0], ["a"], ["b"], unit="days").first().n == 0
