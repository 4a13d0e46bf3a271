"""Property tests of the lagged correlation on
random series."""

import datetime as dt

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lagscope.operators import xcorr

D0 = dt.date(2020, 1, 1)


def _frame(spark, cols):
    n = len(next(iter(cols.values())))
    names = list(cols)
    rows = [(D0 + dt.timedelta(days=i), *[float(cols[c][i]) for c in names]) for i in range(n)]
    return spark.createDataFrame(rows, "date date, " + ", ".join(f"{c} double" for c in names))


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(n=st.integers(8, 40), seed=st.integers(0, 10_000), lags=st.lists(st.integers(-6, 6), min_size=1, max_size=4))
def test_lagged_correlation_invariants(spark, n, seed, lags):
    lags = lags + [-v for v in lags]                                    # symmetric, for r(y,x,-l)
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=(2, n))
    w = _frame(spark, {"a": a, "b": b})
    res = {(r.series_x, r.series_y, r.lag): (r.n, r.r) for r in xcorr.auto_correlation(w, lags, ["a", "b"]).collect()}
    uniq = sorted(set(lags))
    assert len(res) == 4 * len(uniq)                                   # |X| |Y| |lags|
    for lag in uniq:
        cnt, r = res[("a", "b", lag)]
        assert cnt == n - abs(lag)
        xs, ys = (a[:n - lag], b[lag:]) if lag >= 0 else (a[-lag:], b[:n + lag])
        assert abs(r - np.corrcoef(xs, ys)[0, 1]) < 1e-9             # array definition
        assert abs(r - res[("b", "a", -lag)][1]) < 1e-9                # r(x,y,l) = r(y,x,-l)
    if 0 in uniq:
        assert abs(res[("a", "a", 0)][1] - 1.0) < 1e-12
