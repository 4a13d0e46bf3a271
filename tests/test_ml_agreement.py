"""Agreement of the native scalers with the MLlib vector scalers (through
the vector adapter), as the reference's prepared datasets use them."""

import numpy as np
from pyspark.ml.feature import MaxAbsScaler, MinMaxScaler, StandardScaler

from lagscope.operators.reshape import from_vector, to_vector
from lagscope.operators.scale import max_abs, min_max, zscore, zscore_max_abs

COLS = ["a", "b", "c"]


def _frame(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(40, 3)) * [1.0, 10.0, 0.1] + [0.0, 5.0, -2.0]
    x[:, 2] = 7.0                                                    # a constant column
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "i int, a double, b double, c double")


def _ml(df, scaler):
    v = to_vector(df, COLS, "features")
    out = scaler.fit(v).transform(v)
    return {r.i: (r.x, r.y, r.z) for r in from_vector(out, "scaled", ["x", "y", "z"]).collect()}


def _native(df):
    return {r.i: (r.a, r.b, r.c) for r in df.collect()}


def _close(a, b):
    assert a.keys() == b.keys()
    for k in a:
        assert np.allclose(a[k], b[k], atol=1e-12), (k, a[k], b[k])


def test_standard_scaler(spark):
    df = _frame(spark)
    for mean, std in ((True, True), (False, True), (True, False)):
        ml = _ml(df, StandardScaler(inputCol="features", outputCol="scaled", withMean=mean, withStd=std))
        _close(_native(zscore(df, COLS, mean=mean, std=std)), ml)


def test_max_abs_and_min_max(spark):
    df = _frame(spark)
    _close(_native(max_abs(df, COLS)), _ml(df, MaxAbsScaler(inputCol="features", outputCol="scaled")))
    _close(_native(min_max(df, COLS)), _ml(df, MinMaxScaler(inputCol="features", outputCol="scaled")))


def test_chained_scalers(spark):
    df = _frame(spark)
    v = to_vector(df, COLS, "features")
    z = StandardScaler(inputCol="features", outputCol="z", withMean=True, withStd=True).fit(v).transform(v)
    m = MaxAbsScaler(inputCol="z", outputCol="scaled").fit(z).transform(z)
    ml = {r.i: (r.x, r.y, r.w) for r in from_vector(m, "scaled", ["x", "y", "w"]).collect()}
    _close(_native(zscore_max_abs(df, COLS)), ml)
