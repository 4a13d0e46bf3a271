from conftest import approx_list

from lagscope.operators.scale import max_abs, min_max, zscore, zscore_max_abs


def _frame(spark, vals):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(vals)], "i int, a double")


def _col(df):
    return [r.a for r in df.orderBy("i").collect()]


def test_zscore(spark):
    approx_list(_col(zscore(_frame(spark, [1, 2, 4]), ["a"])), [-0.8728715609, -0.2182178902, 1.0910894512])


def test_zscore_constant_is_zero(spark):
    approx_list(_col(zscore(_frame(spark, [5, 5, 5]), ["a"])), [0.0, 0.0, 0.0])


def test_scale_by_std_only(spark):
    approx_list(_col(zscore(_frame(spark, [1, 2, 4]), ["a"], mean=False)), [0.6546536707, 1.3093073414, 2.6186146828])


def test_max_abs(spark):
    approx_list(_col(max_abs(_frame(spark, [-4, 2, 0]), ["a"])), [-1.0, 0.5, 0.0])
    approx_list(_col(max_abs(_frame(spark, [0, 0]), ["a"])), [0.0, 0.0])


def test_min_max(spark):
    approx_list(_col(min_max(_frame(spark, [-4, 2, 0]), ["a"])), [0.0, 1.0, 0.6666666667])
    approx_list(_col(min_max(_frame(spark, [5, 5, 5]), ["a"])), [0.5, 0.5, 0.5])


def test_chain_honours_flags(spark):
    out = _col(zscore_max_abs(_frame(spark, [1, 2, 4]), ["a"]))
    approx_list(out, [-0.8, -0.2, 1.0])


def test_nulls_propagate(spark):
    df = spark.createDataFrame([(0, 1.0), (1, None), (2, 3.0)], "i int, a double")
    out = _col(zscore(df, ["a"]))
    assert out[1] is None and abs(out[0] + 0.7071067812) < 1e-9


def test_stats_fit_on_another_frame(spark):
    full = _frame(spark, [1, 2, 4])
    part = full.where("i = 2")
    approx_list(_col(zscore(part, ["a"], stats_from=full)), [1.0910894512])


def test_fused_chain_equals_two_steps(spark):
    import numpy as np

    vals = list(np.random.default_rng(0).normal(size=30) * 5 + 3)
    df = _frame(spark, vals)
    for mean in (True, False):
        for std in (True, False):
            fused = _col(zscore_max_abs(df, ["a"], mean=mean, std=std))
            two = _col(max_abs(zscore(df, ["a"], mean=mean, std=std), ["a"]))
            approx_list(fused, two, tol=1e-12)
    approx_list(_col(zscore_max_abs(_frame(spark, [5, 5, 5]), ["a"])), [0.0, 0.0, 0.0])
    approx_list(_col(zscore_max_abs(_frame(spark, [5, 5, 5]), ["a"], mean=False)), [0.0, 0.0, 0.0])


def test_feature_matrix(spark):
    import datetime as dt

    from lagscope.plans.scenarios import feature_matrix

    df = spark.createDataFrame([(1.0, 10.0, dt.date(2019, 1, 1), 1.0), (3.0, 10.0, dt.date(2019, 1, 3), 2.0),
                                (2.0, 10.0, dt.date(2019, 1, 2), 4.0)], "lat double, lon double, date date, a double")
    got = sorted(tuple(r) for r in feature_matrix(df, ["a"]).collect())
    assert [g[:3] for g in got] == [(0.0, 0.5, 0.0), (0.5, 0.5, 0.5), (1.0, 0.5, 1.0)]
    approx_list([g[3] for g in got], [-0.8, 1.0, -0.2])
