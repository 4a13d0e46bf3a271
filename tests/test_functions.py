import pytest
from pyspark.sql import functions as F

from lagscope.functions.exprs import date_bucket, l2_norm, safe_pearson, safe_ratio, sanitize_name, sanitize_names


def test_l2_norm(spark):
    df = spark.createDataFrame([(3.0, 4.0)], "a double, b double")
    assert df.select(l2_norm("a", "b")).first()[0] == 5.0


def test_safe_ratio_by_zero_is_null(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(safe_ratio("a", "b")).collect()] == [None, 0.5]


def test_safe_pearson_edge_cases(spark):
    const = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "x double, y double")
    assert const.agg(safe_pearson("x", "y")).first()[0] is None
    one = spark.createDataFrame([(1.0, 2.0)], "x double, y double")
    assert one.agg(safe_pearson("x", "y")).first()[0] is None
    lin = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.5)], "x double, y double")
    r = lin.agg(safe_pearson("x", "y")).first()[0]
    assert abs(r - lin.agg(F.corr("x", "y")).first()[0]) < 1e-12


def test_safe_pearson_uses_pairwise_complete_rows(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, 3.0), (100.0, None)], "x double, y double")
    assert abs(df.agg(safe_pearson("x", "y")).first()[0] - 1.0) < 1e-12


def test_sanitize():
    assert sanitize_name("PM2.5") == "PM2_5"
    assert sanitize_name("Nitric oxide (NO)") == "Nitric_oxide_NO"
    assert sanitize_name("1,3-Butadiene") == "1_3_Butadiene"
    assert sanitize_names(["A@1.000,-2.000", "A@1.000,2.000"]) == ["A_1_000_m2_000", "A_1_000_2_000"]
    with pytest.raises(ValueError):
        sanitize_names(["a b", "a_b"])


def test_date_bucket_unknown_raises():
    with pytest.raises(ValueError):
        date_bucket("date", "weekly")
