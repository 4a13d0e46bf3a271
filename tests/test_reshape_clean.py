import datetime as dt

import pytest

from lagscope.operators import clean, reshape

D = dt.date(2019, 1, 1)
SCHEMA = "criteria string, lat double, lon double, date date, value double, unit string"


def _long(spark):
    return spark.createDataFrame([
        ("CO", 38.31012, -122.29642, D, 1.0, "ppm"),
        ("CO", 38.31041, -122.29638, D, 3.0, "ppm"),      # collapses with the row above at 3 decimals
        ("PM2.5", 38.31012, -122.29642, D, 10.0, "ug/m3"),
        ("CO", 44.0, -123.0, D, 5.0, "ppm"),              # site lacking PM2.5
    ], SCHEMA)


def test_pivot_wide_complete_case_and_names(spark):
    w = reshape.pivot_wide(_long(spark), ["CO", "PM2.5"])
    assert w.columns == ["lat", "lon", "date", "CO", "PM2_5"]
    got = w.collect()
    assert len(got) == 1 and (got[0].lat, got[0].lon, got[0].CO, got[0].PM2_5) == (38.31, -122.296, 2.0, 10.0)
    both = reshape.pivot_wide(_long(spark), ["CO", "PM2.5"], drop_null=False)
    assert both.count() == 2


def test_pivot_wide_with_unit_and_discovered_criteria(spark):
    w = reshape.pivot_wide(_long(spark), None, with_unit=True).collect()
    assert w[0].CO_unit == "ppm" and w[0].PM2_5_unit == "ug/m3"


def test_complete_case_long(spark):
    snapped = clean.snap_coordinates(_long(spark), 3)
    out = clean.complete_case_long(snapped, ["lat", "lon", "date"], ["CO", "PM2.5"]).collect()
    assert sorted((r.criteria, r.value) for r in out) == [("CO", 2.0), ("PM2.5", 10.0)]


def test_melt(spark):
    w = spark.createDataFrame([(D, 1.0, 2.0)], "date date, a double, b double")
    assert sorted(tuple(r) for r in reshape.melt(w, ["date"], ["a", "b"]).collect()) == [(D, "a", 1.0), (D, "b", 2.0)]


def test_text_and_year_filters(spark):
    df = spark.createDataFrame([("Napa", D, 1.0), ("Lane", dt.date(2018, 5, 1), 2.0)], "county string, date date, v double")
    assert clean.text_filter(df, "napa").count() == 1
    assert clean.year_filter(df, [2018]).first().county == "Lane"
    assert clean.year_filter(df, [2016, 2019]).first().county == "Napa"


def test_name_repair_and_selection(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)], "`year(date)` int, `avg(Nitric oxide (NO))` double, `x_sma3` double")
    fixed = clean.sanitize_columns(clean.repair_aggregate_names(df))
    assert fixed.columns == ["year", "Nitric_oxide_NO", "x_sma3"]
    assert clean.select_like(fixed, "_sma", keep=["year"]).columns == ["year", "x_sma3"]


def test_validate_columns(spark):
    df = spark.createDataFrame([(D, 1.0)], "date date, v double")
    assert clean.validate_columns(df, ["date", "v"], {"v": "double"}) is df
    with pytest.raises(ValueError):
        clean.validate_columns(df, ["date", "w"])
    with pytest.raises(TypeError):
        clean.validate_columns(df, ["date"], {"date": "string"})


def test_pivot_paths_agree(spark):
    import random

    from lagscope.operators import reshape as rs

    random.seed(3)
    crit = [f"c{i}" for i in range(12)]
    rows = [(random.choice(crit), 1.0 + (i % 3) * 0.001, 2.0, D, float(random.randint(0, 100)), "u" + str(i % 2))
            for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    many = rs.pivot_wide(df, crit, drop_null=False, with_unit=True)
    found, names, _ = rs.discover_pivot(df)
    assert names == crit or names == sorted(crit)
    whole = rs.pivot_wide(df, crit).collect()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, whole))
    import pyspark.sql.functions as F
    snapped = clean.snap_coordinates(df, 3)
    direct = snapped.groupBy("lat", "lon", "date").agg(
        *[x for c in sorted(crit) for x in (F.avg(F.when(F.col("criteria") == c, F.col("value"))).alias(c),
                                            F.min(F.when(F.col("criteria") == c, F.col("unit"))).alias(c + "_unit"))])
    a = sorted(tuple(r) for r in many.collect())
    b = sorted(tuple(r) for r in direct.collect())
    assert len(a) == len(b) == 3
    for ra, rb in zip(a, b):
        for x, y in zip(ra, rb):
            assert (x == y) if not isinstance(x, float) else abs(x - y) < 1e-9


def test_pivot_of_two_thousand_criteria(spark):
    """Complete rows, rows with gaps at the start, inside and at the end, a row
    whose only value is null; the code generated follows the cells."""
    import pyspark.sql.functions as F

    many = 2000
    crit = [f"c{i:04d}" for i in range(many)]
    day = F.lit(D).alias("date")
    whole = spark.range(3 * many).select((F.col("id") % 3).cast("double").alias("lat"),
                                         F.format_string("c%04d", F.floor(F.col("id") / 3)).alias("criteria"),
                                         F.floor(F.col("id") / 3).cast("double").alias("value"))
    sparse = spark.createDataFrame([(7.0, "c0003", 1.0), (7.0, "c0003", 2.0), (7.0, "c1990", 5.0), (8.0, "c0000", 4.0),
                                    (8.0, "c1999", 6.0), (9.0, "c0500", None), (9.0, "other", 1.0)],
                                   "lat double, criteria string, value double")
    long = whole.unionByName(sparse).select("criteria", "lat", F.lit(1.0).alias("lon"), day, "value")
    full = {r.lat: r for r in reshape.pivot_wide(long, crit).collect()}
    assert sorted(full) == [0.0, 1.0, 2.0]
    assert all(list(r)[3:] == [float(i) for i in range(many)] for r in full.values())
    wide = reshape.pivot_wide(long, crit, drop_null=False)
    assert wide.columns == ["lat", "lon", "date", *crit]
    got = {r.lat: {c: v for c, v in zip(crit, list(r)[3:]) if v is not None} for r in wide.collect()}
    assert got[7.0] == {"c0003": 1.5, "c1990": 5.0} and got[8.0] == {"c0000": 4.0, "c1999": 6.0} and got[9.0] == {}
    assert got[0.0] == {c: float(i) for i, c in enumerate(crit)}


def test_pivot_with_missing_units_and_null_keys(spark):
    df = spark.createDataFrame([("CO", 1.0, 1.0, None, 1.0, "ppm"), ("O3", 1.0, 1.0, None, 2.0, None),
                                ("CO", 2.0, 1.0, D, 1.0, "ppm"), ("O3", 2.0, 1.0, D, 3.0, "ppb")], SCHEMA)
    # a complete row has all its units, too; a null key is a key
    assert [r.lat for r in reshape.pivot_wide(df, ["CO", "O3"], with_unit=True).collect()] == [2.0]
    assert sorted(r.lat for r in reshape.pivot_wide(df, ["CO", "O3"]).collect()) == [1.0, 2.0]
    units = {r.lat: (r.CO_unit, r.O3_unit) for r in reshape.pivot_wide(df, ["CO", "O3"], None, False, True).collect()}
    assert units == {1.0: ("ppm", None), 2.0: ("ppm", "ppb")}
    assert reshape.pivot_wide(df, []).collect() == []
