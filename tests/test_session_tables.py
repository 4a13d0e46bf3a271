from lagscope.operators.profile import preview, row_count, schema_profile, summary
from lagscope.session import checkpoint_dir
from lagscope.sources import tables

SF = "/root/testdata/sf0.001"


def test_checkpoint_dir_comes_from_the_session(spark):
    d = checkpoint_dir(spark)
    assert d and d == spark.sparkContext.getCheckpointDir()


def test_typed_tables_have_declared_schemas(spark):
    for name, ddl in tables.TABLE_SCHEMAS.items():
        df = tables.table(spark, SF, name)
        assert [f.name for f in df.schema.fields] == [c.split()[0] for c in ddl.split(", ")]
        assert df.limit(1).count() == 1


def test_profile_helpers(spark):
    df = tables.lineitem_measurements(spark, SF)
    assert row_count(df).first().rows == spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert [r.column for r in schema_profile(df).collect()] == df.columns
    assert preview(df, 3, ["date"]).count() == 3
    s = summary(df, ["value"]).first()
    assert s["count"] == row_count(df).first().rows and s["min"] <= s["mean"] <= s["max"]


def test_zone_with_clock_changes_has_the_same_hours(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        sf = "/root/testdata/sf0.01"
        typed = tables.lineitem_measurements(spark, sf).selectExpr("hour(ts) AS h").distinct()
        raw = tables.lineitem_measurements_from_raw(spark, sf).selectExpr("hour(ts) AS h").distinct()
        assert sorted(r.h for r in typed.collect()) == sorted(r.h for r in raw.collect()) == list(range(7, 14))
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_design_note_names_exist():
    import lagscope as L

    names = ["criteria", "pivot_wide", "daily_mean", "climatology", "sma", "ema", "gradient", "shift", "deseason",
             "zscore", "max_abs", "min_max", "l2_norm", "lagged_correlation", "correlation_matrix",
             "correlation_mass", "adjacency", "heat_weights", "heat_points", "spatial_density", "cost_score",
             "cluster", "pca", "profile", "write_csv", "materialize", "read_measurements",
             "normalize_measurements", "read_prices"]
    assert [n for n in names if not hasattr(L, n)] == []
