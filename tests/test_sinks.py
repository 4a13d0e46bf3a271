import glob

import pytest

from lagscope.operators.reshape import from_vector, to_vector
from lagscope.sources import sinks


def test_write_csv_single_and_modes(spark, tmp_path):
    df = spark.range(10).selectExpr("id", "id * 2.0 AS v").repartition(3)
    out = str(tmp_path / "one")
    sinks.write_csv(df, out, single=True)
    files = glob.glob(out + "/*.csv")
    assert len(files) == 1 and not glob.glob(out + "/_SUCCESS")
    with pytest.raises(Exception):
        sinks.write_csv(df, out, single=True)  # error-if-exists
    sinks.write_csv(df.limit(3), out, single=True, mode="overwrite")
    assert spark.read.option("header", True).csv(out).count() == 3


def test_single_csv_is_written_by_many_tasks(spark, tmp_path):
    """One file, ordered, one header, the rows as the tasks wrote them."""
    import csv

    odd = ['a,b', 'say "hi"', "", "two\nlines", None, "é"]
    df = spark.range(5000).selectExpr("id", "id % 6 AS k").repartition(7)
    names = spark.createDataFrame(list(enumerate(odd)), "k bigint, `name, of it` string")
    df = df.join(names, "k").select("id", "name, of it")
    out = str(tmp_path / "one")
    sinks.write_csv(df, out, single=True, order_by=["id"])
    files = glob.glob(out + "/*.csv")
    assert len(files) == 1 and glob.glob(str(tmp_path / "*")) == [out]  # no work folder is left
    with open(files[0], newline="") as f:
        rows = list(csv.reader(f, escapechar="\\"))
    assert rows[0] == ["id", "name, of it"] and [int(r[0]) for r in rows[1:]] == list(range(5000))
    assert all(r[1] == (odd[int(r[0]) % 6] or "") for r in rows[1:])
    # read back as the files of a distributed write are
    sinks.write_csv(df, str(tmp_path / "many"))
    read = spark.read.option("header", True).option("multiLine", True).schema(df.schema)
    one, many = read.csv(out), read.csv(str(tmp_path / "many"))
    assert one.count() == 5000 and one.exceptAll(many).count() == 0
    # the modes: leave, add, replace; an empty table is its header
    sinks.write_csv(df.limit(3), out, single=True, mode="ignore")
    assert len(glob.glob(out + "/*.csv")) == 1
    sinks.write_csv(df.limit(3), out, single=True, mode="append")
    assert len(glob.glob(out + "/*.csv")) == 2
    sinks.write_csv(df.where("id < 0"), out, single=True, mode="overwrite")
    (only,) = glob.glob(out + "/*.csv")
    assert open(only).read() == 'id,"name, of it"\n'
    sinks.write_csv(df.where("id = 0"), out, single=True, mode="overwrite", header=False)
    assert open(glob.glob(out + "/*.csv")[0]).read() == '0,"a,b"\n'


def test_failed_single_csv_leaves_the_old_one(spark, tmp_path):
    out = str(tmp_path / "one")
    sinks.write_csv(spark.range(3), out, single=True)
    before = glob.glob(out + "/*.csv")
    bad = spark.range(3).selectExpr("raise_error('no') AS id")
    with pytest.raises(Exception):
        sinks.write_csv(bad, out, single=True, mode="overwrite")
    assert glob.glob(out + "/*.csv") == before and glob.glob(str(tmp_path / "*")) == [out]


def test_heat_points_of_a_hot_site_are_many_tasks(spark, tmp_path):
    import datetime as dt

    import pyspark.sql.functions as F

    from lagscope.operators import spatial

    w = spark.range(800).select(F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"),
                                F.date_add(F.lit(dt.date(2019, 1, 1)), F.col("id").cast("int")).alias("date"),
                                F.lit(50).alias("weight"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = spatial.heat_points(w).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(parts) > 4 and max(r["count"] for r in parts) < 40_000 / 2
    out = str(tmp_path / "points")
    sinks.write_csv(spatial.heat_points(w), out, single=True)
    (only,) = glob.glob(out + "/*.csv")
    assert open(only).read() == "lat,lon\n" + "1.0,2.0\n" * 40_000


def test_materialize_and_reload(spark, tmp_path):
    df = spark.createDataFrame([(2019, 1, 1.0, 2.0)], "year int, dayofyear int, CO double, NO2 double")
    path = str(tmp_path / "scenario")
    sinks.materialize(df, path, labels=["CO", "NO2"])
    back, labels = sinks.read_scenario(spark, path)
    assert labels == ["CO", "NO2"] and back.count() == 1


def test_vector_text_round_trip(spark):
    df = spark.createDataFrame([(1, 0.5, -2.0)], "k int, a double, b double")
    v = to_vector(df, ["a", "b"], "features")
    txt = sinks.vector_to_string(v.drop("a", "b"), "features")
    assert txt.first().features == "[0.5,-2.0]"
    parsed = sinks.parse_vector_string(txt, "features", ["a", "b"]).first()
    assert (parsed.a, parsed.b) == (0.5, -2.0)
    back = from_vector(v, "features", ["x", "y"]).first()
    assert (back.x, back.y) == (0.5, -2.0)


def test_correlation_sink(spark, tmp_path):
    cors = spark.createDataFrame([("a", "b", 0, 10, 0.5)], "series_x string, series_y string, lag int, n long, r double")
    sinks.write_correlations(cors, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).first().r == 0.5


def test_correlation_text_lines(spark, tmp_path):
    cors = spark.createDataFrame([("CO", "Price", -10, 5, 0.25), ("CO", "CO", 0, 5, None)],
                                 "series_x string, series_y string, lag int, n long, r double")
    sinks.write_correlations(cors, str(tmp_path / "t"), fmt="text")
    lines = sorted(r.value for r in spark.read.text(str(tmp_path / "t")).collect())
    assert lines == ["((CO,CO,0),NaN)", "((CO,Price,-10),0.25)"]
