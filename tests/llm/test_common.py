import pytest
from pyspark.sql import functions as F

from lagscope.llm.common import attach, clear_staging, keep_rows, pick, raw_hash, stage

from .conftest import clashing


def test_attach_equals_a_left_join(spark):
    # one key with a third of the rows, null keys, keys without a group
    rows = spark.range(6000).select("id", F.expr(
        "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 7 = 0 THEN NULL ELSE concat('k', id % 2500) END").alias("key"))
    groups = rows.where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    groups = stage(groups.where("key <> 'k1'"), "test-groups")
    got = attach(rows, groups, "key", "n", ["n", "top"])
    want = rows.join(groups, "key", "left").select("id", "key", "n", "top")
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_attach_with_struct_keys_takes_nulls_as_equal(spark):
    rows = spark.createDataFrame([(1, None), (2, "a"), (3, "b"), (4, None)], "id int, s string").withColumn("key", F.struct("s"))
    groups = stage(rows.where("s IS NULL OR s = 'a'").groupBy("key").agg(F.count("*").alias("n")), "test-groups")
    got = {r.id: r.n for r in attach(rows, groups, "key", "n", ["n"]).collect()}
    assert got == {1: 2, 2: 1, 3: None, 4: 2}


def test_attach_to_no_groups(spark):
    rows = spark.range(5).withColumn("key", F.col("id"))
    groups = stage(rows.where("id < 0").groupBy("key").agg(F.count("*").alias("n")), "test-groups")
    assert [r.n for r in attach(rows, groups, "key", "n", ["n"]).collect()] == [None] * 5


def test_pick_by_exact_name(docs_of):
    df = clashing(docs_of([(1, "lower")]))
    assert [tuple(r) for r in pick(df, "text", "doc_id").collect()] == [("lower", 1)]
    with pytest.raises(ValueError, match="missing"):
        pick(df, "Doc_Id")


def test_keep_rows_gives_each_named_row_once(docs_of):
    docs = docs_of([(1, "a"), (1, "a"), (1, "b"), (None, "a"), (2, None)])
    keep = docs.select(F.col("doc_id").alias("id"), raw_hash("text").alias("raw")).where("id IS NULL OR raw <> xxhash64('b')").distinct()
    got = sorted(((r.doc_id, r.text) for r in keep_rows(docs, keep).collect()), key=str)
    assert got == sorted([(1, "a"), (None, "a"), (2, None)], key=str)


def test_staged_tables_survive_and_clear(spark):
    df = stage(spark.range(10), "test-stage")
    assert df.count() == 10
    clear_staging(spark)
    with pytest.raises(Exception):
        spark.read.parquet(df.inputFiles()[0])
