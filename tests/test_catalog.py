"""The registered queries against their DuckDB oracles on the smallest
tables (the driver runs the same comparison at sf0.01)."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_module
from pyspark.sql import functions as F

from lagscope.operators import series
from lagscope.plans import catalog
from lagscope.plans.catalog import ORACLES, QUERIES, rounded

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "supplier", "orders", "lineitem", "events"]

def _canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def norm(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 6)
        return v.isoformat() if hasattr(v, "isoformat") else v

    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_contract_shapes():
    qs, sql = entry_module.queries(), entry_module.oracle_sql()
    assert set(sql) <= set(qs)
    assert set(QUERIES) == set(ORACLES) and set(QUERIES) <= set(qs)


def test_entry_smoke(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["series_x", "series_y", "lag", "n", "r"]
    assert df.count() == 21          # 3 series x 1 price x 7 lags, whatever overlaps


# Spark simple type -> DuckDB type name
TYPES = {"timestamp": "TIMESTAMP", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    df = entry_module.queries()[name](spark, SF)
    sql = entry_module.oracle_sql()[name]
    described = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    assert {f.name: TYPES.get(f.dataType.simpleString()) for f in df.schema.fields} == described
    cur = con.execute(sql)
    ocols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(ocols)
    assert _canon([tuple(r) for r in df.collect()], df.columns) == _canon(cur.fetchall(), ocols)


@pytest.mark.parametrize("freq", ["daily", "monthly", "yearly"])
def test_anomalies_do_not_hang_on_summation_order(spark, freq):
    """Equal to the oracle at sf0.01 however the rows are dealt, and no cell
    so near to a tie that the last bits of a sum could move it."""
    sf, name = SF.replace("0.001", "0.01"), f"deseason_{freq}"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    cur = con.execute(ORACLES[name])
    want = _canon(cur.fetchall(), [d[0] for d in cur.description])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("1", "8"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got = QUERIES[name](spark, sf)
            assert _canon([tuple(r) for r in got.collect()], got.columns) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    anomalies = catalog.off_tie(series.deseason(catalog.wide(spark, sf), catalog.FLAGS, "date", freq), catalog.FLAGS)
    for c in catalog.FLAGS:
        units = F.abs(F.col(c) * 100000)
        assert anomalies.where(F.abs(units - F.floor(units) - 0.5) < 1e-5).count() == 0


def test_rounding_never_overflows(spark):
    big = [2e9, 2e13, -2e13, 1.23e300, 0.1234567]
    out = rounded(spark.createDataFrame([(v,) for v in big], "v double"), 10).collect()
    assert [r.v for r in out] == big
