import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text[, lang[, source]]) tuples, over several partitions."""
    def make(rows, parts=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s",
                 None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, DOC_SCHEMA).repartition(parts)
    return make


@pytest.fixture(scope="session")
def sf_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def clashing(df):
    """The frame with extra columns whose names an operator might use itself."""
    from pyspark.sql import functions as F
    for name in ("TEXT", "id", "fp", "t", "k", "n", "_salt", "root", "size", "sha", "copies", "ids"):
        df = df.withColumn(f"x{len(df.columns)}", F.lit(name))
    names = ["TEXT", "id", "fp", "t", "k", "n", "_salt", "root", "size", "sha", "copies", "ids"]
    return df.toDF(*df.columns[:-len(names)], *names)
