"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lagscope.session import checkpoint_dir

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

# The six ASCII white-space bytes of [\x20\x09-\x0D].  They are
# also what ``bytes.split()`` and ``bytes.strip()`` cut at.
ASCII_SPACE = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only, found by exact name.

    Other columns cannot get in the way: names that differ only in case (which
    Spark would call ambiguous) and names the operators use inside are gone.
    """
    cols = df.columns
    missing = [n for n in names if n not in cols]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {cols}")
    _show_package(df.sparkSession)
    plain = df.toDF(*[f"c{i}" for i in range(len(cols))])
    return plain.select(*[F.col(f"c{cols.index(n)}").alias(n) for n in names])


def _show_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it (one
    machine or a shared folder); elsewhere it comes with --py-files."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *paths])


def utf8(name: str) -> Column:
    """A text column as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")


def small_batches(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of Arrow batches, so that only a few texts at a time
    become Python objects."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def runs(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) for every run of rows that agree in their first ``keys``
    columns; a run may go on over several Arrow batches."""
    key, held = None, []
    for batch in small_batches(batches, 1024):
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if row[:keys] != key:
                if held:
                    yield key, held
                key, held = row[:keys], []
            held.append(row)
    if held:
        yield key, held


def staging_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder that the session names in
    ``spark.checkpoint.dir``.  Spark itself removes checkpoints; folders made
    here stay until ``clear_staging``."""
    return f"{checkpoint_dir(spark).rstrip('/')}/lagscope-{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder as Parquet and read back.

    Lost executors cannot take the table with them, later reads prune columns,
    and the planner knows its size.
    """
    path = staging_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_staging(spark: SparkSession) -> None:
    """Delete the session's staged tables; only results already written stay
    valid."""
    sc = spark.sparkContext
    root = sc._jvm.org.apache.hadoop.fs.Path(checkpoint_dir(spark))
    fs = root.getFileSystem(sc._jsc.hadoopConfiguration())
    for status in fs.listStatus(root):
        if status.getPath().getName().startswith("lagscope-"):
            fs.delete(status.getPath(), True)


# A key is heavy when it holds more than one in HEAVY_SHARE of all rows, so
# there are fewer than HEAVY_SHARE heavy keys whatever the data.
HEAVY_SHARE = 1000


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, extra: list[str],
           deal_by: list[str] | None = None) -> DataFrame:
    """``rows`` LEFT JOIN ``groups`` on ``key`` where one key may hold a large
    part of the rows.

    ``groups`` has one row per key with the number of ``rows`` it meets in
    ``size``; stage it first, it is read twice.  Heavy keys (fewer than
    ``HEAVY_SHARE``, see above) are attached from a broadcast; their rows then
    take no part in the shuffle join but are dealt out by a salt (a hash of
    ``deal_by``, all columns by default), where they match nothing.  A null key
    matches nothing; a struct key compares its null fields as equal.
    """
    total = groups.agg(F.sum(size)).scalar()
    heavy = F.col(size) * F.lit(HEAVY_SHARE) > total
    named = [F.col(c).alias(f"_h_{c}") for c in extra]
    top = groups.where(heavy).select(F.col(key).alias("_h_key"), *named)
    j = rows.join(F.broadcast(top), F.col(key) == F.col("_h_key"), "left")
    spread = F.lit(1) + F.pmod(F.xxhash64(*(deal_by or rows.columns)), F.lit(1_000_000))
    apart = F.col("_h_key").isNotNull() | F.col(key).isNull()
    j = j.withColumn("_salt", F.when(apart, spread).otherwise(F.lit(0).cast("long")))
    rest = groups.where(~heavy).select(F.col(key).alias("_l_key"), F.lit(0).cast("long").alias("_l_salt"),
                                       *[F.col(c).alias(f"_l_{c}") for c in extra])
    j = j.join(rest, (F.col(key) == F.col("_l_key")) & (F.col("_salt") == F.col("_l_salt")), "left")
    return j.select(*rows.columns, *[F.coalesce(f"_h_{c}", f"_l_{c}").alias(c) for c in extra])


def keep_rows(docs: DataFrame, keep: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` named in ``keep``, one each, with all their columns.

    ``keep`` has unique (id, raw), where raw is ``raw_hash`` of the text.  Rows
    that repeat id and text collapse map-side before the one shuffle of texts,
    so that copies of one row cannot pile up in a task.
    """
    cols = docs.columns
    names = [f"c{i}" for i in range(len(cols))]
    plain = docs.toDF(*names)
    key = [F.col(names[cols.index(id_col)]).alias("id"), raw_hash(names[cols.index(text_col)]).alias("raw")]
    once = plain.groupBy(*key).agg(F.first(F.struct(*names)).alias("row"))
    wanted = keep.select(F.col("id").alias("k_id"), F.col("raw").alias("k_raw"))
    hit = once.join(wanted, F.col("id").eqNullSafe(F.col("k_id")) & (F.col("raw") == F.col("k_raw")), "left_semi")
    return hit.select("row.*").toDF(*cols)


def raw_hash(name: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(name).cast("string"), F.lit("")))
