"""Files whose headers differ: one scan per header, union by name, rejects.

The columns of yearly files drift: one has them in another order, one has a
column more, one lacks a column.  The catalogue reads the first line of every
file (their number is that of files, class x year) and groups the files by it.
Each group is one scan with its own columns, and the groups are united by name,
so a value always lands under the name that its file gave it.

What can't be read is a row of the reject table, not a failed job and not a
null: files without a needed column or with a name twice (``record`` is the
header), and records with more or fewer fields than their header.
"""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

REJECTS = "file string, record string, reason string"
_RECORD = "__record"


def first_line(spark: SparkSession, path: str) -> str:
    """The first line of a file, read through its own file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)
    try:
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
        return (reader.readLine() or "").removeprefix("﻿")
    finally:
        stream.close()


def catalogue(spark: SparkSession, paths: Sequence[str]) -> dict[tuple[str, ...], list[str]]:
    """Header -> the files that have it, both in the order of ``paths``."""
    found: dict[tuple[str, ...], list[str]] = {}
    for path in paths:
        line = first_line(spark, path)
        names = tuple(n.strip() for n in next(csv.reader([line]), []))
        found.setdefault(names, []).append(path)
    return found


def read_by_header(spark: SparkSession, paths: Sequence[str], columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``(rows, rejects)``: the columns of all readable records as strings with
    the URI of their file as ``file``, and (file, record, reason) of everything
    else.  An empty list of paths is an error, a list without one readable file
    gives no rows."""
    if not paths:
        raise FileNotFoundError("no files matched")
    schema = StructType([StructField(c, StringType()) for c in [*columns, "file"]])
    rows, refused, broken = None, None, []
    for names, files in catalogue(spark, paths).items():
        lacking = [c for c in columns if c not in names]
        twice = sorted({c for c in columns if names.count(c) > 1})
        if lacking or twice:
            reason = f"lacks {lacking}" if lacking else f"has {twice} more than once"
            broken += [(_uri(spark, f), ",".join(names), reason) for f in files]
            continue
        # columns go by place: names that nobody asks for may repeat or be empty
        places = StructType([StructField(f"c{i}", StringType()) for i in range(len(names))] + [StructField(_RECORD, StringType())])
        raw = (spark.read.schema(places).option("header", True).option("enforceSchema", True).option("mode", "PERMISSIVE")
               # a record's fields are counted only where all of them are parsed
               .option("columnPruning", False).option("columnNameOfCorruptRecord", _RECORD).csv(list(files))
               .select("*", F.col("_metadata.file_path").alias("file")))
        # (a query of the record column alone, as a count would be, is refused:
        # the second term, always true, keeps a column of data beside it)
        read = F.coalesce(F.length("c0"), F.lit(0)) >= 0
        good = raw.where(F.col(_RECORD).isNull() & read).select(
            *[F.col(f"c{names.index(c)}").alias(c) for c in columns], "file")
        there = sum((F.col(f"c{i}").isNotNull().cast("int") for i in range(len(names))), F.lit(0))
        bad = raw.where(F.col(_RECORD).isNotNull() & read).select(
            "file", F.col(_RECORD).alias("record"),
            F.format_string(f"not {len(names)} fields (%d with a value)", there).alias("reason"))
        rows = good if rows is None else rows.unionByName(good)
        refused = bad if refused is None else refused.unionByName(bad)
    files = spark.createDataFrame(broken, REJECTS)
    if rows is None:
        return spark.createDataFrame([], schema), files
    return rows, refused.unionByName(files)


def _uri(spark: SparkSession, path: str) -> str:
    """A path as Spark names it in ``_metadata.file_path``."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toUri().toString()
