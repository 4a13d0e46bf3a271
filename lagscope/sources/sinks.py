"""Sinks: CSV / Parquet writers, the scenario store, vector <-> text.

Writers are distributed, one file per partition.  ``single=True`` gives one CSV
file: its parts are written by as many tasks as the plan has, and the file
system client joins their bytes behind one header.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MODES = {"error", "errorifexists", "overwrite", "append", "ignore"}


def write_csv(df: DataFrame, path: str, single: bool = False, mode: str = "errorifexists",
              header: bool = True, order_by: Sequence[str] = ()) -> None:
    """Header CSV in one write with one save mode.  ``order_by`` sorts the rows
    by range, in all tasks.  ``single`` -> one output file, no ``_SUCCESS``
    marker: the plan keeps its partitions, whose files are joined in their
    order.  An interrupted write leaves no file, and the old one in place."""
    if mode not in _MODES:
        raise ValueError(f"mode must be one of {sorted(_MODES)}")
    out = df.orderBy(*order_by) if order_by else df
    if single:
        _write_one_file(out, path.rstrip("/"), mode, header)
    else:
        out.write.mode(mode).option("header", header).csv(path)


def _write_one_file(df: DataFrame, path: str, mode: str, header: bool) -> None:
    spark = df.sparkSession
    target, fs = hadoop_path(spark, path)
    if fs.exists(target):
        if mode == "ignore":
            return
        if mode in ("error", "errorifexists"):
            raise FileExistsError(path)
    name = uuid.uuid4().hex
    work = f"{path}.parts-{name}"
    try:
        parts = [f"{work}/rows"]
        df.write.option("header", False).csv(parts[0])
        if header:
            # written as a row, so that names are quoted like values
            parts.insert(0, f"{work}/header")
            spark.createDataFrame([tuple(df.columns)], ", ".join(f"c{i} string" for i in range(len(df.columns)))).coalesce(
                1).write.csv(parts[0])
        merge_files(spark, parts, f"{work}/whole")
        if mode == "overwrite":
            fs.delete(target, True)
        fs.mkdirs(target)
        fs.rename(hadoop_path(spark, f"{work}/whole")[0], hadoop_path(spark, f"{path}/part-00000-{name}.csv")[0])
    finally:
        fs.delete(hadoop_path(spark, work)[0], True)


def merge_files(spark: SparkSession, folders: Sequence[str], target: str) -> None:
    """The bytes of the part files of ``folders``, in the order of folders and
    then of names, as the file ``target``.  The client copies through one buffer
    of 64 KB, so nothing of the data is held."""
    copy = spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.copyBytes
    to, fs = hadoop_path(spark, target)
    out = fs.create(to, True)
    try:
        for folder in folders:
            at = hadoop_path(spark, folder)[0]
            files = sorted(((st.getPath().getName(), st.getPath()) for st in fs.listStatus(at)), key=lambda f: f[0])
            for name, file in files:
                if name.startswith("part-"):
                    part = fs.open(file)
                    try:
                        copy(part, out, 1 << 16, False)
                    finally:
                        part.close()
    finally:
        out.close()


def write_correlations(cors: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Persist a typed correlation table ``(series_x, series_y, lag, n, r)``
    as Parquet, CSV, or ``text`` lines ``((series_x,series_y,lag),r)`` (the
    tuple layout of the original result files; a null r prints ``NaN``)."""
    if fmt == "csv":
        write_csv(cors, path, mode=mode)
    elif fmt == "parquet":
        cors.write.mode(mode).parquet(path)
    elif fmt == "text":
        r = F.coalesce(F.col("r").cast("string"), F.lit("NaN"))
        line = F.format_string("((%s,%s,%d),%s)", F.col("series_x"), F.col("series_y"), F.col("lag"), r)
        cors.select(line.alias("value")).write.mode(mode).text(path)
    else:
        raise ValueError("fmt must be 'csv', 'parquet' or 'text'")


MARK = "_COMPLETE"


def materialize(df: DataFrame, path: str, labels: Sequence[str] | None = None,
                mode: str = "errorifexists") -> None:
    """Write a scenario table once for reuse; the feature labels are stored as
    a text sidecar, one ``index<TAB>label`` line each.  The completion mark
    comes last: without it ``read_scenario`` refuses the table."""
    path = path.rstrip("/")
    _drop_mark(df.sparkSession, path)
    df.write.mode(mode).parquet(f"{path}/data")
    if labels is not None:
        spark = df.sparkSession
        (spark.createDataFrame([(f"{i}\t{lab}",) for i, lab in enumerate(labels)], "value string").coalesce(1)
         .write.mode(mode).text(f"{path}/labels"))
    mark_complete(df.sparkSession, path)


def hadoop_path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def mark_complete(spark: SparkSession, path: str) -> None:
    """Say that everything under ``path`` is written."""
    p, fs = hadoop_path(spark, f"{path.rstrip('/')}/{MARK}")
    fs.create(p, True).close()


def _drop_mark(spark: SparkSession, path: str) -> None:
    p, fs = hadoop_path(spark, f"{path}/{MARK}")
    fs.delete(p, False)


def is_complete(spark: SparkSession, path: str) -> bool:
    return path_exists(spark, f"{path.rstrip('/')}/{MARK}")


def path_exists(spark: SparkSession, path: str) -> bool:
    p, fs = hadoop_path(spark, path)
    return fs.exists(p)


def read_scenario(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """Reload a materialised scenario and its labels, in the order of their
    stored index (the label file is a handful of names, so reading it to the
    driver is bounded).  Only where there is no sidecar do the labels come from
    the schema; a damaged one is an error, and so is a table without its
    completion mark, whose writer did not get to the end."""
    if not is_complete(spark, path):
        raise FileNotFoundError(f"{path} holds no complete scenario")
    df = spark.read.parquet(f"{path.rstrip('/')}/data")
    sidecar = f"{path.rstrip('/')}/labels"
    if not path_exists(spark, sidecar):
        return df, [c for c, t in df.dtypes if t == "double" and c not in ("lat", "lon")]
    lines = [r.value.split("\t", 1) for r in spark.read.text(sidecar).collect()]
    if any(len(x) != 2 or not x[0].isdigit() for x in lines):
        raise ValueError(f"{sidecar} is not a label file")
    labels = [label for _, label in sorted((int(i), label) for i, label in lines)]
    missing = [c for c in labels if c not in df.columns]
    if missing:
        raise ValueError(f"{sidecar} names columns {missing} that the data lack")
    return df, labels


def vector_to_string(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """ML vector -> ``"[a,b,...]"`` text, dropping the vector column."""
    from pyspark.ml.functions import vector_to_array

    out = out or col
    text = F.concat(F.lit("["), F.array_join(vector_to_array(F.col(col)).cast("array<string>"), ","), F.lit("]"))
    return df.withColumn("__txt", text).drop(col).withColumnRenamed("__txt", out)


def parse_vector_string(df: DataFrame, col: str, labels: Sequence[str] | None = None) -> DataFrame:
    """``"[a,b,...]"`` text -> ``array<double>`` (or one column per label)."""
    arr = F.from_json(F.col(col), "array<double>")
    if labels is None:
        return df.withColumn(col, arr)
    return df.select("*", *[arr[i].alias(lab) for i, lab in enumerate(labels)]).drop(col)
