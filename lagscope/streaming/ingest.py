"""Incremental landing of raw measurement files with Structured Streaming.

New yearly files arrive in ``<root>/<class>/<subclass>/``.  The file stream
source tracks which files were processed (in the query checkpoint), so each
run normalises only the new files and appends them to the ``class=/year=``
partitioned Parquet table that ``read_measurement_table`` prunes.  With
``availableNow`` the query processes everything present and stops, so the
landing can run as a scheduled batch job with exactly-once file semantics
and survive executor loss (state lives in the checkpoint folder).
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lagscope.sources.measurements import RAW_COLUMNS, normalize_measurements, resolve_paths

_PATH = r"/([^/]+)/([^/]+)/[^/]+\.csv$"


def raw_schema(spark: SparkSession, root: str):
    """All-string schema of the landing files, from the header of one file
    (the stream source needs a fixed schema)."""
    sample = resolve_paths(spark, [f"{root.rstrip('/')}/*/*/*.csv"])
    if not sample:
        raise FileNotFoundError(f"no measurement files under {root}")
    schema = spark.read.option("header", True).csv(sample[0]).schema
    missing = [c for c in RAW_COLUMNS if c not in schema.fieldNames()]
    if missing:
        raise ValueError(f"landing files lack columns {missing}")
    return schema


def _claim(spark: SparkSession, out: str, checkpoint: str) -> None:
    """An output belongs to the checkpoint that first wrote it (named in its
    ``_ingest`` folder).  With another one the sink would take new batches for
    batches it has committed already and drop them without an error."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    mark = f"{out.rstrip('/')}/_ingest"
    if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(mark)):
        owner = spark.read.text(mark).first().value
        if owner != checkpoint:
            raise ValueError(f"{out} was written with checkpoint {owner}, not {checkpoint}")
    elif fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out.rstrip('/')}/_spark_metadata")):
        raise ValueError(f"{out} was written by a stream with an unknown checkpoint")
    else:
        spark.createDataFrame([(checkpoint,)], "value string").coalesce(1).write.text(mark)


def ingest(spark: SparkSession, root: str, out: str, checkpoint: str,
           max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Start an ``availableNow`` stream landing new CSV files into ``out``;
    the caller waits with ``awaitTermination()``.  ``checkpoint`` is a lasting
    shared folder, the same for every run into ``out``; another one is refused."""
    checkpoint = checkpoint.rstrip("/")
    _claim(spark, out, checkpoint)
    # a file whose header is in another order than the schema fails
    reader = (spark.readStream.schema(raw_schema(spark, root)).option("header", True)
              .option("enforceSchema", False))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = reader.csv(f"{root.rstrip('/')}/*/*/*.csv")
    path = F.col("_metadata.file_path")
    raw = raw.select(*[F.col(f"`{c}`") for c in RAW_COLUMNS],
                     F.regexp_extract(path, _PATH, 1).alias("class"),
                     F.regexp_extract(path, _PATH, 2).alias("subclass"))
    typed = normalize_measurements(raw, keep=("class", "subclass")).withColumn("year", F.year("date"))
    return (typed.writeStream.format("parquet").outputMode("append")
            .option("checkpointLocation", checkpoint).partitionBy("class", "year")
            .trigger(availableNow=True).start(out))
