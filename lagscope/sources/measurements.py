"""Raw hourly measurement files -> the long, typed measurement table.

Layout on disk: ``<root>/<class>/<subclass>/<name>_<year>.csv`` with a
header row and all-string columns.  The whole selection is read by **one**
CSV scan over the resolved file list (no per-file read + union), only the
nine relevant columns are kept (CSV column pruning), and the typed
normalisation is a single ``select`` of native expressions.

Long schema (``MEASUREMENT_COLUMNS``)::

    criteria string, state string, county string, lat double, lon double,
    ts timestamp, date date, value double, unit string
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagscope.sources import headers

# The raw column names read from every measurement file, in
# file order, and the names they take after normalisation.
RAW_COLUMNS = [
    "Parameter Name",
    "State Name",
    "County Name",
    "Latitude",
    "Longitude",
    "Date GMT",
    "Time GMT",
    "Sample Measurement",
    "Units of Measure",
]
MEASUREMENT_COLUMNS = ["criteria", "state", "county", "lat", "lon", "ts", "date", "value", "unit"]

COORD_DIGITS = 6
VALUE_DIGITS = 10


def year_list(start: int, end: int | None = None) -> list[int]:
    """Inclusive year range, or a single year when ``end`` is omitted."""
    if end is None:
        return [int(start)]
    if end < start:
        raise ValueError("end year before start year")
    return list(range(int(start), int(end) + 1))


def measurement_globs(root: str, classes: Sequence[str], years: Iterable[int]) -> list[str]:
    """Glob per (class, year): ``<root>/<class>/*<year>*.csv``.  A class may
    itself be a glob such as ``gasses/*``."""
    root = root.rstrip("/")
    out: list[str] = []
    for cls in dict.fromkeys(c.strip("/") for c in classes):
        for y in dict.fromkeys(years):
            out.append(f"{root}/{cls}/*{y}*.csv")
    return out


def resolve_paths(spark: SparkSession, globs: Sequence[str]) -> list[str]:
    """Expand globs with the Hadoop filesystem and de-duplicate the *resolved*
    paths, so overlapping class globs never scan a file twice."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    seen: dict[str, None] = {}
    for g in globs:
        path = jvm.org.apache.hadoop.fs.Path(g)
        fs = path.getFileSystem(conf)
        statuses = fs.globStatus(path)
        if statuses is None:
            continue
        for st in statuses:
            if st.isFile():
                seen[st.getPath().toString()] = None
    return sorted(seen)


def read_raw_measurements(spark: SparkSession, paths: Sequence[str], keep_file: bool = False) -> DataFrame:
    """One header-CSV scan over all paths, all columns as strings, pruned to
    ``RAW_COLUMNS`` (other columns in the files are ignored).  Every file's
    header is checked against the first one's: a file with its columns in
    another order fails instead of being misread.  ``keep_file`` adds the URI
    of each row's file as ``file``."""
    if not paths:
        raise FileNotFoundError("no measurement files matched")
    raw = (spark.read.option("header", True).option("inferSchema", False).option("enforceSchema", False)
           .option("mode", "PERMISSIVE").csv(list(paths)))
    missing = [c for c in RAW_COLUMNS if c not in raw.columns]
    if missing:
        raise ValueError(f"measurement files lack columns {missing}")
    file = [F.col("_metadata.file_path").alias("file")] if keep_file else []
    return raw.select(*[F.col(f"`{c}`") for c in RAW_COLUMNS], *file)


def normalize_measurements(raw: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Typed long table from the nine raw string columns.

    * criteria: ``&`` -> ``and``; state/county lower-cased
    * lat/lon rounded to 6 digits, value to 10; malformed numbers -> null
    * date + time (``yyyy-MM-dd`` + ``H:mm``) parsed to ``ts``; ``date`` is
      its day.  Malformed dates -> null (never an ANSI error)

    ``keep`` names extra columns passed through unchanged.
    """
    c = {name: F.col(f"`{name}`") for name in RAW_COLUMNS}
    ts = F.try_to_timestamp(F.concat_ws(" ", F.trim(c["Date GMT"]), F.trim(c["Time GMT"])),
                            F.lit("yyyy-MM-dd H:mm"))
    return raw.select(
        F.regexp_replace(c["Parameter Name"], "&", "and").alias("criteria"),
        F.lower(c["State Name"]).alias("state"),
        F.lower(c["County Name"]).alias("county"),
        F.round(F.trim(c["Latitude"]).try_cast("double"), COORD_DIGITS).alias("lat"),
        F.round(F.trim(c["Longitude"]).try_cast("double"), COORD_DIGITS).alias("lon"),
        ts.alias("ts"),
        F.to_date(ts).alias("date"),
        F.round(F.trim(c["Sample Measurement"]).try_cast("double"), VALUE_DIGITS).alias("value"),
        c["Units of Measure"].alias("unit"),
        *[F.col(k) for k in keep],
    )


def read_measurements(spark: SparkSession, root: str, classes: Sequence[str],
                      years: Iterable[int]) -> DataFrame:
    """Select files by class x year, scan them once, normalise."""
    paths = resolve_paths(spark, measurement_globs(root, classes, list(years)))
    return normalize_measurements(read_raw_measurements(spark, paths))


def read_measurement_table(spark: SparkSession, path: str, classes: Sequence[str] | None = None,
                           years: Iterable[int] | None = None) -> DataFrame:
    """Read a landed, ``class=/year=`` partitioned Parquet measurement table;
    class and year predicates prune partitions instead of globbing files."""
    df = spark.read.parquet(path)
    if classes is not None:
        df = df.where(F.col("class").isin(list(classes)))
    if years is not None:
        df = df.where(F.col("year").isin([int(y) for y in years]))
    return df


def read_measurement_files(spark: SparkSession, table: str, paths: Sequence[str]) -> DataFrame:
    """The given files of a landed measurement table, with the URI of each
    row's file as ``file``."""
    df = spark.read.option("basePath", table).parquet(*paths)
    return df.withColumn("file", F.col("_metadata.file_path"))


def combine_class_csvs(spark: SparkSession, root: str, out: str, mode: str = "errorifexists",
                       rejects: str | None = None) -> None:
    """Land every ``<root>/<class>/<subclass>/*.csv`` as one Parquet table
    partitioned by class and year: class and subclass come from the file
    path, the selection of columns and types from ``normalize_measurements``.
    Files are read by their own headers (``headers.read_by_header``: one scan
    per header), so they may differ in order and in columns nobody needs.
    Files and records that can't be read go to ``rejects`` (Parquet: file,
    record, reason; a scan of its own), if named; no other record is lost."""
    paths = resolve_paths(spark, [f"{root.rstrip('/')}/*/*/*.csv"])
    raw, refused = headers.read_by_header(spark, paths, RAW_COLUMNS)
    pattern = r"/([^/]+)/([^/]+)/[^/]+\.csv$"
    raw = raw.withColumns({"class": F.regexp_extract("file", pattern, 1),
                           "subclass": F.regexp_extract("file", pattern, 2)})
    typed = normalize_measurements(raw, keep=("class", "subclass"))
    (typed.withColumn("year", F.year("date"))
     .write.mode(mode).partitionBy("class", "year").parquet(out))
    if rejects is not None:
        refused.write.mode(mode).parquet(rejects)


def source_inventory(spark: SparkSession, root: str) -> DataFrame:
    """Count data files per class and subclass.  Uses the ``binaryFile``
    source with only path and length selected, so file contents are never
    read."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .load(root.rstrip("/")).select("path", "length"))
    rel = F.regexp_extract("path", r"/([^/]+)/([^/]+)/[^/]+$", 0)
    return (files.select(
        F.regexp_extract(rel, r"^/([^/]+)/", 1).alias("class"),
        F.regexp_extract(rel, r"^/[^/]+/([^/]+)/", 1).alias("subclass"),
        "length")
        .groupBy("class", "subclass")
        .agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes")))
