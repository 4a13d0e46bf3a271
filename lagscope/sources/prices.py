"""Daily price series: ``Date`` (``yyyyMMdd``) and ``Price`` strings.

Output schema::

    date date, price double, year_str string, month_str string, day_str string,
    year int, dayofyear int

(The string parts keep the reference's ``substring`` form; they are
suffixed so they never clash with the integer keys in a case-insensitive
session.)

The raw file may or may not carry a header (the downloader writes none and
appends), so the schema is explicit, the header is a parameter, malformed
dates/prices become null, and repeated dates are collapsed to one row.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW_PRICE_SCHEMA = T.StructType([
    T.StructField("Date", T.StringType()),
    T.StructField("Price", T.StringType()),
])


def read_raw_prices(spark: SparkSession, path: str | list[str], header: bool = True) -> DataFrame:
    return (spark.read.schema(RAW_PRICE_SCHEMA).option("header", header)
            .option("mode", "PERMISSIVE").csv(path))


def parse_prices(raw: DataFrame, years: Iterable[int] | None = None) -> DataFrame:
    """Parse ``Date``/``Price`` strings, add the string date parts and the
    integer ``year``/``dayofyear`` keys, drop unparseable dates, keep one row
    per date (the smallest price, which is deterministic) and optionally
    filter years (a pushable integer predicate)."""
    date = F.try_to_date(F.trim(F.col("Date")), "yyyyMMdd")
    typed = (raw.select(date.alias("date"), F.trim(F.col("Price")).try_cast("double").alias("price"))
             .where(F.col("date").isNotNull()))
    if years is not None:
        typed = typed.where(F.year("date").isin([int(y) for y in years]))
    daily = typed.groupBy("date").agg(F.min("price").alias("price"))
    return daily.select(
        "date", "price",
        F.date_format("date", "yyyy").alias("year_str"),
        F.date_format("date", "MM").alias("month_str"),
        F.date_format("date", "dd").alias("day_str"),
        F.year("date").alias("year"),
        F.dayofyear("date").alias("dayofyear"),
    )


def read_prices(spark: SparkSession, path: str | list[str], header: bool = True,
                years: Iterable[int] | None = None) -> DataFrame:
    return parse_prices(read_raw_prices(spark, path, header), years)
