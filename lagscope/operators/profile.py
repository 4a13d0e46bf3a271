"""Dataset profiling: schema, summary statistics, distinct listings, count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagscope.operators.clean import distinct_values


def schema_profile(df: DataFrame) -> DataFrame:
    """``(column, dtype, nullable)`` for every column (built from the schema
    on the driver; its size is the number of columns, not rows)."""
    rows = [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "column string, dtype string, nullable boolean")


def column_profile(df: DataFrame) -> DataFrame:
    """``(column, dtype, rows, nulls)`` for every column: the schema with what
    one aggregate pass counts."""
    fields = df.schema.fields
    one = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.col(f"`{f.name}`")).alias(f"c{i}") for i, f in enumerate(fields)])
    cells = [F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype"),
                      F.col("n").alias("rows"), (F.col("n") - F.col(f"c{i}")).alias("nulls"))
             for i, f in enumerate(fields)]
    return one.select(F.explode(F.array(*cells)).alias("s")).select("s.*")


def summary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """count / mean / sample stddev / min / max per numeric column, long and
    typed: ``(column, count, mean, stddev, min, max)``.  One aggregate pass
    over ``df`` (partial aggregation), then a tiny unpivot."""
    cols = list(cols)
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"c{i}"), F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}"),
                 F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
    one = df.agg(*aggs)
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("count"), F.col(f"m{i}").alias("mean"),
                      F.col(f"s{i}").alias("stddev"), F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max"))
             for i, c in enumerate(cols)]
    return one.select(F.explode(F.array(*cells)).alias("s")).select("s.*")


def moments(df: DataFrame, keys: Sequence[Column | str], cols: Sequence[str]) -> DataFrame:
    """Mergeable central moments of the columns per key: ``n_<c>``, ``mean_<c>``,
    ``m2_<c>`` (sum of squared distances from that mean), ``min_<c>``,
    ``max_<c>``.  One aggregate, partial before its shuffle; whatever is asked
    of the data afterwards is merged from it (``merged``)."""
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"n_{c}"), F.avg(x).alias(f"mean_{c}"), (F.var_pop(x) * F.count(x)).alias(f"m2_{c}"),
                 F.min(x).alias(f"min_{c}"), F.max(x).alias(f"max_{c}")]
    return df.groupBy(*keys).agg(*aggs)


def merged(parts: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``(by..., column, count, mean, stddev, min, max)`` from ``moments`` of
    finer keys.  The squared distances are moved from the mean of each part to
    the common one, so nothing cancels as it does in sums of squares."""
    by, cols = list(by), list(cols)
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"n_{c}").alias("n"), F.col(f"mean_{c}").alias("m"),
                      F.col(f"m2_{c}").alias("q"), F.col(f"min_{c}").alias("lo"), F.col(f"max_{c}").alias("hi")) for c in cols]
    long = parts.select(*by, F.explode(F.array(*cells)).alias("s")).select(*by, "s.*")
    key = [*by, "column"]
    whole = long.groupBy(*key).agg(F.sum("n").alias("_n"), F.try_divide(F.sum(F.col("m") * F.col("n")), F.sum("n")).alias("_mean"),
                                   F.min("lo").alias("_min"), F.max("hi").alias("_max"))
    whole = whole.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], "_n", "_mean", "_min", "_max")
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)]
    off = F.col("m") - F.col("_mean")
    spread = (long.join(whole, same).groupBy(*key, "_n", "_mean", "_min", "_max")
              .agg(F.sum(F.col("q") + F.col("n") * off * off).alias("_m2")))
    deviation = F.when(F.col("_n") > 1, F.sqrt(F.col("_m2") / (F.col("_n") - 1)))
    return spread.select(*key, F.col("_n").alias("count"), F.col("_mean").alias("mean"), deviation.alias("stddev"),
                         F.col("_min").alias("min"), F.col("_max").alias("max"))


def distinct_units(df: DataFrame) -> DataFrame:
    return distinct_values(df, "unit")


def preview(df: DataFrame, n: int = 20, order_by: Sequence[str] | None = None) -> DataFrame:
    """The first ``n`` rows (of a deterministic order when ``order_by`` is
    given): a bounded look at a result, never the whole table."""
    return (df.orderBy(*order_by) if order_by else df).limit(n)


def row_count(df: DataFrame) -> DataFrame:
    """The number of rows, as a one-row table ``(rows)``."""
    return df.agg(F.count(F.lit(1)).alias("rows"))
