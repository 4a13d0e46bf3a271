"""Projection, filtering and cleaning operators on the long table."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagscope.functions.exprs import sanitize_names


def snap_coordinates(df: DataFrame, precision: int = 3, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Round coordinates to ``precision`` decimals (3 ~ 111 m), the grid key
    that merges co-located sensors."""
    return df.withColumns({lat: F.round(lat, precision), lon: F.round(lon, precision)})


def complete_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Wide complete-case filter: drop rows with a null in any of ``cols``."""
    return df.na.drop(how="any", subset=list(cols) if cols else None)


def complete_case_long(df: DataFrame, keys: Sequence[str], criteria: Sequence[str],
                       criteria_col: str = "criteria", value_col: str = "value") -> DataFrame:
    """Long-form complete-case filter: aggregate to one mean per (keys,
    criterion) and keep the key groups that carry *every* criterion.

    The count-per-key is a window over the key group, which holds one row per
    criterion after the aggregate, so no group grows with the raw data.
    """
    crit = list(criteria)
    per = (df.where(F.col(criteria_col).isin(crit) & F.col(value_col).isNotNull())
           .groupBy(*keys, criteria_col).agg(F.avg(value_col).alias(value_col)))
    w = Window.partitionBy(*keys)
    return (per.withColumn("_k", F.count(F.lit(1)).over(w))
            .where(F.col("_k") == len(crit)).drop("_k"))


def year_filter(df: DataFrame, years: Iterable[int], date_col: str = "date") -> DataFrame:
    """Keep rows whose year is in ``years`` (a typed, pushable predicate; a
    contiguous list becomes a date range so Parquet can prune by min/max)."""
    ys = sorted({int(y) for y in years})
    if ys and ys == list(range(ys[0], ys[-1] + 1)):
        return df.where((F.col(date_col) >= F.lit(f"{ys[0]}-01-01").cast("date"))
                        & (F.col(date_col) < F.lit(f"{ys[-1] + 1}-01-01").cast("date")))
    return df.where(F.year(date_col).isin(ys))


def text_filter(df: DataFrame, needle: str, cols: Sequence[str] | None = None) -> DataFrame:
    """Keep rows whose whole-row text (all or the given columns, cast to
    string, space-joined, lower-cased) contains ``needle``."""
    cols = list(cols) if cols else df.columns
    text = F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in cols]))
    return df.where(text.contains(needle.lower()))


def sanitize_columns(df: DataFrame) -> DataFrame:
    """Rename every column to ``[0-9A-Za-z_]`` in one projection; fails when
    two names collide after cleaning."""
    return df.toDF(*sanitize_names(df.columns))


def repair_aggregate_names(df: DataFrame) -> DataFrame:
    """``avg(X)`` -> ``X`` and ``year(date)`` -> ``year`` in one projection."""
    pat = re.compile(r"^[A-Za-z_]+\((.*)\)$")
    out = []
    for c in df.columns:
        m = pat.match(c)
        if m and c.split("(", 1)[0] in ("avg", "mean", "sum", "min", "max", "first"):
            out.append(m.group(1))
        elif m:
            out.append(c.split("(", 1)[0])
        else:
            out.append(c)
    return df.toDF(*out)


def select_like(df: DataFrame, fragment: str, keep: Sequence[str] = ()) -> DataFrame:
    """Select the key columns plus every column whose name contains
    ``fragment`` (e.g. ``_sma``)."""
    return df.select(*keep, *[c for c in df.columns if fragment in c and c not in keep])


def validate_columns(df: DataFrame, required: Sequence[str], types: dict[str, str] | None = None) -> DataFrame:
    """Ingress check: every required column present (and of the given simple
    type when ``types`` is passed); returns ``df`` unchanged."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    if types:
        actual = dict(df.dtypes)
        bad = {c: (actual.get(c), t) for c, t in types.items() if actual.get(c) != t}
        if bad:
            raise TypeError(f"column types differ (actual, expected): {bad}")
    return df


def distinct_values(df: DataFrame, col: str = "criteria") -> DataFrame:
    """Distinct non-null values of a column, sorted (deterministic order)."""
    return df.select(col).where(F.col(col).isNotNull()).distinct().orderBy(col)


def criteria_list(df: DataFrame, col: str = "criteria") -> list[str]:
    """Driver-side sorted list of distinct criteria.  The result is bounded
    by the number of measured parameters (not by data volume); it is used
    to fix pivot columns so the pivot needs no extra distinct job."""
    return [r[0] for r in distinct_values(df, col).collect()]


def sort_by_date(df: DataFrame, ascending: bool = True, date_col: str = "date") -> DataFrame:
    return df.orderBy(F.col(date_col).asc() if ascending else F.col(date_col).desc())
