"""Scenarios: the prepared daily tables the analytics consume, as a small
declarative table instead of one hand-written function per case.

A scenario names measurement classes, a year range and a grain
(``national``: one row per day, the mean over the complete sites of that
day; ``site``: one row per site and day).  ``build_scenario`` reads the raw
files once, pivots to complete (site, day) rows, aggregates to the grain,
optionally keeps partial aggregates and the result (Parquet + label sidecar) in
a store that follows the source files, and optionally z-scores it.  Price scenarios are the parsed price series of a
year range, z-scored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lagscope.operators import clean, reshape, scale, series
from lagscope.sources import measurements, prices
from lagscope.sources import store as store_of


@dataclass(frozen=True)
class Scenario:
    name: str
    classes: tuple[str, ...]
    years: tuple[int, ...]
    grain: str = "national"          # or "site"
    scaled: bool = True              # z-score the feature columns
    persist: bool = False            # materialise under the store path


# The scenarios of the reference's analyses.
SCENARIOS = {
    s.name: s for s in [
        Scenario("gasses_2014_2019_site", ("gasses/*",), tuple(range(2014, 2020)), "site", persist=True),
        Scenario("gasses_2014_2019", ("gasses/*",), tuple(range(2014, 2020)), "national", persist=True),
        Scenario("toxics_2014_2019", ("toxics/*",), tuple(range(2014, 2020)), "national", persist=True),
        Scenario("gasses_2019", ("gasses/*",), (2019,), "national"),
        Scenario("toxics_2019", ("toxics/*",), (2019,), "national"),
    ]
}
PRICE_SCENARIOS = {"price_2019": (2019,), "price_2014_2019": tuple(range(2014, 2020))}


def _store_path(store: str, name: str) -> str:
    return f"{store.rstrip('/')}/{name}"


def daily_table(long: DataFrame, criteria: list[str] | None = None, grain: str = "national",
                precision: int = 3) -> tuple[DataFrame, list[str]]:
    """Long measurements -> complete (site, day) rows -> the grain's daily
    table.  Returns the table and its feature labels (sanitised names)."""
    if criteria is None:
        wide, _, labels = reshape.discover_pivot(long, precision=precision)
    else:
        wide = reshape.pivot_wide(long, criteria, precision=precision, drop_null=True)
        labels = [c for c in wide.columns if c not in ("lat", "lon", "date")]
    return _to_grain(wide, labels, grain), labels


def _to_grain(wide: DataFrame, labels: list[str], grain: str) -> DataFrame:
    by = ["lat", "lon"] if grain == "site" else []
    if grain not in ("site", "national"):
        raise ValueError("grain must be 'site' or 'national'")
    return series.daily_mean(wide, labels, by=by)


def _source(spark: SparkSession, root: str | None, sc: Scenario, table: str | None):
    """The scenario's source files and how a list of their paths is read."""
    if table is None:
        files = store_of.list_files(spark, measurements.measurement_globs(root, sc.classes, sc.years))
        return files, lambda paths: measurements.normalize_measurements(
            measurements.read_raw_measurements(spark, paths, keep_file=True), keep=("file",))
    classes = sorted({c.split("/")[0] for c in sc.classes})
    globs = [f"{table.rstrip('/')}/class={c}/year={y}/*.parquet" for c in classes for y in sc.years]
    return store_of.list_files(spark, globs), lambda paths: measurements.read_measurement_files(spark, table, paths)


def build_scenario(spark: SparkSession, root: str | None, scenario: Scenario | str,
                   store: str | None = None, table: str | None = None) -> tuple[DataFrame, list[str]]:
    """The scenario's daily table and labels (z-scored when ``scaled``).

    Input is either the raw files under ``root`` or, with ``table``, the
    landed ``class=/year=`` Parquet table (typed columns, class and year
    partitions pruned).  With ``store`` and ``persist``, the partial aggregates
    of every input file are kept (see ``sources.store``): later calls read only
    files that are new or changed, and where there are none they reload the
    finished table."""
    sc = SCENARIOS[scenario] if isinstance(scenario, str) else scenario
    if store and sc.persist:
        files, read = _source(spark, root, sc, table)
        kept = store_of.PartialStore(spark, _store_path(store, sc.name))
        kept.update(files, lambda paths: reshape.criterion_sums(read(paths), with_unit=True, extra_keys=["file"]))

        def make(sums: DataFrame) -> tuple[DataFrame, list[str]]:
            wide, labels = reshape.discover_sums(sums)
            return _to_grain(wide, labels, sc.grain), labels

        daily, labels = kept.daily(files, f"grain={sc.grain}", make)
    else:
        if table is not None:
            classes = sorted({c.split("/")[0] for c in sc.classes})
            long = measurements.read_measurement_table(spark, table, classes, sc.years)
        else:
            long = measurements.read_measurements(spark, root, sc.classes, sc.years)
        daily, labels = daily_table(long, grain=sc.grain)
    if sc.scaled:
        daily = scale.zscore(daily, labels)
    return daily, labels


def price_scenario(spark: SparkSession, path: str, years=None, header: bool = True,
                   scaled: bool = True) -> DataFrame:
    """Daily price of the given years, z-scored (``price``)."""
    p = prices.read_prices(spark, path, header=header, years=years)
    return scale.zscore(p, ["price"]) if scaled else p


def prepared_measurements(long: DataFrame, criteria: list[str] | None = None, periods: int = 12) -> tuple[DataFrame, list[str]]:
    """Complete (site, day) rows -> centred SMA per site -> the smoothed
    columns, z-scored then max-abs scaled."""
    if criteria is None:
        wide, _, labels = reshape.discover_pivot(long)
    else:
        wide = reshape.pivot_wide(long, criteria, drop_null=True)
        labels = [c for c in wide.columns if c not in ("lat", "lon", "date")]
    sm = series.sma(wide, ["lat", "lon"], labels, periods=periods)
    cols = [f"{c}_sma{periods}" for c in labels]
    sm = clean.select_like(sm, "_sma", keep=["lat", "lon", "date"])
    return scale.zscore_max_abs(sm, cols), cols


def prepared_prices(price: DataFrame) -> DataFrame:
    """The price column z-scored then max-abs scaled."""
    return scale.zscore_max_abs(price.select("date", "price"), ["price"])


def feature_matrix(wide: DataFrame, cols: list[str], date_col: str = "date") -> DataFrame:
    """Machine-learning layout of a pivoted table: one row per (site, time),
    ``lat``, ``lon`` and ``time`` (hours since the epoch) min-max scaled to
    [0, 1], then the criteria z-scored and max-abs scaled to [-1, 1]."""
    from pyspark.sql import functions as F

    hours = (F.datediff(F.col(date_col), F.lit("1970-01-01").cast("date")) * 24).cast("double")
    base = wide.select(F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"),
                       hours.alias("time"), *cols)
    # all statistics come from ``base`` (one merged aggregate), one projection
    # statistics of ``base`` only (Catalyst merges the two subqueries)
    return base.withColumns({**scale.min_max_exprs(base, ["lat", "lon", "time"]),
                             **scale.zscore_max_abs_exprs(base, cols)})


def restrict_years(df: DataFrame, years) -> DataFrame:
    return clean.year_filter(df, years) if years is not None else df


__all__ = ["Scenario", "SCENARIOS", "PRICE_SCENARIOS", "build_scenario", "daily_table", "price_scenario",
           "prepared_measurements", "prepared_prices", "feature_matrix", "restrict_years"]
