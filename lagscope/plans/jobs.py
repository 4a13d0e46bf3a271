"""The analyses as jobs: scenario in, typed result out (and optionally
written).  Each returns its result DataFrame so callers can inspect, chain
or write it; nothing is printed or collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagscope.operators import clean, profile, reshape, scale, score, spatial, xcorr
from lagscope.plans import scenarios as sc
from lagscope.session import checkpoint_dir
from lagscope.sources import measurements, sinks

# Lag lists of the correlation jobs.
AUTO_LAGS = [-90, -60, -30, -10, 0, 10, 30, 60, 90]
PRICE_LAGS = [-60, -30, -10, 0, 10, 30, 60]
TOXICS_LAGS = [-30, -10, 0, 10, 30]


def _out(df: DataFrame, path: str | None, fmt: str = "parquet", mode: str = "errorifexists") -> DataFrame:
    if path:
        sinks.write_correlations(df, path, fmt=fmt, mode=mode)
    return df


def autocorrelation(spark: SparkSession, root: str, scenario: str = "gasses_2014_2019",
                    lags: Sequence[int] = AUTO_LAGS, store: str | None = None, out: str | None = None,
                    fmt: str = "parquet") -> DataFrame:
    """Every criterion against every criterion of the same scenario; ``fmt``
    is the form of ``out``: parquet, csv or text."""
    daily, labels = sc.build_scenario(spark, root, scenario, store)
    return _out(xcorr.auto_correlation(daily, lags, labels), out, fmt)


def price_correlation(spark: SparkSession, root: str, price_path: str, scenario: str = "gasses_2019",
                      years: Sequence[int] | None = None, lags: Sequence[int] = PRICE_LAGS,
                      store: str | None = None, out: str | None = None, price_header: bool = True,
                      fmt: str = "parquet") -> DataFrame:
    """Criteria of a scenario against the daily price, positional lags over
    the days both have."""
    daily, labels = sc.build_scenario(spark, root, scenario, store)
    yrs = years if years is not None else sc.SCENARIOS[scenario].years
    price = sc.price_scenario(spark, price_path, years=yrs, header=price_header)
    return _out(xcorr.lagged_correlation(daily, price, lags, labels, ["price"]), out, fmt)


def gas_price_2019(spark, root, price_path, **kw):
    return price_correlation(spark, root, price_path, "gasses_2019", lags=PRICE_LAGS, **kw)


def gas_price_2014_2019(spark, root, price_path, **kw):
    return price_correlation(spark, root, price_path, "gasses_2014_2019", lags=PRICE_LAGS, **kw)


def toxics_price_2019(spark, root, price_path, **kw):
    return price_correlation(spark, root, price_path, "toxics_2019", lags=TOXICS_LAGS, **kw)


def toxics_price_2014_2019(spark, root, price_path, **kw):
    return price_correlation(spark, root, price_path, "toxics_2014_2019", lags=TOXICS_LAGS, **kw)


def cost_scores(spark: SparkSession, root: str, price_path: str, year: int = 2019, lag: int = 10,
                classes: Sequence[str] = ("gasses/*",), latest_priced: bool = False,
                out: str | None = None, price_header: bool = True) -> DataFrame:
    """Per-site cost score of one year, optionally written as a single CSV
    ``lat, lon, score`` (the result has one row per site)."""
    wide, _, labels = reshape.discover_pivot(measurements.read_measurements(spark, root, classes, [year]))
    price = sc.price_scenario(spark, price_path, years=[year], header=price_header, scaled=False)
    res = score.cost_score(wide, labels, price, lag=lag, latest_priced=latest_priced)
    if out:
        sinks.write_csv(res.select("lat", "lon", "score"), out, single=True, mode="overwrite", order_by=["lat", "lon"])
    return res


def heatmap(spark: SparkSession, root: str, year: int = 2019, factor: float = 10.0,
            scenario: str = "gasses_2014_2019_site", store: str | None = None, out: str | None = None,
            points: bool = True) -> DataFrame:
    """Heat-map points of one year: the per-site scenario is z-scored over
    all its years, then filtered (fit-then-filter).  Writes a single header
    CSV of ``lat, lon`` rows when ``out`` is given."""
    base = sc.Scenario(**{**sc.SCENARIOS[scenario].__dict__, "scaled": False})
    daily, labels = sc.build_scenario(spark, root, base, store)
    weights = spatial.heat_weights(daily, labels, year=year, factor=factor)
    res = spatial.heat_points(weights) if points else weights
    if out:
        sinks.write_csv(res, out, single=True, mode="overwrite")
    return res


def profile_dataset(spark: SparkSession, root: str, years: Sequence[int], classes: Sequence[str] = ("gasses/*",),
                    precision: int = 3) -> dict[str, DataFrame]:
    """Schema, summary statistics (overall and per criterion and unit),
    distinct units and criteria, and the pivoted table z-scored then max-abs
    scaled.

    The raw files are read once: one grouping per (site, day, criterion, unit)
    keeps mergeable moments of the coordinates and the value, and is
    checkpointed; every table derives from it."""
    long = measurements.read_measurements(spark, root, classes, years)
    checkpoint_dir(spark)
    numbers = ["lat", "lon", "value"]
    keys = [F.round(c, precision).alias(f"site_{c}") for c in ("lat", "lon")] + ["date", "criteria", "unit"]
    parts = profile.moments(long, keys, numbers).checkpoint()
    sums = (parts.groupBy(F.col("site_lat").alias("lat"), F.col("site_lon").alias("lon"), "date", "criteria")
            .agg(F.sum(F.col("mean_value") * F.col("n_value")).alias("_s"), F.sum("n_value").alias("_n")))
    wide, labels = reshape.discover_sums(sums)
    return {
        "schema": profile.schema_profile(long),
        "summary": profile.merged(parts, numbers),
        "by_criterion": profile.merged(parts, ["value"], ["criteria", "unit"]).drop("column"),
        "units": profile.distinct_units(parts),
        "criteria": clean.distinct_values(parts, "criteria"),
        "scaled": scale.zscore_max_abs(wide, labels),
    }


__all__ = ["autocorrelation", "price_correlation", "gas_price_2019", "gas_price_2014_2019", "toxics_price_2019",
           "toxics_price_2014_2019", "cost_scores", "heatmap", "profile_dataset"]
