"""Per-site operators: latest row, heat-map weights and points, density."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagscope.functions.exprs import l2_norm
from lagscope.operators.scale import zscore


def latest_per_site(df: DataFrame, cols: Sequence[str], site: Sequence[str] = ("lat", "lon"),
                    date_col: str = "date") -> DataFrame:
    """The row of each site's latest day: one aggregate of ``max(struct(date,
    ...))`` (partial per partition, deterministic, no join back)."""
    m = F.max(F.struct(F.col(date_col).alias(date_col), *[F.col(c) for c in cols])).alias("_m")
    return df.groupBy(*site).agg(m).select(*site, "_m.*")


def heat_weights(df: DataFrame, cols: Sequence[str], year: int | None = None, factor: float = 10.0,
                 date_col: str = "date") -> DataFrame:
    """Heat-map weight per (site, day): z-score the features over **all**
    rows (fit before filtering), keep ``year``, take the L2 norm and weight =
    ``trunc(norm * factor)``.  Output ``(lat, lon, date, norm, weight)``."""
    norm = l2_norm(*cols)
    z = zscore(df, cols).select("lat", "lon", date_col, norm.alias("norm"))
    if year is not None:
        # the predicate reads the norm, so it stays above the aggregation that
        # the statistics read too: both share one scan of the raw rows
        of = F.when(F.coalesce("norm", F.lit(0.0)) >= 0, F.year(date_col))
        z = z.where(of == int(year))
    return z.select("*", F.floor(F.col("norm") * F.lit(float(factor))).cast("int").alias("weight"))


def heat_points(weights: DataFrame) -> DataFrame:
    """Expanded point cloud: each (lat, lon) repeated ``weight`` times (zero
    weight -> no row).  The compact ``heat_weights`` form is preferable for
    transport; this is the format point-based renderers consume.  Rows are
    dealt out by (site, day) before they are repeated and keep that order, so a
    site with most of the points is many tasks."""
    keys = [c for c in ("lat", "lon", "date") if c in weights.columns]
    weights = weights.repartitionByRange(*keys).sortWithinPartitions(*keys)
    pts = F.explode(F.array_repeat(F.struct("lat", "lon"), F.greatest(F.col("weight"), F.lit(0))))
    return weights.select(pts.alias("p")).select("p.lat", "p.lon")


def spatial_density(df: DataFrame, precision: int = 1, weight: str | None = None) -> DataFrame:
    """Points binned on a ``precision``-decimal grid: count and optional
    weight sum per cell."""
    aggs = [F.count(F.lit(1)).alias("n")]
    if weight is not None:
        aggs.append(F.sum(weight).alias("weight"))
    return (df.groupBy(F.round("lat", precision).alias("lat"), F.round("lon", precision).alias("lon"))
            .agg(*aggs))
