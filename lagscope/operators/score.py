"""Per-site pollution cost score.

score = |z(smoothed features)| on the site's latest day / |z(price)| that day.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagscope.functions.exprs import l2_norm, safe_ratio
from lagscope.operators.scale import zscore
from lagscope.operators.series import sma
from lagscope.operators.spatial import latest_per_site


def cost_score(wide: DataFrame, cols: Sequence[str], price: DataFrame, lag: int = 10,
               latest_priced: bool = False, price_col: str = "price") -> DataFrame:
    """Cost score per site.

    1. centred SMA of ``lag`` rows per site (window partitioned by site);
    2. z-score of the smoothed columns over all sites and days;
    3. L2 norm on each site's latest day (``latest_priced`` -> the latest day
       that has a price; otherwise sites whose latest day has no price drop
       out, as an inner join does);
    4. divided by |z(price)| of that day; a zero price norm gives null.

    ``price``: ``(date, price)``, one row per day.  Output
    ``(lat, lon, date, norm, price_norm, score)``.
    """
    smoothed = sma(wide, ["lat", "lon"], cols, periods=lag)
    scols = [f"{c}_sma{lag}" for c in cols]
    z = zscore(smoothed.select("lat", "lon", "date", *scols), scols)
    z = z.select("lat", "lon", "date", l2_norm(*scols).alias("norm"))
    p = price.select("date", price_col)
    pz = zscore(p, [price_col]).select("date", F.abs(price_col).alias("price_norm"))
    if latest_priced:
        # price the days first, then take each site's latest priced day
        latest = latest_per_site(z.join(pz, "date"), ["norm", "price_norm"])
    else:
        latest = latest_per_site(z, ["norm"]).join(pz, "date")
    return latest.select("lat", "lon", "date", "norm", "price_norm",
                         safe_ratio("norm", "price_norm").alias("score"))
