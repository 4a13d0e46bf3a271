"""lagscope: sparse spatio-temporal sensor analytics on Spark DataFrames.

Ingest and clean raw measurement files, pivot to complete (site, day)
rows, build daily series, smooth, scale and de-seasonalise them, correlate
every series with every other at a list of time lags, and derive heat-map
weights and a per-site cost score.  Every operator is a lazy
``DataFrame -> DataFrame`` function built from native Spark expressions.
"""

from lagscope.functions.exprs import l2_norm, safe_pearson, safe_ratio, sanitize_name
from lagscope.operators.clean import (
    complete_case_long,
    complete_rows,
    criteria_list,
    distinct_values,
    snap_coordinates,
    sort_by_date,
    text_filter,
    validate_columns,
    year_filter,
)
from lagscope.operators.reshape import melt, pivot_wide
from lagscope.operators.scale import max_abs, min_max, zscore, zscore_max_abs
from lagscope.operators.score import cost_score
from lagscope.operators.series import (
    climatology,
    daily_mean,
    deseason,
    ema,
    gradient,
    shift,
    sma,
)
from lagscope.operators.spatial import heat_points, heat_weights, latest_per_site, spatial_density
from lagscope.operators.xcorr import (
    adjacency,
    auto_correlation,
    correlation_mass,
    correlation_matrix,
    lagged_correlation,
)
from lagscope.operators.cluster import cluster_members, density_clusters, pca_projection
from lagscope.operators.profile import preview, schema_profile, summary
from lagscope.sources.measurements import normalize_measurements, read_measurements, year_list
from lagscope.sources.prices import read_prices
from lagscope.sources.sinks import materialize, write_csv

# Short names used in the design notes.
criteria = criteria_list
cluster = density_clusters
pca = pca_projection
profile = summary

__all__ = [name for name in dir() if not name.startswith("_")]
