"""Column-level building blocks (native Spark expressions only)."""

from lagscope.functions.exprs import (
    date_bucket,
    l2_norm,
    safe_pearson,
    safe_ratio,
    sanitize_name,
    sanitize_names,
)

__all__ = [
    "date_bucket",
    "l2_norm",
    "safe_pearson",
    "safe_ratio",
    "sanitize_name",
    "sanitize_names",
]
