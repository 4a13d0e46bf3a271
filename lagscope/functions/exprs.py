"""Native column expressions shared by the operators.

Everything here returns a ``Column`` built from ``pyspark.sql.functions``,
so it stays inside whole-stage codegen; no Python UDFs.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def l2_norm(*cols: ColumnOrName) -> Column:
    """Euclidean norm of the given numeric columns, ``sqrt(sum(c*c))``."""
    if len(cols) == 1 and isinstance(cols[0], (list, tuple)):
        cols = tuple(cols[0])
    if not cols:
        raise ValueError("l2_norm needs at least one column")
    total = None
    for c in cols:
        sq = _col(c) * _col(c)
        total = sq if total is None else total + sq
    return F.sqrt(total)


def safe_ratio(num: ColumnOrName, den: ColumnOrName) -> Column:
    """``num / den`` that yields null for a zero divisor instead of raising
    under ANSI mode."""
    return F.try_divide(_col(num), _col(den))


def safe_pearson(x: ColumnOrName, y: ColumnOrName) -> Column:
    """Aggregate: sample Pearson correlation of the non-null (x, y) pairs.

    ``corr`` raises DIVIDE_BY_ZERO on a constant input under ANSI mode, so the
    coefficient is assembled from the built-in (numerically stable, partially
    aggregated) ``covar_samp`` / ``stddev_samp``.  A constant series, a single
    pair or no pair at all gives null; rounding never takes r beyond [-1, 1].
    """
    x, y = _col(x), _col(y)
    both = x.isNotNull() & y.isNotNull()
    xs = F.when(both, x)
    ys = F.when(both, y)
    r = F.try_divide(F.covar_samp(xs, ys), F.stddev_samp(xs) * F.stddev_samp(ys))
    return F.when(r > 1, F.lit(1.0)).when(r < -1, F.lit(-1.0)).otherwise(r)


_BUCKETS = {
    "hourly": F.hour,
    "daily": F.dayofmonth,       # day of the month, as the reference defines "daily"
    "dayofmonth": F.dayofmonth,
    "dayofyear": F.dayofyear,
    "monthly": F.month,
    "yearly": F.year,
}


def date_bucket(c: ColumnOrName, freq: str) -> Column:
    """Seasonal bucket of a date/timestamp: hour, day of month, day of year,
    month or year.  Unknown frequencies raise."""
    try:
        fn = _BUCKETS[freq]
    except KeyError:
        raise ValueError(f"unknown frequency {freq!r}; use one of {sorted(_BUCKETS)}") from None
    return fn(_col(c))


_UNSAFE = re.compile(r"[^0-9A-Za-z_]+")
_MINUS = re.compile(r"(?<![0-9A-Za-z])-(?=[0-9])")


def sanitize_name(name: str) -> str:
    """Column-safe name: every run of characters outside ``[0-9A-Za-z_]``
    becomes one underscore, ends trimmed (``PM2.5`` -> ``PM2_5``).  The sign of
    a negative number is kept as ``m`` (``A@1.0,-2.0`` -> ``A_1_0_m2_0``), a
    hyphen within a name is not one (``1,3-Butadiene`` -> ``1_3_Butadiene``)."""
    out = _UNSAFE.sub("_", _MINUS.sub("m", name)).strip("_")
    return out or "_"


def sanitize_names(names: Iterable[str]) -> list[str]:
    """Sanitise a list of names and fail if two collapse onto one."""
    names = list(names)
    out = [sanitize_name(n) for n in names]
    seen: dict[str, str] = {}
    for raw, clean in zip(names, out):
        if clean in seen and seen[clean] != raw:
            raise ValueError(f"names {seen[clean]!r} and {raw!r} both sanitise to {clean!r}")
        seen[clean] = raw
    return out
