"""Column scaling: z-score, max-abs, min-max, and their chaining.

All statistics an operator needs are one struct-valued *scalar subquery* of
the input (``df.scalar()``): one aggregate pass (partial aggregation on every
partition, one row at the end) whose fields are inlined into the projection,
so there is no join, no broadcast of a growing table and no driver round
trip.  Scaling is then a plain codegen projection.

Semantics follow the MLlib scalers: sample standard deviation; a zero
deviation scales to 0; max-abs of an all-zero column gives 0; min-max of a
constant column gives 0.5.  Unlike the vector scalers, nulls propagate
instead of failing the job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Stats:
    """Collects the aggregates an operator needs, then evaluates them as a
    single struct-valued scalar subquery of ``df`` (register every aggregate
    before resolving the first with ``.col()``)."""

    def __init__(self, df: DataFrame):
        self.df, self.aggs, self._row = df, {}, None

    def __call__(self, agg: Column) -> Column:
        key = f"s{len(self.aggs)}"
        self.aggs[key] = agg
        return _Deferred(self, key)

    def row(self) -> Column:
        if self._row is None:
            self._row = self.df.select(F.struct(*[a.alias(k) for k, a in self.aggs.items()])).scalar()
        return self._row


class _Deferred:
    """A statistic resolved to ``row[key]`` once all aggregates are known."""

    def __init__(self, stats: Stats, key: str):
        self.stats, self.key = stats, key

    def col(self) -> Column:
        return self.stats.row()[self.key]


def zscore_exprs(df: DataFrame, cols: Sequence[str], mean: bool = True, std: bool = True,
                 stats_from: DataFrame | None = None) -> dict[str, Column]:
    st = Stats(stats_from if stats_from is not None else df)
    plan = {c: (st(F.avg(c)) if mean else None, st(F.stddev_samp(c)) if std else None) for c in cols}
    out = {}
    for c, (mu, sd) in plan.items():
        e = F.col(c)
        if mu is not None:
            e = e - mu.col()
        if sd is not None:
            # no deviation (a constant column or a single row) scales to 0
            flat = F.col(c).isNotNull() & (F.coalesce(sd.col(), F.lit(0.0)) == 0)
            e = F.when(flat, F.lit(0.0)).otherwise(F.try_divide(e, sd.col()))
        out[c] = e
    return out


def zscore(df: DataFrame, cols: Sequence[str], mean: bool = True, std: bool = True,
           suffix: str = "", stats_from: DataFrame | None = None) -> DataFrame:
    """Standardise columns: subtract the mean (``mean``) and divide by the
    sample standard deviation (``std``).  ``stats_from`` fits the statistics
    on another frame (e.g. all years, then scale a filtered one)."""
    exprs = zscore_exprs(df, cols, mean, std, stats_from)
    return df.withColumns({f"{c}{suffix}": e for c, e in exprs.items()})


def max_abs_exprs(df: DataFrame, cols: Sequence[str]) -> dict[str, Column]:
    st = Stats(df)
    plan = {c: st(F.max(F.abs(c))) for c in cols}
    out = {}
    for c, m in plan.items():
        out[c] = F.when(m.col() == 0, F.col(c) * 0.0).otherwise(F.try_divide(F.col(c), m.col()))
    return out


def max_abs(df: DataFrame, cols: Sequence[str], suffix: str = "") -> DataFrame:
    """Scale each column into [-1, 1] by its largest absolute value."""
    return df.withColumns({f"{c}{suffix}": e for c, e in max_abs_exprs(df, cols).items()})


def min_max_exprs(df: DataFrame, cols: Sequence[str]) -> dict[str, Column]:
    st = Stats(df)
    plan = {c: (st(F.min(c)), st(F.max(c))) for c in cols}
    out = {}
    for c, (lo_s, hi_s) in plan.items():
        lo, hi = lo_s.col(), hi_s.col()
        rng = hi - lo
        out[c] = F.when(F.col(c).isNull(), F.lit(None).cast("double")).when(
            rng == 0, F.lit(0.5)).otherwise(F.try_divide(F.col(c) - lo, rng))
    return out


def min_max(df: DataFrame, cols: Sequence[str], suffix: str = "") -> DataFrame:
    """Scale each column into [0, 1]; a constant column becomes 0.5."""
    return df.withColumns({f"{c}{suffix}": e for c, e in min_max_exprs(df, cols).items()})


def zscore_max_abs_exprs(df: DataFrame, cols: Sequence[str], mean: bool = True, std: bool = True
                         ) -> dict[str, Column]:
    """z-score followed by max-abs, fused: dividing z = (c - m) / s by its
    largest magnitude max|c - m| / s gives (c - m) / max|c - m| -- s cancels.
    max|c - m| = greatest(|max(c) - m|, |min(c) - m|), so every statistic is
    an aggregate of the *input* (one merged pass), never of a scaled column
    (which would nest subqueries and re-evaluate the input per level)."""
    st = Stats(df)
    plan = {c: (st(F.min(c)), st(F.max(c)), st(F.avg(c)) if mean else None, st(F.stddev_samp(c)) if std else None)
            for c in cols}
    out = {}
    for c, (lo_s, hi_s, mu_s, sd_s) in plan.items():
        lo, hi = lo_s.col(), hi_s.col()
        if mu_s is not None:
            mu = mu_s.col()
            num, m = F.col(c) - mu, F.greatest(F.abs(hi - mu), F.abs(lo - mu))
        else:
            num, m = F.col(c), F.greatest(F.abs(hi), F.abs(lo))
        e = F.when(m == 0, F.lit(0.0)).otherwise(F.try_divide(num, m))
        if sd_s is not None:
            e = F.when(sd_s.col() == 0, F.lit(0.0)).otherwise(e)
        out[c] = F.when(F.col(c).isNull(), F.lit(None).cast("double")).otherwise(e)
    return out


def zscore_max_abs(df: DataFrame, cols: Sequence[str], mean: bool = True, std: bool = True) -> DataFrame:
    """Chained scaling as the prepared datasets use it: z-score, then
    max-abs of the z-scores (flags honoured), computed in one pass."""
    return df.withColumns(zscore_max_abs_exprs(df, cols, mean, std))
