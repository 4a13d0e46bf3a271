"""Daily series, smoothing, de-seasonalising and shifting.

Window operators partition by a series key (site, criterion) and order by
day.  After the daily aggregate a key holds at most one row per calendar
day, so every window partition is bounded by the calendar span, never by
the raw data volume.  An empty ``by`` means the national series: the input
is then itself one row per day.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagscope.functions.exprs import date_bucket


def _window(by: Sequence[str], order: Sequence[str]):
    w = Window.partitionBy(*by) if by else Window.partitionBy()
    return w.orderBy(*order)


def daily_mean(wide: DataFrame, cols: Sequence[str], by: Sequence[str] = (), date_col: str = "date") -> DataFrame:
    """Mean per day (and ``by`` keys) of each column, with integer ``year`` /
    ``dayofyear``.  On a complete-case wide table this is the unweighted mean
    over the complete sites of that day."""
    q = lambda c: "`" + c.replace("`", "``") + "`"
    out = wide.groupBy(*by, date_col).agg(*[F.expr(f"avg({q(c)}) AS {q(c)}") for c in cols])
    return out.selectExpr(*[q(b) for b in by], q(date_col), f"year({q(date_col)}) AS year",
                          f"dayofyear({q(date_col)}) AS dayofyear", *[q(c) for c in cols])


def bucket_mean(df: DataFrame, by: Sequence[str], cols: Sequence[str], ts_col: str = "ts",
                unit: str = "hour", out: str = "ts") -> DataFrame:
    """Mean per key and time bucket (``date_trunc(unit, ts)``): turns raw
    readings into a regular series with at most one row per key and bucket,
    the form every window operator here expects (partial aggregation before
    the shuffle, so a hot key is collapsed map-side)."""
    bucket = F.date_trunc(unit, F.col(ts_col)).alias(out)
    return df.groupBy(*by, bucket).agg(*[F.avg(c).alias(c) for c in cols])


def yearly_mean(df: DataFrame, value_col: str = "value", date_col: str = "date") -> DataFrame:
    return df.groupBy(F.year(date_col).alias("year")).agg(F.avg(value_col).alias(value_col))


def climatology(df: DataFrame, cols: Sequence[str], date_col: str = "date", by: Sequence[str] = ()) -> DataFrame:
    """Mean per day of year across years (at most 366 output rows per key)."""
    return df.groupBy(*by, F.dayofyear(date_col).alias("dayofyear")).agg(*[F.avg(c).alias(c) for c in cols])


def sma(df: DataFrame, by: Sequence[str], cols: Sequence[str], periods: int = 12,
        order: str = "date", trailing: bool = False) -> DataFrame:
    """Simple moving average per ``by`` group ordered by ``order``.

    Centred (default): mean over rows ``[-periods, +periods]``, partial at the
    edges, added as ``<col>_sma<periods>``.  ``trailing=True``: mean over the
    last ``periods`` rows, full windows only (null otherwise), added as
    ``<col>_ma<periods>``.
    """
    w = _window(by, [order])
    if trailing:
        frame = w.rowsBetween(-(periods - 1), 0)
        full = F.count(F.lit(1)).over(frame) == periods
        new = {f"{c}_ma{periods}": F.when(full, F.avg(c).over(frame)) for c in cols}
    else:
        frame = w.rowsBetween(-periods, periods)
        new = {f"{c}_sma{periods}": F.avg(c).over(frame) for c in cols}
    return df.withColumns(new)


def gradient(df: DataFrame, by: Sequence[str], cols: Sequence[str], order: Sequence[str] = ("date",),
             normalize: bool = True, suffix: str = "_grad") -> DataFrame:
    """Second-order central difference (one-sided at the ends), divided by the
    series' Euclidean norm when ``normalize``; a single-point series gives
    null."""
    w = _window(by, list(order))
    whole = Window.partitionBy(*by) if by else Window.partitionBy()
    new = {}
    for c in cols:
        prev, nxt = F.lag(c, 1).over(w), F.lead(c, 1).over(w)
        g = (F.when(prev.isNotNull() & nxt.isNotNull(), (nxt - prev) / 2.0)
             .when(prev.isNull() & nxt.isNotNull(), nxt - F.col(c))
             .when(prev.isNotNull() & nxt.isNull(), F.col(c) - prev))
        if normalize:
            g = F.try_divide(g, F.sqrt(F.sum(F.col(c) * F.col(c)).over(whole)))
        new[f"{c}{suffix}"] = g
    return df.withColumns(new)


def shift(df: DataFrame, by: Sequence[str], col: str, n: int, order: Sequence[str] = ("date",),
          pad: float | None = None, out: str | None = None) -> DataFrame:
    """Shift a series by ``n`` positions.

    Positive ``n`` moves values forward (row i gets the value of row i-n),
    negative backward.  With ``pad=None`` the rows left without a value are
    dropped (the signal is truncated); otherwise they get ``pad``.
    """
    out = out or f"{col}_shift{n}"
    w = _window(by, list(order))
    if n == 0:
        return df.withColumn(out, F.col(col))
    moved = F.lag(col, n).over(w) if n > 0 else F.lead(col, -n).over(w)
    # truncation is decided by position, so a null source value stays a row
    pos = F.row_number().over(w)
    cnt = F.count(F.lit(1)).over(Window.partitionBy(*by) if by else Window.partitionBy())
    inside = (pos > n) if n > 0 else (pos <= cnt + n)
    if pad is None:
        return df.withColumns({out: moved, "_keep": inside}).where("_keep").drop("_keep")
    return df.withColumn(out, F.when(inside, moved).otherwise(F.lit(float(pad))))


def deseason(df: DataFrame, col: str | Sequence[str], date_col: str = "date", freq: str = "daily") -> DataFrame:
    """Subtract the mean of each of the columns over a seasonal bucket: hour of day
    (``hourly``), day of month (``daily``), day of year (``dayofyear``),
    month (``monthly``) or year (``yearly``).  Rows whose bucket is null are
    dropped (inner-join semantics).

    The bucket means are one partial aggregate (at most 366 rows, or one row
    per year), joined back: no window over a bucket, so no task ever holds a
    whole month of raw rows.
    """
    bucket = date_bucket(F.col(date_col), freq)
    # the null filter is applied once, before the two branches, so both carry
    # the same filters and the input's exchange is reused (one scan)
    keyed = df.withColumn("_bucket", bucket).where(F.col("_bucket").isNotNull())
    cols = [col] if isinstance(col, str) else list(col)
    means = keyed.groupBy("_bucket").agg(*[F.avg(c).alias(f"_mean{i}") for i, c in enumerate(cols)])
    return (keyed.join(means, "_bucket")
            .withColumns({c: F.col(c) - F.col(f"_mean{i}") for i, c in enumerate(cols)})
            .drop("_bucket", *[f"_mean{i}" for i in range(len(cols))]))


def ema(df: DataFrame, by: Sequence[str], cols: Sequence[str], span: float = 3.0,
        order: Sequence[str] = ("date",), suffix: str = "_ema") -> DataFrame:
    """Exponentially weighted mean, bias-adjusted (alpha = 2 / (span + 1)):
    ``y_t = sum_j w^(t-j) x_j / sum_j w^(t-j)``, w = 1 - alpha, over all
    earlier rows; a missing value keeps its position, and rows before the
    first value are null.

    Numerator and denominator are linear recurrences, so they compose: each
    series is cut into chunks of positions, a window within the chunk sums the
    terms with weights relative to its start (few enough positions that they
    stay in range), and the totals of earlier chunks, one row per chunk, are
    folded with ``aggregate`` into what the chunk starts from.
    """
    if span < 1:
        raise ValueError("span must be >= 1")
    by, cols = list(by), list(cols)
    w = 1.0 - 2.0 / (span + 1.0)
    # relative weights reach w^-(chunk - 1), kept below 10^100
    chunk = 512 if w <= 0 else max(2, min(512, int(100 / -math.log10(w))))
    pos = F.row_number().over(_window(by, list(order))) - 1
    rows = df.withColumn("_pos", pos).withColumns({"_chunk": F.floor(F.col("_pos") / chunk), "_k": F.col("_pos") % chunk})
    decay = F.pow(F.lit(w), F.col("_k"))
    upto = Window.partitionBy(*by, "_chunk").orderBy("_k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    new, parts = {}, []
    for i, c in enumerate(cols):
        x = F.col("`" + c.replace("`", "``") + "`").cast("double")
        if w <= 0:  # span 1: the last value itself
            last = F.last(x, ignorenulls=True).over(upto)
            new |= {f"_n{i}": last, f"_d{i}": F.when(last.isNotNull(), F.lit(1.0)).otherwise(F.lit(0.0))}
        else:
            new |= {f"_n{i}": decay * F.sum(F.coalesce(x, F.lit(0.0)) / decay).over(upto),
                    f"_d{i}": decay * F.sum(F.when(x.isNotNull(), 1 / decay).otherwise(F.lit(0.0))).over(upto)}
        parts += [F.max_by(f"_n{i}", "_k").alias(f"_n{i}"), F.max_by(f"_d{i}", "_k").alias(f"_d{i}")]
    rows = rows.withColumns(new)
    totals = rows.groupBy(*by, "_chunk").agg(F.count(F.lit(1)).alias("_len"), *parts)
    before = (Window.partitionBy(*by).orderBy("_chunk") if by else Window.orderBy("_chunk")).rowsBetween(
        Window.unboundedPreceding, -1)
    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("d"))
    carried = []
    for i in range(len(cols)):
        earlier = F.collect_list(F.struct(F.col("_len").alias("l"), F.coalesce(f"_n{i}", F.lit(0.0)).alias("n"),
                                          F.col(f"_d{i}").alias("d"))).over(before)
        if w <= 0:
            fold = lambda a, t: F.when(t["d"] > 0, F.struct(t["n"].alias("n"), t["d"].alias("d"))).otherwise(a)
        else:
            fold = lambda a, t: F.struct((a["n"] * F.pow(F.lit(w), t["l"]) + t["n"]).alias("n"),
                                         (a["d"] * F.pow(F.lit(w), t["l"]) + t["d"]).alias("d"))
        carried.append(F.aggregate(earlier, zero, fold).alias(f"_c{i}"))
    totals = totals.select(*[F.col(b).alias(f"_b{k}") for k, b in enumerate(by)], F.col("_chunk").alias("_bc"), *carried)
    same = [F.col(b).eqNullSafe(F.col(f"_b{k}")) for k, b in enumerate(by)]
    rows = rows.join(totals, [*same, F.col("_chunk") == F.col("_bc")])
    out = []
    for i, c in enumerate(cols):
        if w <= 0:
            n = F.when(F.col(f"_d{i}") > 0, F.col(f"_n{i}")).otherwise(F.col(f"_c{i}.n"))
            d = F.greatest(f"_d{i}", F.col(f"_c{i}.d"))
        else:
            grown = F.pow(F.lit(w), F.col("_k") + 1)
            n, d = F.col(f"_c{i}.n") * grown + F.col(f"_n{i}"), F.col(f"_c{i}.d") * grown + F.col(f"_d{i}")
        out.append(F.when(d > 0, F.try_divide(n, d)).alias(f"{c}{suffix}"))
    return rows.select(*["`" + c.replace("`", "``") + "`" for c in df.columns], *out)
