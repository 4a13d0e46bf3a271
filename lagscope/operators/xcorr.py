"""Time-lagged cross-correlation and correlation matrices.

``lagged_correlation`` is the all-play-all analytic: for every series of X,
every series of Y and every lag it returns the Pearson r of the pairs
``(x[i], y[i + lag])``; a positive lag compares the past of x with the
present of y.  It folds blocks instead of making a row per pair and day:

1. a row per day carries all its x and all its y values as arrays.
   ``unit="rows"``: X and Y are joined on the day and the complete days are
   numbered; ``unit="days"``: each side keeps its own calendar days, no join;
2. days are cut into chunks, series into blocks.  A chunk gets its own days of
   x and, as a halo, the days of y that any lag reaches from there; a block of
   x meets a block of y.  (chunk, x block, y block) is the unit of work that is
   hashed over the cluster;
3. a task folds each unit into moments per lag (n, means, centred sums of
   squares and products, the products of all pairs of a block as one matrix
   product) and merges those of the same block pair, so that what is shuffled
   again is one row per block pair and task;
4. the moments of a block pair are merged once more and give a row per (by,
   series_x, series_y, lag), also where series never overlap (n = 0, r null).

Nothing is collected, and no task holds more than a chunk of two blocks and the
moments of its block pairs; per-site correlation is the same plan with
``by=[site]``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagscope.functions.exprs import safe_pearson
from lagscope.session import show_package

#: Days of a chunk at least (never less than the lags span), series of a block.
CHUNK, BLOCK = 512, 64


def lagged_correlation(x: DataFrame, y: DataFrame, lags: Sequence[int], x_cols: Sequence[str],
                       y_cols: Sequence[str], by: Sequence[str] = (), unit: str = "rows",
                       date_col: str = "date", block: int = BLOCK) -> DataFrame:
    """All-play-all time-lagged Pearson correlation.

    ``x``/``y``: wide frames, one row per (``by``..., day), one column per
    series (``x_cols`` / ``y_cols``); a row with a null in its series is not
    a usable day (complete-case).  Output
    ``(by..., series_x, series_y, lag, n, r)``: one row for every ``by`` group
    of ``x``, pair of series and lag, with ``n`` the number of pairs; r is null
    for a constant side or fewer than two pairs (n = 0 where no positions
    overlap).  Passing one frame as both sides (``y is x``) reads it once.

    ``unit="rows"`` counts lags in joined days (positions in the days both
    sides have); ``unit="days"`` counts calendar days (x on day d meets y on
    day d + lag).  Scaling either side does not change r, so inputs need no
    prior normalisation.
    """
    by, x_cols, y_cols = list(by), list(x_cols), list(y_cols)
    lag_list = sorted({int(v) for v in lags})
    if not lag_list:
        raise ValueError("at least one lag is required")
    if unit not in ("rows", "days"):
        raise ValueError("unit must be 'rows' or 'days'")
    show_package(x.sparkSession)
    days = _joined_days(x, y, x_cols, y_cols, by, date_col) if unit == "rows" else _calendar_days(
        x, y, x_cols, y_cols, by, date_col)
    units = _units(days, by, lag_list, len(x_cols), len(y_cols), block)
    merged = (_block_moments(units, by, lag_list).repartition(*by, "xb", "yb").sortWithinPartitions(*by, "xb", "yb"))
    return merged.mapInArrow(_finisher(len(by), x_cols, y_cols, lag_list, block),
                             f"{_key_types(x, by)}series_x string, series_y string, lag int, n bigint, r double")


def _block_moments(units: DataFrame, by: list[str], lags: list[int]) -> DataFrame:
    """The moments of every block pair, a row per task that has chunks of it."""
    return (units.repartition(*by, "xb", "yb", "chunk").sortWithinPartitions(*by, "xb", "yb", "chunk", "idx")
            .mapInArrow(_folder(len(by), lags), f"{_key_types(units, by)}xb int, yb int, of_x boolean, n array<bigint>, "
                        + ", ".join(f"{m} array<double>" for m in _MOMENTS)))


def _key_types(df: DataFrame, by: list[str]) -> str:
    return "".join(f"{_q(b)} {df.schema[b].dataType.simpleString()}, " for b in by)


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _array(cols: Sequence[str], when: str) -> str:
    """The columns as an array, null where ``when`` is false."""
    cells = ", ".join(f"CAST({c} AS DOUBLE)" for c in cols)
    return f"CASE WHEN {when} THEN array({cells}) END"


def _complete(cols: Sequence[str]) -> str:
    return " AND ".join(f"{c} IS NOT NULL" for c in cols)


def _joined_days(x: DataFrame, y: DataFrame, x_cols: list[str], y_cols: list[str], by: list[str], date_col: str) -> DataFrame:
    """(by..., idx, xs, ys): the days that both sides have complete, numbered
    per group; of the other days of a group one stays, without values, so that
    the group is known."""
    keys = [*by, date_col]
    xq = [_q(c) for c in x_cols]
    if y is x:
        yq, j = [_q(c) for c in y_cols], x
    else:
        yq = [f"_y{i}" for i in range(len(y_cols))]
        side = y.where(_complete([_q(c) for c in y_cols])).selectExpr(
            *[f"{_q(k)} AS _k{i}" for i, k in enumerate(keys)], *[f"{_q(c)} AS {n}" for c, n in zip(y_cols, yq)])
        same = [F.col(_q(k)) == F.col(f"_k{i}") for i, k in enumerate(keys)]
        j = x.selectExpr(*[_q(c) for c in dict.fromkeys([*keys, *x_cols])]).join(side, same, "left")
    both = _complete([_q(date_col), *xq, *yq])
    j = j.selectExpr(*[_q(b) for b in by], f"{_q(date_col)} AS _date", f"({both}) AS _ok", f"{_array(xq, both)} AS xs",
                     f"{_array(yq, both)} AS ys")
    w = Window.partitionBy(*by, "_ok").orderBy("_date")
    j = j.withColumn("idx", (F.row_number().over(w) - 1).cast("long"))
    return j.where(F.col("_ok") | (F.col("idx") == 0)).select(*by, "idx", "xs", "ys")


def _calendar_days(x: DataFrame, y: DataFrame, x_cols: list[str], y_cols: list[str], by: list[str], date_col: str) -> DataFrame:
    """The same, ``idx`` being the calendar day; each side for itself."""
    day = f"CAST(datediff({_q(date_col)}, DATE '1970-01-01') AS BIGINT) AS idx"

    def side(df: DataFrame, cols: list[str], mine: str, other: str) -> DataFrame:
        ok = _complete([_q(date_col), *[_q(c) for c in cols]])
        return df.selectExpr(*[_q(b) for b in by], day, f"{_array([_q(c) for c in cols], ok)} AS {mine}",
                             f"CAST(NULL AS ARRAY<DOUBLE>) AS {other}")

    # a group is one of x: y days are marked by having values, x rows may lack them
    return side(x, x_cols, "xs", "ys").unionByName(side(y, y_cols, "ys", "xs").where("ys IS NOT NULL"))


def _units(days: DataFrame, by: list[str], lags: list[int], nx: int, ny: int, block: int) -> DataFrame:
    """Rows (by..., xb, yb, chunk, idx, xs, ys): every day in the units of work
    that need it."""
    span = max(CHUNK, lags[-1] - lags[0])
    own = F.floor(F.coalesce("idx", F.lit(0)) / span)
    low, high = F.floor((F.col("idx") - lags[-1]) / span), F.floor((F.col("idx") - lags[0]) / span)
    reach = F.when(F.col("ys").isNull(), F.array(own)).otherwise(F.sequence(F.least(own, low), F.greatest(own, high)))
    if not by:
        # without a day there is no group either: the national one always is
        nothing = days.sparkSession.range(1).selectExpr("0L AS idx", "CAST(NULL AS ARRAY<DOUBLE>) AS xs",
                                                        "CAST(NULL AS ARRAY<DOUBLE>) AS ys")
        days = days.unionByName(nothing)
    rows = days.select("*", F.explode(reach).alias("chunk"))
    # x values belong to one chunk; elsewhere the row only lends its y
    group = F.col("ys").isNull() | (F.col("chunk") == own)
    rows = rows.select(*by, "chunk", "idx", F.when(F.col("chunk") == own, F.col("xs")).alias("xs"), "ys",
                       (group & (F.col("ys").isNull() | F.col("xs").isNotNull())).alias("of_x"))
    xbs, ybs = -(-nx // block), -(-ny // block)
    pairs = F.array(*[F.struct(F.lit(i).alias("xb"), F.lit(j).alias("yb")) for i in range(xbs) for j in range(ybs)])
    rows = rows.select("*", F.explode(pairs).alias("p"))
    return rows.select(*by, F.col("p.xb").alias("xb"), F.col("p.yb").alias("yb"), "chunk", "idx", "of_x",
                       F.slice("xs", F.col("p.xb") * block + 1, F.lit(block)).alias("xs"),
                       F.slice("ys", F.col("p.yb") * block + 1, F.lit(block)).alias("ys"))


# -- moments -----------------------------------------------------------------

_MOMENTS = ("mx", "my", "xx", "yy", "xy")


class Moments:
    """Per lag: the number of pairs, the means of x and y over them and their
    centred sums of squares and products."""

    def __init__(self, n, mx, my, xx, yy, xy):
        self.n, self.mx, self.my, self.xx, self.yy, self.xy = n, mx, my, xx, yy, xy

    @staticmethod
    def of(at_x: np.ndarray, xs: np.ndarray, at_y: np.ndarray, ys: np.ndarray, lags: list[int]) -> "Moments":
        """Of x values at days ``at_x`` (ascending) and y values at ``at_y``."""
        kx, ky = xs.shape[1], ys.shape[1]
        out = Moments(np.zeros(len(lags), dtype=np.int64), np.zeros((len(lags), kx)), np.zeros((len(lags), ky)),
                      np.zeros((len(lags), kx)), np.zeros((len(lags), ky)), np.zeros((len(lags), kx, ky)))
        for i, lag in enumerate(lags):
            _, a, b = np.intersect1d(at_x + lag, at_y, assume_unique=True, return_indices=True)
            if not len(a):
                continue
            p, q = xs[a], ys[b]
            # from the first value on, so that a constant has no spread at all
            mx, my = p[0] + (p - p[0]).mean(axis=0), q[0] + (q - q[0]).mean(axis=0)
            p, q = p - mx, q - my
            out.n[i], out.mx[i], out.my[i] = len(a), mx, my
            out.xx[i], out.yy[i], out.xy[i] = (p * p).sum(axis=0), (q * q).sum(axis=0), p.T @ q
        return out

    def add(self, other: "Moments") -> None:
        n = self.n + other.n
        share = np.divide(other.n, n, out=np.zeros(len(n)), where=n > 0)
        both = (self.n * share)[:, None]
        dx, dy = other.mx - self.mx, other.my - self.my
        self.xx += other.xx + dx * dx * both
        self.yy += other.yy + dy * dy * both
        self.xy += other.xy + dx[:, :, None] * dy[:, None, :] * both[:, :, None]
        # an empty side has no mean yet
        first = (self.n == 0)[:, None]
        self.mx = np.where(first, other.mx, self.mx + dx * share[:, None])
        self.my = np.where(first, other.my, self.my + dy * share[:, None])
        self.n = n

    def r(self, lag: int) -> np.ndarray:
        """Pearson r of every pair; NaN for a constant side or under two pairs."""
        spread = np.sqrt(self.xx[lag])[:, None] * np.sqrt(self.yy[lag])[None, :]
        r = np.full(spread.shape, np.nan)
        if self.n[lag] > 1:
            np.divide(self.xy[lag], spread, out=r, where=spread > 0)
        return np.clip(r, -1.0, 1.0)


def _runs(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) for runs of rows that agree in their first ``keys`` columns."""
    key, held = None, []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if row[:keys] != key:
                if held:
                    yield key, held
                key, held = row[:keys], []
            held.append(row)
    if held:
        yield key, held


def _folder(keys: int, lags: list[int]):
    """Units of work, sorted, to the moments of each block pair of a task."""
    def matrix(rows: list) -> np.ndarray:
        return np.array(rows, dtype=float).reshape(len(rows), -1)

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        first = next(batches, None)
        if first is None:
            return
        kinds = [first.schema.field(i).type for i in range(keys)]

        def send(key: tuple, of_x: bool, got: Moments | None) -> pa.RecordBatch:
            cells = [[None]] * 6 if got is None else [[got.n.tolist()], *[
                [np.asarray(getattr(got, m)).ravel().tolist()] for m in _MOMENTS]]
            types = [*kinds, pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.int64()), *[pa.list_(pa.float64())] * 5]
            values = [*[[k] for k in key], [of_x], *cells]
            names = [f"c{i}" for i in range(len(types))]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], names)

        def all_batches():
            yield first
            yield from batches

        pair, of_x, got = None, False, None
        for key, rows in _runs(all_batches(), keys + 3):
            if key[:-1] != pair:
                if pair is not None:
                    yield send(pair, of_x, got)
                pair, of_x, got = key[:-1], False, None
            of_x = of_x or any(r[keys + 4] for r in rows)
            x_rows = [(r[keys + 3], r[keys + 5]) for r in rows if r[keys + 5] is not None]
            y_rows = [(r[keys + 3], r[keys + 6]) for r in rows if r[keys + 6] is not None]
            if x_rows and y_rows:
                new = Moments.of(np.array([i for i, _ in x_rows]), matrix([v for _, v in x_rows]),
                                 np.array([i for i, _ in y_rows]), matrix([v for _, v in y_rows]), lags)
                if got is None:
                    got = new
                else:
                    got.add(new)
        yield send(pair, of_x, got)

    return fold


def _finisher(keys: int, x_cols: list[str], y_cols: list[str], lags: list[int], block: int):
    """Moments of a block pair, sorted, to its cells."""
    def finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        first = next(batches, None)
        if first is None:
            return
        kinds = [first.schema.field(i).type for i in range(keys)]

        def all_batches():
            yield first
            yield from batches

        for key, rows in _runs(all_batches(), keys + 2):
            if not any(r[keys + 2] for r in rows):
                continue  # no group of x
            xs = x_cols[key[keys] * block:(key[keys] + 1) * block]
            ys = y_cols[key[keys + 1] * block:(key[keys + 1] + 1) * block]
            got = Moments.of(np.empty(0, dtype=np.int64), np.empty((0, len(xs))), np.empty(0, dtype=np.int64),
                             np.empty((0, len(ys))), lags)
            for r in rows:
                if r[keys + 3] is not None:
                    shapes = [(len(lags), -1)] * 4 + [(len(lags), len(xs), len(ys))]
                    got.add(Moments(np.array(r[keys + 3], dtype=np.int64),
                                    *[np.array(v).reshape(s) for v, s in zip(r[keys + 4:], shapes)]))
            many = len(xs) * len(ys)
            for i, lag in enumerate(lags):
                r = got.r(i).ravel()
                values = [pa.array([k] * many, t) for k, t in zip(key, kinds)]
                values += [pa.array(np.repeat(xs, len(ys)).tolist(), pa.string()), pa.array(list(ys) * len(xs), pa.string()),
                           pa.array([lag] * many, pa.int32()), pa.array([int(got.n[i])] * many, pa.int64()),
                           pa.array(r, pa.float64(), mask=np.isnan(r))]
                yield pa.RecordBatch.from_arrays(values, [f"c{i}" for i in range(len(values))])

    return finish


def auto_correlation(x: DataFrame, lags: Sequence[int], cols: Sequence[str], by: Sequence[str] = (),
                     **kw) -> DataFrame:
    """Every series against every series of the same set (X = Y)."""
    return lagged_correlation(x, x, lags, cols, cols, by=by, **kw)


def correlation_matrix(wide: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pairwise Pearson correlation of the columns of a wide table (pairwise
    complete rows), as ``(series_a, series_b, r)`` including the diagonal.

    Each row's non-null (series, value) cells are expanded into the
    (a <= b) cell pairs, and one ``groupBy(a, b)`` aggregates them with
    partial aggregation: n * K^2 / 2 products, like a Gramian.  The plan names
    each of the K columns once or twice, never their pairs."""
    cols = list(cols)
    cells = F.filter(F.array(*[F.struct(F.lit(c).alias("s"), F.col(c).cast("double").alias("v")) for c in cols]),
                     lambda c: c["v"].isNotNull())
    a = wide.select(cells.alias("cells")).select("cells", F.explode("cells").alias("a"))
    pairs = (a.select("a", F.explode("cells").alias("b")).where(F.col("a.s") <= F.col("b.s"))
             .select(F.col("a.s").alias("series_a"), F.col("b.s").alias("series_b"),
                     F.col("a.v").alias("va"), F.col("b.v").alias("vb")))
    names = wide.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in cols])).alias("series"))
    return _matrix(pairs, names)


def correlation_matrix_long(long: DataFrame, key: str, series: str = "series", value: str = "value") -> DataFrame:
    """The same matrix from a long table ``(key, series, value)`` with one row
    per key and series: a self-join on the key.  Series stay data, so their
    names need no driver round trip and their number no plan."""
    v = long.select(F.col(key).alias("k"), F.col(series).alias("s"), F.col(value).cast("double").alias("v"))
    v = v.where(F.col("k").isNotNull() & F.col("v").isNotNull())
    a = v.select("k", F.col("s").alias("series_a"), F.col("v").alias("va"))
    b = v.select("k", F.col("s").alias("series_b"), F.col("v").alias("vb"))
    pairs = a.join(b, "k").where(F.col("series_a") <= F.col("series_b"))
    return _matrix(pairs, long.select(F.col(series).alias("series")).distinct())


def _matrix(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """r of every pair of ``names``; null where two series never overlap (as a
    pairwise-complete correlation gives NaN).  The grid pairs each name with
    the array of all names, one row per series."""
    upper = pairs.groupBy("series_a", "series_b").agg(safe_pearson("va", "vb").alias("r"))
    every = names.agg(F.collect_set("series")).scalar()
    grid = (names.select(F.col("series").alias("a"), F.explode(every).alias("b"))
            .where(F.col("a") <= F.col("b")))
    upper = grid.join(upper, (F.col("a") == F.col("series_a")) & (F.col("b") == F.col("series_b")), "left")
    sides = F.when(F.col("a") == F.col("b"), F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")))).otherwise(
        F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y"))))
    return (upper.select("r", F.explode(sides).alias("p"))
            .select(F.col("p.x").alias("series_a"), F.col("p.y").alias("series_b"), "r"))


def correlation_mass(corr: DataFrame) -> DataFrame:
    """Sum of |r| over the off-diagonal entries of each series' row."""
    return (corr.where(F.col("series_a") != F.col("series_b"))
            .groupBy("series_a").agg(F.sum(F.abs("r")).alias("mass")))


def adjacency(corr: DataFrame, threshold: float = 0.8) -> DataFrame:
    """1 where r > threshold (off the diagonal), else 0."""
    return corr.select("series_a", "series_b", F.when(
        (F.col("series_a") != F.col("series_b")) & (F.col("r") > threshold), 1).otherwise(0).alias("adj"))
