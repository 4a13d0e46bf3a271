"""Registered queries over the star-schema tables, each with an equivalent
DuckDB SQL text used as an independent oracle.

Every query reads whole tables (lineitem, supplier, nation, region, orders,
events) through the adapters of ``lagscope.sources.tables``; nothing is
sampled or capped.  Derived doubles are rounded in the *output* only (6 digits,
r to 8) so that two engines summing in different orders still agree; stored
values pass unrounded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagscope.operators import clean, reshape, scale, score, series, spatial, xcorr
from lagscope.functions.exprs import l2_norm
from lagscope.plans import scenarios
from lagscope.plans.jobs import AUTO_LAGS, PRICE_LAGS, TOXICS_LAGS
from lagscope.sources import tables

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}

# The return flags that play the role of measured criteria.
FLAGS = ["A", "N", "R"]


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return deco


# Digits kept for price-scale outputs (means of ~1e4..1e5).
PRICE_DIGITS = 6


def rounded(df: DataFrame, digits: int = 6, special: dict[str, int] | None = None) -> DataFrame:
    """Round every double column of a result (output only)."""
    special = special or {}

    def q(c):
        return "`" + c.replace("`", "``") + "`"

    return df.selectExpr(*[f"round({q(c)}, {special.get(c, digits)}) AS {q(c)}" if t == "double" else q(c)
                           for c, t in df.dtypes])


# --------------------------------------------------------------------------
# Shared Spark inputs
# --------------------------------------------------------------------------

def measurements(spark, sf):
    return tables.lineitem_measurements(spark, sf)


def wide(spark, sf, **kw):
    return reshape.pivot_wide(measurements(spark, sf), FLAGS, **kw)


def daily(spark, sf):
    return series.daily_mean(wide(spark, sf), FLAGS)


def prices(spark, sf):
    return tables.order_prices(spark, sf)


def events(spark, sf):
    return tables.event_measurements(spark, sf)


# --------------------------------------------------------------------------
# Shared SQL inputs (DuckDB dialect); each is one CTE body
# --------------------------------------------------------------------------

SQL_M = """m AS (
  SELECT l.l_returnflag AS criteria, lower(n.n_name) AS state, lower(r.r_name) AS county,
         round(21.3247::DOUBLE + 1.0005::DOUBLE * (s.s_nationkey % 5), 6::INTEGER) AS lat,
         round(-158.0893::DOUBLE + 3.0015::DOUBLE * (s.s_nationkey % 5), 6::INTEGER) AS lon,
         l.l_shipdate + to_hours(l.l_linenumber + 6) AS ts,
         CAST(l.l_shipdate AS DATE) AS date,
         round(l.l_extendedprice, 10) AS value,
         l.l_linestatus AS unit
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey)"""

SQL_W = """w AS (
  SELECT round(lat, 3) AS lat, round(lon, 3) AS lon, date,
         avg(value) FILTER (WHERE criteria = 'A') AS "A",
         avg(value) FILTER (WHERE criteria = 'N') AS "N",
         avg(value) FILTER (WHERE criteria = 'R') AS "R"
  FROM m GROUP BY 1, 2, 3),
wc AS (SELECT * FROM w WHERE "A" IS NOT NULL AND "N" IS NOT NULL AND "R" IS NOT NULL)"""

SQL_D = """d AS (
  SELECT date, CAST(year(date) AS INTEGER) AS year, CAST(dayofyear(date) AS INTEGER) AS dayofyear,
         avg("A") AS "A", avg("N") AS "N", avg("R") AS "R"
  FROM wc GROUP BY date)"""

SQL_P = """p AS (SELECT CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS price FROM orders GROUP BY 1)"""

SQL_E = """e AS (
  SELECT event_id, event_type AS criteria, CAST(user_id % 5 AS INTEGER) AS site,
         round(21.3247::DOUBLE + 1.0005::DOUBLE * (user_id % 5), 6::INTEGER) AS lat,
         round(-158.0893::DOUBLE + 3.0015::DOUBLE * (user_id % 5), 6::INTEGER) AS lon,
         ts, CAST(ts AS DATE) AS date, value
  FROM events)"""

# long daily national series (x) and the price series (y)
SQL_X = """x AS (
  SELECT date, 'A' AS series, "A" AS value FROM d UNION ALL
  SELECT date, 'N', "N" FROM d UNION ALL
  SELECT date, 'R', "R" FROM d)"""

SQL_Y = """y AS (SELECT date, 'price' AS series, price AS value FROM p)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def sql_pearson(x: str, y: str) -> str:
    return f"covar_samp({x}, {y}) / nullif(stddev_samp({x}) * stddev_samp({y}), 0)"


def _sql_z(c: str, src_over: str = "OVER ()") -> str:
    return (f'CASE WHEN stddev_samp("{c}") {src_over} = 0 THEN 0.0 '
            f'ELSE ("{c}" - avg("{c}") {src_over}) / stddev_samp("{c}") {src_over} END')


def sql_lags(lags) -> str:
    return "lags AS (SELECT * FROM (VALUES " + ", ".join(f"({v})" for v in lags) + ") t(lag))"


def sql_grid(lags, xs, ys, by: str = "") -> str:
    """CTEs ``lags`` and ``grid``: every (by, series_x, series_y, lag); ``by``
    is a select of the groups."""
    names = [", ".join(f"('{n}')" for n in v) for v in (xs, ys)]
    return sql_lags(lags) + f""",
grid AS (SELECT {'b.*, ' if by else ''}sx.s AS series_x, sy.s AS series_y, CAST(lags.lag AS INTEGER) AS lag
         FROM {f'({by}) b CROSS JOIN ' if by else ''}(VALUES {names[0]}) sx(s) CROSS JOIN (VALUES {names[1]}) sy(s)
         CROSS JOIN lags)"""


def sql_cells(found: str, by: str = "") -> str:
    """The grid with the cells of ``found`` (a select of by, series_x,
    series_y, lag, n, r)."""
    return f"""
SELECT {by}series_x, series_y, lag, coalesce(n, 0) AS n, round(r, 8) AS r
FROM grid LEFT JOIN ({found}) f USING ({by}series_x, series_y, lag)"""


def sql_tlcc(lags, xs, ys, xdays: str = "SELECT DISTINCT date FROM x", ydays: str = "SELECT DISTINCT date FROM y") -> str:
    """Positional lag join on the joined days, national series."""
    return f""",
{sql_grid(lags, xs, ys)},
days AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx
         FROM ({xdays}) a JOIN ({ydays}) b USING (date)),
xi AS (SELECT idx, series, value FROM x JOIN days USING (date)),
yi AS (SELECT idx, series, value FROM y JOIN days USING (date))""" + sql_cells(f"""
  SELECT xi.series AS series_x, yi.series AS series_y, CAST(lags.lag AS INTEGER) AS lag, count(*) AS n,
         {sql_pearson('xi.value', 'yi.value')} AS r
  FROM xi CROSS JOIN lags JOIN yi ON yi.idx = xi.idx + lags.lag
  GROUP BY 1, 2, 3""")


# --------------------------------------------------------------------------
# Lagged correlation (flagship)
# --------------------------------------------------------------------------

def tlcc_price_frame(spark: SparkSession, sf: str, lags=PRICE_LAGS, years=None) -> DataFrame:
    """Gas-x-price analogue: national daily means of the complete sites per
    criterion against the daily price, all lags in one plan.  r does not change
    with scale, so the scenario's z-scores are left out here; ``tlcc_scenario``
    has them."""
    d = daily(spark, sf)
    p = prices(spark, sf)
    if years is not None:
        d = clean.year_filter(d, years)
        p = clean.year_filter(p, years)
    clean.validate_columns(d, ["date", *FLAGS])
    return xcorr.lagged_correlation(d, p, lags, FLAGS, ["price"])


@register("tlcc_price", with_(SQL_M, SQL_W, SQL_D, SQL_P, SQL_X, SQL_Y) + sql_tlcc(PRICE_LAGS, FLAGS, ["price"]))
def tlcc_price(spark, sf):
    return rounded(tlcc_price_frame(spark, sf), special={"r": 8})


@register("tlcc_price_years", with_(
    SQL_M, SQL_W, SQL_D, SQL_P,
    SQL_X.replace("FROM d", "FROM d WHERE year BETWEEN 1996 AND 1999"),
    SQL_Y.replace("FROM p)", "FROM p WHERE year(date) BETWEEN 1996 AND 1999)"),
) + sql_tlcc(PRICE_LAGS, FLAGS, ["price"]))
def tlcc_price_years(spark, sf):
    """Multi-year window variant (2014-2019 job analogue: 1996-1999)."""
    return rounded(tlcc_price_frame(spark, sf, years=range(1996, 2000)), special={"r": 8})


# Nine criteria with dots, commas and hyphens in their names, and the column
# names they are sanitised to.
AGENTS = [f"{k}.5-Agent, {f}" for k in range(3) for f in FLAGS]
AGENT_COLS = [f"{k}_5_Agent_{f}" for k in range(3) for f in FLAGS]
SQL_AGENTS = """m AS (
  SELECT (l.l_linenumber % 3) || '.5-Agent, ' || l.l_returnflag AS criteria, CAST(l.l_shipdate AS DATE) AS date,
         round(l.l_extendedprice, 10) AS value
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey)"""
SQL_AGENT_DAYS = "d0 AS (SELECT date, " + ", ".join(
    f"avg(value) FILTER (WHERE criteria = '{c}') AS \"{n}\"" for c, n in zip(AGENTS, AGENT_COLS)) + """
  FROM m GROUP BY date),
d AS (SELECT * FROM d0 WHERE """ + " AND ".join(f'"{n}" IS NOT NULL' for n in AGENT_COLS) + ")"
SQL_AGENT_X = "x AS (" + " UNION ALL ".join(
    f"""SELECT date, '{n}' AS series, "{n}" AS value FROM d""" for n in AGENT_COLS) + ")"


@register("tlcc_toxics", with_(SQL_AGENTS, SQL_AGENT_DAYS, SQL_P, SQL_AGENT_X, SQL_Y)
          + sql_tlcc(TOXICS_LAGS, AGENT_COLS, ["price"]))
def tlcc_toxics(spark, sf):
    """Toxics-shaped run: many criteria with awkward names, complete days only,
    against the price."""
    d = series.daily_mean(reshape.pivot_wide(tables.lineitem_agents(spark, sf), AGENTS), AGENT_COLS)
    return rounded(xcorr.lagged_correlation(d, prices(spark, sf), TOXICS_LAGS, AGENT_COLS, ["price"]), special={"r": 8})


@register("tlcc_scenario", with_(
    SQL_M, SQL_W, SQL_D, SQL_P,
    "dz AS (SELECT date, " + ", ".join(f'{_sql_z(c)} AS "{c}"' for c in FLAGS) + " FROM d)",
    SQL_X.replace("FROM d", "FROM dz"),
    f"y AS (SELECT date, 'price' AS series, {_sql_z('price')} AS value FROM p)",
) + sql_tlcc(PRICE_LAGS, FLAGS, ["price"]))
def tlcc_scenario(spark, sf):
    """The job as written: the z-scored national scenario against the z-scored
    price."""
    d, labels = scenarios.daily_table(measurements(spark, sf), FLAGS, "national")
    d, p = scale.zscore(d, labels), scale.zscore(prices(spark, sf), ["price"])
    return rounded(xcorr.lagged_correlation(d, p, PRICE_LAGS, labels, ["price"]), special={"r": 8})


@register("tlcc_auto", with_(SQL_M, SQL_W, SQL_D, SQL_X, "y AS (SELECT * FROM x)") + sql_tlcc(AUTO_LAGS, FLAGS, FLAGS))
def tlcc_auto(spark, sf):
    return rounded(xcorr.auto_correlation(daily(spark, sf), AUTO_LAGS, FLAGS), special={"r": 8})


@register("tlcc_calendar", with_(SQL_M, SQL_W, SQL_D, SQL_P, SQL_X, SQL_Y, sql_grid(PRICE_LAGS, FLAGS, ["price"]))
          + sql_cells(f"""
  SELECT x.series AS series_x, y.series AS series_y, CAST(lags.lag AS INTEGER) AS lag, count(*) AS n,
         {sql_pearson('x.value', 'y.value')} AS r
  FROM x CROSS JOIN lags JOIN y ON y.date = x.date + CAST(lags.lag AS INTEGER)
  GROUP BY 1, 2, 3"""))
def tlcc_calendar(spark, sf):
    return rounded(xcorr.lagged_correlation(daily(spark, sf), prices(spark, sf), PRICE_LAGS, FLAGS, ["price"],
                                            unit="days"), special={"r": 8})


@register("tlcc_by_site", with_(SQL_M, SQL_W, SQL_P, """xs AS (
  SELECT lat, lon, date, 'A' AS series, "A" AS value FROM wc UNION ALL
  SELECT lat, lon, date, 'N', "N" FROM wc UNION ALL
  SELECT lat, lon, date, 'R', "R" FROM wc)""", """ys AS (
  SELECT s.lat, s.lon, p.date, 'price' AS series, p.price AS value
  FROM (SELECT DISTINCT lat, lon, date FROM wc) s JOIN p USING (date))""",
  sql_grid(TOXICS_LAGS, FLAGS, ["price"], by="SELECT DISTINCT lat, lon FROM w")) + f"""
, days AS (SELECT lat, lon, date, row_number() OVER (PARTITION BY lat, lon ORDER BY date) - 1 AS idx
           FROM (SELECT DISTINCT lat, lon, date FROM xs) a JOIN (SELECT DISTINCT lat, lon, date FROM ys) b
           USING (lat, lon, date)),
xi AS (SELECT lat, lon, idx, series, value FROM xs JOIN days USING (lat, lon, date)),
yi AS (SELECT lat, lon, idx, series, value FROM ys JOIN days USING (lat, lon, date))""" + sql_cells(f"""
  SELECT xi.lat, xi.lon, xi.series AS series_x, yi.series AS series_y, CAST(lags.lag AS INTEGER) AS lag,
         count(*) AS n, {sql_pearson('xi.value', 'yi.value')} AS r
  FROM xi CROSS JOIN lags JOIN yi ON yi.lat = xi.lat AND yi.lon = xi.lon AND yi.idx = xi.idx + lags.lag
  GROUP BY 1, 2, 3, 4, 5""", by="lat, lon, "))
def tlcc_by_site(spark, sf):
    """Per-site correlation: each site's complete days against the price of
    the same days, positions counted per site."""
    # the price series is shared by every site: attached once to each site's
    # own days, both sides then are one frame (days without a price or with an
    # incomplete row are no usable days, but their site is still in the grid)
    w = wide(spark, sf, drop_null=False).join(prices(spark, sf).select("date", "price"), "date", "left")
    return rounded(xcorr.lagged_correlation(w, w, TOXICS_LAGS, FLAGS, ["price"], by=["lat", "lon"]),
                   special={"r": 8})


# --------------------------------------------------------------------------
# Ingest and cleaning
# --------------------------------------------------------------------------

@register("clean_measurements", with_(SQL_M) + """
SELECT criteria, state, county, lat, lon, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, date, value, unit FROM m""")
def clean_measurements(spark, sf):
    m = tables.lineitem_measurements_from_raw(spark, sf)
    return m.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


@register("distinct_criteria", with_(SQL_M) + "SELECT DISTINCT criteria FROM m ORDER BY 1")
def distinct_criteria(spark, sf):
    return clean.distinct_values(measurements(spark, sf), "criteria")


@register("distinct_units", with_(SQL_M) + "SELECT DISTINCT unit FROM m ORDER BY 1")
def distinct_units(spark, sf):
    from lagscope.operators.profile import distinct_units as units

    return units(measurements(spark, sf))


@register("snap_coordinates", with_(SQL_M) + """
SELECT round(lat, 3) AS lat, round(lon, 3) AS lon, count(*) AS n FROM m GROUP BY 1, 2""")
def snap_coordinates(spark, sf):
    snapped = clean.snap_coordinates(measurements(spark, sf), 3)
    return snapped.groupBy("lat", "lon").agg(F.count(F.lit(1)).alias("n"))


@register("year_filter", with_(SQL_M) + """
SELECT criteria, lat, lon, date, value FROM m WHERE year(date) BETWEEN 1996 AND 1998""")
def year_filter(spark, sf):
    from lagscope.sources.measurements import year_list

    m = clean.year_filter(measurements(spark, sf), year_list(1996, 1998))
    return m.select("criteria", "lat", "lon", "date", "value")


@register("sort_by_date", with_(SQL_M) + """
SELECT criteria, lat, lon, date, value FROM m ORDER BY date DESC""")
def sort_by_date(spark, sf):
    m = measurements(spark, sf).select("criteria", "lat", "lon", "date", "value")
    return clean.sort_by_date(m, ascending=False)


SQL_ROWTEXT = ("lower(concat_ws(' ', criteria, state, county, CAST(lat AS VARCHAR), CAST(lon AS VARCHAR), "
               "CAST(ts AS VARCHAR), CAST(date AS VARCHAR), CAST(value AS VARCHAR), unit)) LIKE '%nation_1%'")


@register("text_filter", with_(SQL_M) + f"""
SELECT criteria, state, county, date, value FROM m WHERE {SQL_ROWTEXT}""")
def text_filter(spark, sf):
    m = clean.text_filter(measurements(spark, sf), "NATION_1")
    return m.select("criteria", "state", "county", "date", "value")


@register("region_yearly_mean", with_(SQL_M) + f"""
SELECT CAST(year(date) AS INTEGER) AS year, round(avg(value),6) AS value FROM m WHERE {SQL_ROWTEXT} GROUP BY 1""")
def region_yearly_mean(spark, sf):
    m = clean.text_filter(measurements(spark, sf), "nation_1")
    return rounded(series.yearly_mean(m), PRICE_DIGITS)


@register("price_parts", with_(SQL_P) + """
SELECT date, round(price,6) AS price, strftime(date, '%Y') AS year_str, strftime(date, '%m') AS month_str,
       strftime(date, '%d') AS day_str, CAST(year(date) AS INTEGER) AS year,
       CAST(dayofyear(date) AS INTEGER) AS dayofyear FROM p""")
def price_parts(spark, sf):
    return rounded(tables.order_prices_parsed(spark, sf), PRICE_DIGITS)


# --------------------------------------------------------------------------
# Pivot and complete-case
# --------------------------------------------------------------------------

@register("pivot_mean", with_(SQL_M, SQL_W) + """
SELECT lat, lon, date, round("A",6) AS "A", round("N",6) AS "N", round("R",6) AS "R" FROM wc""")
def pivot_mean(spark, sf):
    return rounded(wide(spark, sf), PRICE_DIGITS)


@register("pivot_mean_unit", with_(SQL_M) + """
SELECT * FROM (
  SELECT round(lat, 3) AS lat, round(lon, 3) AS lon, date,
         round(avg(value) FILTER (WHERE criteria = 'A'),6) AS "A", min(unit) FILTER (WHERE criteria = 'A') AS "A_unit",
         round(avg(value) FILTER (WHERE criteria = 'N'),6) AS "N", min(unit) FILTER (WHERE criteria = 'N') AS "N_unit",
         round(avg(value) FILTER (WHERE criteria = 'R'),6) AS "R", min(unit) FILTER (WHERE criteria = 'R') AS "R_unit"
  FROM m GROUP BY 1, 2, 3) t
WHERE "A" IS NOT NULL AND "N" IS NOT NULL AND "R" IS NOT NULL""")
def pivot_mean_unit(spark, sf):
    return rounded(wide(spark, sf, with_unit=True), PRICE_DIGITS)


@register("complete_case", with_(SQL_M, SQL_W) + """
SELECT lat, lon, date, 'A' AS criteria, round("A",6) AS value FROM wc UNION ALL
SELECT lat, lon, date, 'N', round("N",6) FROM wc UNION ALL
SELECT lat, lon, date, 'R', round("R",6) FROM wc""")
def complete_case(spark, sf):
    snapped = clean.snap_coordinates(measurements(spark, sf), 3)
    return rounded(clean.complete_case_long(snapped, ["lat", "lon", "date"], FLAGS), PRICE_DIGITS)


# --------------------------------------------------------------------------
# Daily series and smoothing
# --------------------------------------------------------------------------

def _r6(*cols: str, digits: int = PRICE_DIGITS) -> str:
    return ", ".join(f'round("{c}", {digits}) AS "{c}"' for c in cols)


@register("daily_mean", with_(SQL_M, SQL_W, SQL_D) + f"SELECT date, year, dayofyear, {_r6(*FLAGS)} FROM d")
def daily_mean(spark, sf):
    return rounded(daily(spark, sf), PRICE_DIGITS)


@register("site_daily_mean", with_(SQL_M, SQL_W) + f"""
SELECT lat, lon, date, CAST(year(date) AS INTEGER) AS year, CAST(dayofyear(date) AS INTEGER) AS dayofyear,
       {", ".join(f'round(avg("{c}"),6) AS "{c}"' for c in FLAGS)}
FROM wc GROUP BY lat, lon, date""")
def site_daily_mean(spark, sf):
    return rounded(series.daily_mean(wide(spark, sf), FLAGS, by=["lat", "lon"]), PRICE_DIGITS)


@register("sma_centered", with_(SQL_M, SQL_W) + f"""
SELECT lat, lon, date, {", ".join(f'round(avg("{c}") OVER w,6) AS "{c}_sma12"' for c in FLAGS)}
FROM wc WINDOW w AS (PARTITION BY lat, lon ORDER BY date ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING)""")
def sma_centered(spark, sf):
    s = series.sma(wide(spark, sf), ["lat", "lon"], FLAGS, periods=12)
    return rounded(s.select("lat", "lon", "date", *[f"{c}_sma12" for c in FLAGS]), PRICE_DIGITS)


@register("sma_trailing", with_(SQL_M, SQL_W, SQL_D) + f"""
SELECT * FROM (
  SELECT date, {", ".join(f'CASE WHEN count(*) OVER w = 7 THEN round(avg("{c}") OVER w,6) END AS "{c}_ma7"'
                          for c in FLAGS)}
  FROM d WINDOW w AS (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)) t
WHERE "A_ma7" IS NOT NULL""")
def sma_trailing(spark, sf):
    s = series.sma(daily(spark, sf), [], FLAGS, periods=7, trailing=True)
    return rounded(s.select("date", *[f"{c}_ma7" for c in FLAGS]).where(F.col("A_ma7").isNotNull()), PRICE_DIGITS)


# Event series: hourly means per (site, event type).  Window operators run on
# these regular series (at most 24 rows per key and day), never on raw rows.
SQL_EH = """eh AS (SELECT site, criteria, date_trunc('hour', ts) AS ts, avg(value) AS value
  FROM e GROUP BY 1, 2, 3)"""
SQL_EI = """ei AS (SELECT *, row_number() OVER (PARTITION BY site, criteria ORDER BY ts) AS i FROM eh)"""
HOUR_FMT = "%Y-%m-%d %H:%M"


def hourly_events(spark, sf):
    return series.bucket_mean(events(spark, sf), ["site", "criteria"], ["value"], "ts", "hour")


def _hour_str(df):
    return df.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm"))


@register("ema_span3", with_(SQL_E, SQL_EH, SQL_EI) + f"""
SELECT a.site, a.criteria, strftime(a.ts, '{HOUR_FMT}') AS ts,
       round(sum(b.value * pow(0.5, a.i - b.i)) / sum(pow(0.5, a.i - b.i)), 6) AS value_ema
FROM ei a JOIN ei b ON a.site = b.site AND a.criteria = b.criteria AND b.i <= a.i
GROUP BY a.site, a.criteria, a.ts""")
def ema_span3(spark, sf):
    out = series.ema(hourly_events(spark, sf), ["site", "criteria"], ["value"], span=3, order=["ts"])
    return rounded(_hour_str(out.select("site", "criteria", "ts", "value_ema")))


@register("gradient_norm", with_(SQL_E, SQL_EH) + f"""
SELECT site, criteria, strftime(ts, '{HOUR_FMT}') AS ts,
       round(g / sqrt(sum(value * value) OVER (PARTITION BY site, criteria)), 6) AS value_grad
FROM (SELECT *,
        CASE WHEN lag(value) OVER w IS NOT NULL AND lead(value) OVER w IS NOT NULL
               THEN (lead(value) OVER w - lag(value) OVER w) / 2.0
             WHEN lag(value) OVER w IS NULL AND lead(value) OVER w IS NOT NULL THEN lead(value) OVER w - value
             WHEN lag(value) OVER w IS NOT NULL AND lead(value) OVER w IS NULL THEN value - lag(value) OVER w
        END AS g
      FROM eh WINDOW w AS (PARTITION BY site, criteria ORDER BY ts)) t""")
def gradient_norm(spark, sf):
    out = series.gradient(hourly_events(spark, sf), ["site", "criteria"], ["value"], order=["ts"])
    return rounded(_hour_str(out.select("site", "criteria", "ts", "value_grad")))


@register("shift_padded", with_(SQL_E, SQL_EH) + f"""
SELECT site, criteria, strftime(ts, '{HOUR_FMT}') AS ts,
       round(lag(value, 3, 0.0) OVER (PARTITION BY site, criteria ORDER BY ts), 6) AS value_shift3
FROM eh""")
def shift_padded(spark, sf):
    out = series.shift(hourly_events(spark, sf), ["site", "criteria"], "value", 3, order=["ts"], pad=0.0)
    return rounded(_hour_str(out.select("site", "criteria", "ts", "value_shift3")))


@register("shift_truncated", with_(SQL_E, SQL_EH) + f"""
SELECT site, criteria, strftime(ts, '{HOUR_FMT}') AS ts, round(v, 6) AS "value_shift-2" FROM (
  SELECT site, criteria, ts, lead(value, 2) OVER w AS v,
         row_number() OVER w AS pos, count(*) OVER (PARTITION BY site, criteria) AS cnt
  FROM eh WINDOW w AS (PARTITION BY site, criteria ORDER BY ts)) t
WHERE pos <= cnt - 2""")
def shift_truncated(spark, sf):
    out = series.shift(hourly_events(spark, sf), ["site", "criteria"], "value", -2, order=["ts"])
    return rounded(_hour_str(out.select("site", "criteria", "ts", "value_shift-2")))


@register("deseason_hourly", with_(SQL_E) + """
SELECT event_id, round(value - avg(value) OVER (PARTITION BY hour(ts)), 6) AS value FROM e""")
def deseason_hourly(spark, sf):
    e = events(spark, sf).select("event_id", "ts", "value")
    return rounded(series.deseason(e, "value", "ts", "hourly").select("event_id", "value"))


# Anomalies are differences of short decimals, many of which end exactly
# between two rounded values, where the order of a sum decides.  Both sides move
# them by the same amount, far below the last digit, off every such tie.
OFF_TIE = 2.718281828e-07


def _deseason_sql(part: str) -> str:
    cols = ", ".join(f'round("{c}" - avg("{c}") OVER (PARTITION BY {part}(date)) + {OFF_TIE}, 5) AS "{c}"' for c in FLAGS)
    return with_(SQL_M, SQL_W) + f"""
SELECT lat, lon, date, {cols} FROM wc"""


def off_tie(df: DataFrame, cols) -> DataFrame:
    return df.withColumns({c: F.col(c) + OFF_TIE for c in cols})


def _deseason(freq: str):
    def run(spark, sf):
        anomalies = off_tie(series.deseason(wide(spark, sf), FLAGS, "date", freq), FLAGS)
        return rounded(anomalies, 5, special={"lat": 6, "lon": 6})
    return run


register("deseason_daily", _deseason_sql("dayofmonth"))(_deseason("daily"))
register("deseason_monthly", _deseason_sql("month"))(_deseason("monthly"))
register("deseason_yearly", _deseason_sql("year"))(_deseason("yearly"))


@register("climatology", with_(SQL_M, SQL_W, SQL_D) + f"""
SELECT CAST(dayofyear AS INTEGER) AS dayofyear, {", ".join(f'round(avg("{c}") + {OFF_TIE},6) AS "{c}"' for c in FLAGS)}
FROM d GROUP BY 1""")
def climatology(spark, sf):
    return rounded(off_tie(series.climatology(daily(spark, sf), FLAGS), FLAGS), PRICE_DIGITS)


# --------------------------------------------------------------------------
# Scaling and norms
# --------------------------------------------------------------------------

@register("zscore", with_(SQL_M, SQL_W, SQL_D) + f"""
SELECT date, {", ".join(f'round({_sql_z(c)}, 6) AS "{c}"' for c in FLAGS)} FROM d""")
def zscore(spark, sf):
    return rounded(scale.zscore(daily(spark, sf), FLAGS).select("date", *FLAGS))


@register("maxabs_scale", with_(SQL_M, SQL_W, SQL_D) + f"""
SELECT date, {", ".join(f'round(CASE WHEN max(abs("{c}")) OVER () = 0 THEN 0.0 ELSE "{c}" / max(abs("{c}")) OVER () END, 6) AS "{c}"' for c in FLAGS)}
FROM d""")
def maxabs_scale(spark, sf):
    return rounded(scale.max_abs(daily(spark, sf), FLAGS).select("date", *FLAGS))


@register("minmax_scale", with_(SQL_M, SQL_W, SQL_D) + f"""
SELECT date, {", ".join(f'round(CASE WHEN max("{c}") OVER () = min("{c}") OVER () THEN 0.5 ELSE ("{c}" - min("{c}") OVER ()) / (max("{c}") OVER () - min("{c}") OVER ()) END, 6) AS "{c}"' for c in FLAGS)}
FROM d""")
def minmax_scale(spark, sf):
    return rounded(scale.min_max(daily(spark, sf), FLAGS).select("date", *FLAGS))


SMA12 = [f"{c}_sma12" for c in FLAGS]
SQL_S12 = f"""s AS (SELECT lat, lon, date, {", ".join(f'avg("{c}") OVER w AS "{c}_sma12"' for c in FLAGS)}
  FROM wc WINDOW w AS (PARTITION BY lat, lon ORDER BY date ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING))"""


@register("zscore_maxabs_chain", with_(SQL_M, SQL_W, SQL_S12, f"""z AS (
  SELECT lat, lon, date, {", ".join(f'{_sql_z(c)} AS "{c}"' for c in SMA12)} FROM s)""") + f"""
SELECT lat, lon, date, {", ".join(f'round(CASE WHEN max(abs("{c}")) OVER () = 0 THEN 0.0 ELSE "{c}" / max(abs("{c}")) OVER () END, 6) AS "{c}"' for c in SMA12)}
FROM z""")
def zscore_maxabs_chain(spark, sf):
    """The prepared-dataset chain: pivot -> centred SMA(12) per site ->
    keep the smoothed columns -> z-score -> max-abs."""
    s = series.sma(wide(spark, sf), ["lat", "lon"], FLAGS, periods=12)
    s = clean.select_like(s, "_sma", keep=["lat", "lon", "date"])
    return rounded(scale.zscore_max_abs(s, SMA12))


@register("l2_norm", with_(SQL_M, SQL_W, SQL_D) + f"""
SELECT date, round(sqrt({" + ".join(f'pow({_sql_z(c)}, 2)' for c in FLAGS)}), 6) AS norm FROM d""")
def l2_norm_query(spark, sf):
    z = scale.zscore(daily(spark, sf), FLAGS)
    return rounded(z.select("date", l2_norm(*FLAGS).alias("norm")))


# --------------------------------------------------------------------------
# Correlation matrix family (climatology of the daily national means)
# --------------------------------------------------------------------------

SQL_C = f"""c AS (SELECT dayofyear, {", ".join(f'avg("{c}") AS "{c}"' for c in FLAGS)} FROM d GROUP BY 1)"""
SQL_CM = "cm AS (" + " UNION ALL ".join(
    f"""SELECT '{a}' AS series_a, '{b}' AS series_b, {sql_pearson(f'"{a}"', f'"{b}"')} AS r FROM c"""
    for a in FLAGS for b in FLAGS) + ")"


def _corr(spark, sf):
    return xcorr.correlation_matrix(series.climatology(daily(spark, sf), FLAGS), FLAGS)


@register("corr_matrix", with_(SQL_M, SQL_W, SQL_D, SQL_C, SQL_CM) + "SELECT series_a, series_b, round(r, 8) AS r FROM cm")
def corr_matrix(spark, sf):
    return rounded(_corr(spark, sf), special={"r": 8})


@register("corr_mass", with_(SQL_M, SQL_W, SQL_D, SQL_C, SQL_CM) + """
SELECT series_a, round(sum(abs(r)), 6) AS mass FROM cm WHERE series_a <> series_b GROUP BY 1""")
def corr_mass(spark, sf):
    return rounded(xcorr.correlation_mass(_corr(spark, sf)))


@register("corr_adjacency", with_(SQL_M, SQL_W, SQL_D, SQL_C, SQL_CM) + """
SELECT series_a, series_b, CASE WHEN series_a <> series_b AND r > 0 THEN 1 ELSE 0 END AS adj FROM cm""")
def corr_adjacency(spark, sf):
    # the series are hardly correlated: only at this threshold both values occur
    return xcorr.adjacency(_corr(spark, sf), 0.0)


@register("badness_curve", with_(SQL_M, SQL_W, SQL_D, f"""z AS (
  SELECT date, row_number() OVER (ORDER BY date) AS i, {", ".join(f'{_sql_z(c)} AS "{c}"' for c in FLAGS)} FROM d)""",
  f"""em AS (
  SELECT a.date, {", ".join(f'sum(b."{c}" * pow(0.5, a.i - b.i)) / sum(pow(0.5, a.i - b.i)) AS "{c}"' for c in FLAGS)}
  FROM z a JOIN z b ON b.i <= a.i GROUP BY a.date)""") + f"""
SELECT CAST(dayofyear(date) AS INTEGER) AS dayofyear,
       round(sqrt({" + ".join(f'pow(avg("{c}"), 2)' for c in FLAGS)}), 6) AS badness
FROM em GROUP BY 1""")
def badness_curve(spark, sf):
    """L2 norm of the day-of-year mean of the z-scored, EMA(span 3)-smoothed
    national features (the notebook's aliasing makes the smoothing apply)."""
    z = scale.zscore(daily(spark, sf), FLAGS).select("date", *FLAGS)
    sm = series.ema(z, [], FLAGS, span=3, order=["date"])
    ema_cols = [f"{c}_ema" for c in FLAGS]
    clim = series.climatology(sm, ema_cols)
    return rounded(clim.select("dayofyear", l2_norm(*ema_cols).alias("badness")))


# --------------------------------------------------------------------------
# Per-site: latest row, cost score, heat map, density
# --------------------------------------------------------------------------

@register("latest_per_site", with_(SQL_M, SQL_W) + f"""
SELECT lat, lon, date, {_r6(*FLAGS)} FROM (
  SELECT *, row_number() OVER (PARTITION BY lat, lon ORDER BY date DESC) AS rn FROM wc) t WHERE rn = 1""")
def latest_per_site(spark, sf):
    return rounded(spatial.latest_per_site(wide(spark, sf), FLAGS), PRICE_DIGITS)


SMA10 = [f"{c}_sma10" for c in FLAGS]


def _sql_cost(where: str, latest_priced: bool) -> str:
    m_cte = SQL_M.replace("JOIN region r ON n.n_regionkey = r.r_regionkey)",
                          f"JOIN region r ON n.n_regionkey = r.r_regionkey {where})")
    semi = "WHERE date IN (SELECT date FROM p)" if latest_priced else ""
    return with_(m_cte, SQL_W, SQL_P, f"""s AS (
  SELECT lat, lon, date, {", ".join(f'avg("{c}") OVER w AS "{c}_sma10"' for c in FLAGS)}
  FROM wc WINDOW w AS (PARTITION BY lat, lon ORDER BY date ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING))""",
                 f"""z AS (SELECT lat, lon, date, sqrt({" + ".join(f'pow({_sql_z(c)}, 2)' for c in SMA10)}) AS norm FROM s)""",
                 f"""zl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lat, lon ORDER BY date DESC) AS rn
                          FROM z {semi}) t WHERE rn = 1)""",
                 f"""pz AS (SELECT date, abs({_sql_z('price')}) AS price_norm FROM p)""") + """
SELECT zl.lat, zl.lon, zl.date, round(zl.norm, 6) AS norm, round(pz.price_norm, 6) AS price_norm,
       round(zl.norm / nullif(pz.price_norm, 0), 6) AS score
FROM zl JOIN pz ON pz.date = zl.date"""


SQL_SHIP = """p AS (SELECT CAST(l_shipdate AS DATE) AS date, avg(l_extendedprice * (1 + l_tax)) AS price
  FROM lineitem GROUP BY 1)"""


@register("cost_score", _sql_cost("", False).replace(SQL_P, SQL_SHIP))
def cost_score(spark, sf):
    """Cost score on each site's latest day, against the price by ship date
    (the order price ends earlier than the measurements)."""
    return rounded(score.cost_score(wide(spark, sf), FLAGS, tables.ship_prices(spark, sf), lag=10))


@register("cost_score_latest_priced", _sql_cost("", True))
def cost_score_latest_priced(spark, sf):
    return rounded(score.cost_score(wide(spark, sf), FLAGS, prices(spark, sf), lag=10, latest_priced=True))


SQL_HW = f"""hw AS (
  SELECT lat, lon, date, sqrt({" + ".join(f'pow({_sql_z(c)}, 2)' for c in FLAGS)}) AS norm FROM wc),
hw2 AS (SELECT lat, lon, date, norm, CAST(floor(norm * 10) AS INTEGER) AS weight FROM hw WHERE year(date) = 1998)"""


def _heat(spark, sf):
    return spatial.heat_weights(wide(spark, sf), FLAGS, year=1998, factor=10)


@register("heatmap_weights", with_(SQL_M, SQL_W, SQL_HW) + """
SELECT lat, lon, date, round(norm, 6) AS norm, weight FROM hw2""")
def heatmap_weights(spark, sf):
    return rounded(_heat(spark, sf))


@register("heatmap_points", with_(SQL_M, SQL_W, SQL_HW) + """
SELECT lat, lon FROM (SELECT lat, lon, unnest(range(weight)) AS k FROM hw2) t""")
def heatmap_points(spark, sf):
    return spatial.heat_points(_heat(spark, sf))


@register("spatial_density", with_(SQL_M, SQL_W, SQL_HW) + """
SELECT round(lat, 1) AS lat, round(lon, 1) AS lon, count(*) AS n, CAST(sum(floor(norm * 10)) AS BIGINT) AS weight
FROM hw GROUP BY 1, 2""")
def spatial_density(spark, sf):
    weights = spatial.heat_weights(wide(spark, sf), FLAGS, factor=10)
    return rounded(spatial.spatial_density(weights, precision=1, weight="weight"))


# --------------------------------------------------------------------------
# Profile
# --------------------------------------------------------------------------

@register("summary_profile", with_(SQL_M, SQL_W, SQL_D) + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count("{c}") AS "count", round(avg("{c}"),6) AS mean,
       round(stddev_samp("{c}"),6) AS stddev, round(min("{c}"),6) AS "min", round(max("{c}"),6) AS "max" FROM d"""
    for c in FLAGS))
def summary_profile(spark, sf):
    from lagscope.operators.profile import summary

    return rounded(summary(daily(spark, sf), FLAGS), PRICE_DIGITS)


@register("criterion_profile", with_(SQL_M) + """
SELECT criteria, unit, count(value) AS "count", round(avg(value), 5) AS mean, round(stddev_samp(value), 5) AS stddev,
       min(value) AS "min", max(value) AS "max" FROM m GROUP BY 1, 2""")
def criterion_profile(spark, sf):
    """Statistics per criterion and unit, merged from the moments per (site,
    day, criterion, unit) as the profile job does it."""
    from lagscope.operators import profile

    parts = profile.moments(measurements(spark, sf), ["lat", "lon", "date", "criteria", "unit"], ["value"])
    return rounded(profile.merged(parts, ["value"], ["criteria", "unit"]).drop("column"), 5, special={"min": 10, "max": 10})


# --------------------------------------------------------------------------
# Timing shapes of the reference: 4 x 1 x 2, 4 x 4 x 4, 4 x 4 x 7
# (four numeric lineitem measures as the criteria)
# --------------------------------------------------------------------------

# Lag lists of the timing runs.
LAGS_2 = [0, 10]
LAGS_4 = [-10, 0, 10, 30]
LAGS_7 = [-60, -30, -10, 0, 10, 30, 60]
MEASURE_NAMES = [m[2:] for m in tables.MEASURES]


def sql_measures() -> str:
    sites = """FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey"""
    parts = [f"""SELECT '{name}' AS criteria,
         round(21.3247::DOUBLE + 1.0005::DOUBLE * (s.s_nationkey % 5), 6::INTEGER) AS lat,
         round(-158.0893::DOUBLE + 3.0015::DOUBLE * (s.s_nationkey % 5), 6::INTEGER) AS lon,
         CAST(l.l_shipdate AS DATE) AS date, round(l.{col}, 10) AS value
  {sites}""" for name, col in zip(MEASURE_NAMES, tables.MEASURES)]
    return "m AS (\n  " + "\n  UNION ALL\n  ".join(parts) + ")"


def sql_wide(crit) -> str:
    filt = ",\n         ".join(f"""avg(value) FILTER (WHERE criteria = '{c}') AS "{c}\"""" for c in crit)
    nn = " AND ".join(f'"{c}" IS NOT NULL' for c in crit)
    return f"""w AS (
  SELECT round(lat, 3) AS lat, round(lon, 3) AS lon, date,
         {filt}
  FROM m GROUP BY 1, 2, 3),
wc AS (SELECT * FROM w WHERE {nn})"""


def sql_daily(crit) -> str:
    return "d AS (SELECT date, " + ", ".join(f'avg("{c}") AS "{c}"' for c in crit) + " FROM wc GROUP BY date)"


def sql_long(crit, name="x") -> str:
    return f"{name} AS (" + " UNION ALL ".join(
        f"""SELECT date, '{c}' AS series, "{c}" AS value FROM d""" for c in crit) + ")"


def measure_daily(spark, sf):
    return series.daily_mean(tables.lineitem_site_days(spark, sf), MEASURE_NAMES)


_MEASURE_BASE = [sql_measures(), sql_wide(MEASURE_NAMES), sql_daily(MEASURE_NAMES), sql_long(MEASURE_NAMES)]


@register("tlcc_8", with_(*_MEASURE_BASE, SQL_P, SQL_Y) + sql_tlcc(LAGS_2, MEASURE_NAMES, ["price"]))
def tlcc_8(spark, sf):
    """8 correlations: 4 measures x price x lags {0, 10}."""
    return rounded(xcorr.lagged_correlation(measure_daily(spark, sf), prices(spark, sf), LAGS_2,
                                            MEASURE_NAMES, ["price"]), special={"r": 8})


@register("tlcc_64", with_(*_MEASURE_BASE, "y AS (SELECT * FROM x)") + sql_tlcc(LAGS_4, MEASURE_NAMES, MEASURE_NAMES))
def tlcc_64(spark, sf):
    """64 correlations: 4 x 4 measures x lags {-10, 0, 10, 30}."""
    return rounded(xcorr.auto_correlation(measure_daily(spark, sf), LAGS_4, MEASURE_NAMES), special={"r": 8})


@register("tlcc_112", with_(*_MEASURE_BASE, "y AS (SELECT * FROM x)") + sql_tlcc(LAGS_7, MEASURE_NAMES, MEASURE_NAMES))
def tlcc_112(spark, sf):
    """112 correlations: 4 x 4 measures x 7 lags."""
    return rounded(xcorr.auto_correlation(measure_daily(spark, sf), LAGS_7, MEASURE_NAMES), special={"r": 8})


# --------------------------------------------------------------------------
# Clustering of series: seven daily totals per site, which rise and fall
# together, and two national series that do not
# --------------------------------------------------------------------------

TOTALS = ["count", "extendedprice", "quantity", "discount", "tax", "net", "charge"]
SQL_TOTALS = """t AS (
  SELECT CAST(s.s_nationkey % 5 AS INTEGER) AS site, CAST(l.l_shipdate AS DATE) AS date,
         CAST(count(*) AS DOUBLE) AS "count", sum(l_extendedprice) AS extendedprice, sum(l_quantity) AS quantity,
         sum(l_discount) AS discount, sum(l_tax) AS tax, sum(l_extendedprice * (1 - l_discount)) AS net,
         sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS charge
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
  GROUP BY 1, 2)"""
SQL_LONG = "lg AS (" + " UNION ALL ".join(
    f"""SELECT '{c}@' || site AS series, date, "{c}" AS value FROM t""" for c in TOTALS) + """
  UNION ALL SELECT 'price', date, price FROM p UNION ALL SELECT 'ship price', date, price FROM sp)"""
SQL_CLUSTER = [SQL_TOTALS, SQL_P, SQL_SHIP.replace("p AS", "sp AS", 1), SQL_LONG,
               "cl AS (SELECT series, dayofyear(date) AS day, avg(value) AS value FROM lg GROUP BY 1, 2)",
               f"""cr AS (SELECT a.series AS series_a, b.series AS series_b, {sql_pearson('a.value', 'b.value')} AS r
  FROM cl a JOIN cl b USING (day) GROUP BY 1, 2)""",
               "nm AS (SELECT DISTINCT series FROM lg)",
               """aj AS (SELECT a.series AS series_a, b.series AS series_b,
    CASE WHEN a.series <> b.series AND r > 0.6 THEN 1 ELSE 0 END AS adj
  FROM nm a CROSS JOIN nm b LEFT JOIN cr ON cr.series_a = a.series AND cr.series_b = b.series)"""]


def series_adjacency(spark, sf, threshold: float = 0.6) -> DataFrame:
    """Adjacency of the per-site totals and the national prices, from the
    correlations of their day-of-year climatologies.  Long form throughout:
    the series are data, not columns."""
    p = prices(spark, sf).select(F.lit("price").alias("series"), "date", F.col("price").alias("value"))
    s = tables.ship_prices(spark, sf).select(F.lit("ship price").alias("series"), "date", F.col("price").alias("value"))
    long = tables.lineitem_totals(spark, sf).unionByName(p).unionByName(s)
    clim = long.groupBy("series", F.dayofyear("date").alias("day")).agg(F.avg("value").alias("value"))
    return xcorr.adjacency(xcorr.correlation_matrix_long(clim, "day"), threshold)


@register("series_adjacency", with_(*SQL_CLUSTER) + "SELECT * FROM aj")
def series_adjacency_query(spark, sf):
    return series_adjacency(spark, sf)


# variances of the components: largest eigenvalues of the covariance by power
# iteration, the first one deflated for the second
SQL_PCA = [*SQL_CLUSTER,
           "co AS (SELECT a.series_b AS i, b.series_b AS j, covar_samp(a.adj, b.adj) AS v FROM aj a JOIN aj b USING (series_a) GROUP BY 1, 2)",
           "ro AS (SELECT i, list(v ORDER BY j) AS row FROM co GROUP BY i)",
           "mx AS (SELECT list(row ORDER BY i) AS m FROM ro)",
           """p1 AS (
  SELECT 0 AS k, list_transform(m, lambda r: list_sum(r) + sqrt(1.0 + list_position(m, r))) AS v FROM mx
  UNION ALL
  SELECT k + 1, list_transform(w, lambda e: e / n) FROM (
    SELECT k, w, sqrt(list_dot_product(w, w)) AS n FROM (
      SELECT k, list_transform(m, lambda r: list_dot_product(r, v)) AS w FROM p1, mx WHERE k < 300)))""",
           """u1 AS (SELECT v, list_dot_product(v, list_transform(m, lambda r: list_dot_product(r, v))) AS l FROM p1, mx WHERE k = 300)""",
           """p2 AS (
  SELECT 0 AS k, list_transform(range(len(m)), lambda i: sin(1.0 + i * i)) AS v FROM mx
  UNION ALL
  SELECT k + 1, list_transform(w, lambda e: e / n) FROM (
    SELECT k, w, sqrt(list_dot_product(w, w)) AS n FROM (
      SELECT k, list_transform(list_zip(list_transform(m, lambda r: list_dot_product(r, p2.v)), u1.v),
                               lambda z: z[1] - u1.l * list_dot_product(u1.v, p2.v) * z[2]) AS w
      FROM p2, mx, u1 WHERE k < 300)))""",
           """u2 AS (SELECT list_dot_product(v, list_transform(m, lambda r: list_dot_product(r, v))) AS l FROM p2, mx WHERE k = 300)"""]


@register("pca_projection", with_(*SQL_PCA).replace("WITH ", "WITH RECURSIVE ", 1) + """
SELECT 1 AS component, round(l, 6) AS variance FROM u1 UNION ALL SELECT 2, round(l, 6) FROM u2""")
def pca_projection(spark, sf):
    """Variance of the adjacency rows along their first two components (the
    projection itself is free in sign, and in rotation where variances tie)."""
    from lagscope.operators import cluster

    pcs = cluster.pca_projection(series_adjacency(spark, sf), 2)
    long = pcs.unpivot(["series"], ["pc1", "pc2"], "pc", "v")
    return rounded(long.groupBy(F.substring("pc", 3, 1).cast("int").alias("component"))
                   .agg(F.var_samp("v").alias("variance")))


# density clusters of the adjacency rows, straight from the definition
SQL_DBSCAN = [*SQL_CLUSTER,
              "ix AS (SELECT series, row_number() OVER (ORDER BY series) - 1 AS i FROM nm)",
              """nb AS (SELECT a.series_a AS p, b.series_a AS q FROM aj a JOIN aj b USING (series_b)
  GROUP BY 1, 2 HAVING sum((a.adj - b.adj) * (a.adj - b.adj)) <= 2.3 * 2.3)""",
              "ce AS (SELECT p FROM nb GROUP BY p HAVING count(*) >= 5)",
              """re AS (
  SELECT p, p AS q FROM ce UNION
  SELECT re.p, nb.q FROM re JOIN nb ON nb.p = re.q JOIN ce ON ce.p = nb.q)""",
              "lb AS (SELECT p, min(ix.i) AS seed FROM re JOIN ix ON ix.series = re.q GROUP BY p)",
              "nu AS (SELECT p, dense_rank() OVER (ORDER BY seed) - 1 AS cluster FROM lb)",
              """cu AS (SELECT ix.series, CAST(coalesce(own.cluster, min(nu.cluster), -1) AS INTEGER) AS cluster
  FROM ix LEFT JOIN nu own ON own.p = ix.series LEFT JOIN nb ON nb.p = ix.series LEFT JOIN nu ON nu.p = nb.q
  GROUP BY ix.series, own.cluster)"""]


@register("density_clusters", with_(*SQL_DBSCAN).replace("WITH ", "WITH RECURSIVE ", 1) + "SELECT * FROM cu")
def density_clusters(spark, sf):
    from lagscope.operators import cluster

    return cluster.density_clusters(series_adjacency(spark, sf), eps=2.3, min_samples=5)


@register("cluster_members", with_(*SQL_DBSCAN).replace("WITH ", "WITH RECURSIVE ", 1) + """
SELECT cluster, string_agg(series, ';' ORDER BY series) AS members FROM cu GROUP BY cluster""")
def cluster_members(spark, sf):
    from lagscope.operators import cluster

    clusters = cluster.density_clusters(series_adjacency(spark, sf), eps=2.3, min_samples=5)
    return cluster.cluster_members(clusters).select("cluster", F.array_join("members", ";").alias("members"))


# --------------------------------------------------------------------------
# Scenarios, vectors and profile
# --------------------------------------------------------------------------

@register("scenario_national", with_(SQL_M, SQL_W, SQL_D) + f"""
SELECT date, year, dayofyear, {", ".join(f'round({_sql_z(c)}, 6) AS "{c}"' for c in FLAGS)} FROM d""")
def scenario_national(spark, sf):
    d, labels = scenarios.daily_table(measurements(spark, sf), FLAGS, "national")
    return rounded(scale.zscore(d, labels))


@register("scenario_site", with_(SQL_M, SQL_W) + f"""
SELECT lat, lon, date, CAST(year(date) AS INTEGER) AS year, CAST(dayofyear(date) AS INTEGER) AS dayofyear,
       {", ".join(f'round({_sql_z(c)}, 6) AS "{c}"' for c in FLAGS)} FROM wc""")
def scenario_site(spark, sf):
    d, labels = scenarios.daily_table(measurements(spark, sf), FLAGS, "site")
    return rounded(scale.zscore(d, labels))


@register("prepared_prices", with_(SQL_P, f"z AS (SELECT date, {_sql_z('price')} AS z FROM p)") + """
SELECT date, round(z / max(abs(z)) OVER (), 6) AS price FROM z""")
def prepared_prices(spark, sf):
    return rounded(scenarios.prepared_prices(prices(spark, sf)))


@register("vector_roundtrip", with_(SQL_M, SQL_W) + f"SELECT lat, lon, date, {_r6(*FLAGS)} FROM wc")
def vector_roundtrip(spark, sf):
    """Columns to a vector, to text, back to numbers."""
    from lagscope.sources import sinks

    v = reshape.to_vector(wide(spark, sf), FLAGS, "features").select("lat", "lon", "date", "features")
    return rounded(sinks.parse_vector_string(sinks.vector_to_string(v, "features"), "features", FLAGS), PRICE_DIGITS)


@register("vector_columns", with_(SQL_M, SQL_W, SQL_D) + f"SELECT date, {_r6(*FLAGS)} FROM d")
def vector_columns(spark, sf):
    v = reshape.to_vector(daily(spark, sf), FLAGS, "features").select("date", "features")
    return rounded(reshape.from_vector(v, "features", FLAGS), PRICE_DIGITS)


@register("gradient_climatology", with_(SQL_M, SQL_W, SQL_D, "g AS (SELECT dayofyear, " + ", ".join(
    f"""(CASE WHEN lag("{c}") OVER w IS NOT NULL AND lead("{c}") OVER w IS NOT NULL
              THEN (lead("{c}") OVER w - lag("{c}") OVER w) / 2.0
              WHEN lag("{c}") OVER w IS NULL THEN lead("{c}") OVER w - "{c}" ELSE "{c}" - lag("{c}") OVER w END)
        / sqrt(sum("{c}" * "{c}") OVER ()) AS "{c}\"""" for c in FLAGS) + " FROM d WINDOW w AS (ORDER BY date))") + f"""
SELECT dayofyear, {", ".join(f'round(avg("{c}"), 8) AS "{c}"' for c in FLAGS)} FROM g GROUP BY 1""")
def gradient_climatology(spark, sf):
    """Day-of-year mean of the normalised gradient of the national series."""
    g = series.gradient(daily(spark, sf), [], FLAGS).select("date", *[F.col(f"{c}_grad").alias(c) for c in FLAGS])
    return rounded(series.climatology(g, FLAGS), digits=8)


_PROFILE = [("criteria", "string"), ("state", "string"), ("county", "string"), ("lat", "double"), ("lon", "double"),
            ("ts", "timestamp"), ("date", "date"), ("value", "double"), ("unit", "string")]


@register("schema_profile", with_(SQL_M) + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", '{t}' AS dtype, count(*) AS "rows", count(*) - count({c}) AS nulls FROM m"""
    for c, t in _PROFILE))
def schema_profile(spark, sf):
    from lagscope.operators.profile import column_profile

    return column_profile(measurements(spark, sf))


@register("row_count", with_(SQL_M) + """SELECT count(*) AS "rows" FROM m""")
def row_count(spark, sf):
    from lagscope.operators.profile import row_count as rows

    return rows(measurements(spark, sf))


@register("named_aggregates", with_(SQL_M) + """
SELECT criteria, round(avg(value), 6) AS value, count(*) AS "count" FROM m GROUP BY 1""")
def named_aggregates(spark, sf):
    """Columns named by the aggregate functions themselves, then repaired."""
    raw = measurements(spark, sf).groupBy("criteria").agg({"value": "avg", "*": "count"})
    raw = raw.withColumnsRenamed({"count(1)": "count", "count(*)": "count"})
    return rounded(clean.sanitize_columns(clean.repair_aggregate_names(raw)), PRICE_DIGITS)


# --------------------------------------------------------------------------
# Feature matrix (min-max ids ++ max-abs of z-scored criteria)
# --------------------------------------------------------------------------

def _sql_minmax(c: str) -> str:
    return (f'CASE WHEN max({c}) OVER () = min({c}) OVER () THEN 0.5 '
            f'ELSE ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) END')


@register("feature_matrix", with_(SQL_M, SQL_W, f"""f AS (
  SELECT {_sql_minmax('lat')} AS lat, {_sql_minmax('lon')} AS lon,
         {_sql_minmax('CAST((date - DATE \'1970-01-01\') * 24 AS DOUBLE)')} AS time,
         {", ".join(f'{_sql_z(c)} AS "{c}"' for c in FLAGS)} FROM wc)""") + f"""
SELECT round(lat, 6) AS lat, round(lon, 6) AS lon, round(time, 6) AS time,
       {", ".join(f'round(CASE WHEN max(abs("{c}")) OVER () = 0 THEN 0.0 ELSE "{c}" / max(abs("{c}")) OVER () END, 6) AS "{c}"' for c in FLAGS)}
FROM f""")
def feature_matrix(spark, sf):
    return rounded(scenarios.feature_matrix(wide(spark, sf), FLAGS))


# --------------------------------------------------------------------------
# Lagged correlation on the hourly grain (events): per site, event types
# against each other, lags in complete hours
# --------------------------------------------------------------------------

# The event types and hour lags.
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
HOUR_LAGS = [-3, -1, 0, 1, 3]


@register("tlcc_events", with_(SQL_E, """h AS (
  SELECT site, date_trunc('hour', ts) AS ts,
         """ + ", ".join(f"avg(value) FILTER (WHERE criteria = '{t}') AS \"{t}\"" for t in EVENT_TYPES) + """
  FROM e GROUP BY 1, 2)""", "hc AS (SELECT * FROM h WHERE " + " AND ".join(f'"{t}" IS NOT NULL' for t in EVENT_TYPES) + ")",
  "hi AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY ts) AS idx FROM hc)",
  "x AS (" + " UNION ALL ".join(f"SELECT site, idx, '{t}' AS series, \"{t}\" AS value FROM hi" for t in EVENT_TYPES) + ")",
  sql_grid(HOUR_LAGS, EVENT_TYPES, EVENT_TYPES, by="SELECT DISTINCT site FROM h")) + sql_cells(f"""
  SELECT x.site, x.series AS series_x, y.series AS series_y, CAST(lags.lag AS INTEGER) AS lag, count(*) AS n,
         {sql_pearson('x.value', 'y.value')} AS r
  FROM x CROSS JOIN lags JOIN x y ON y.site = x.site AND y.idx = x.idx + lags.lag
  GROUP BY 1, 2, 3, 4""", by="site, "))
def tlcc_events(spark, sf):
    e = events(spark, sf).withColumn("ts", F.date_trunc("hour", "ts"))
    wide_h = reshape.pivot_wide(e, EVENT_TYPES, precision=None, keys=("site", "ts"), drop_null=False)
    return rounded(xcorr.auto_correlation(wide_h, HOUR_LAGS, EVENT_TYPES, by=["site"], date_col="ts"),
                   special={"r": 8})
