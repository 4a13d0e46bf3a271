"""Adapters from the star-schema Parquet tables to the sensor data model.

The operators are written for long measurement tables and a daily price
series.  These adapters derive both from the order/lineitem tables so that
every registered query scans real tables and its work grows with them:

=============  ==============================================================
measurement    one lineitem row; ``criteria`` = return flag (or one of four
               numeric measures), site = supplier nation modulo ``sites``,
               coordinates derived from the site, time = ship date plus an
               hour derived from the line number, value = extended price,
               unit = line status, state/county = nation/region name
price          daily mean order total price, written as ``yyyyMMdd`` strings
event          one event; ``criteria`` = event type, site = user modulo 5,
               time = event timestamp, value = event value
=============  ==============================================================

The raw adapters emit the *string* layout of the source files so the same
normalisation code path runs as for real CSV input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagscope.sources.measurements import VALUE_DIGITS, normalize_measurements
from lagscope.sources.prices import parse_prices

# Site coordinates are LAT0 + DLAT*site, LON0 + DLON*site (any grid would do).
LAT0, DLAT = 21.3247, 1.0005
LON0, DLON = -158.0893, 3.0015
DEFAULT_SITES = 5

# The four lineitem measures used as criteria in "measure" mode.
MEASURES = ["l_extendedprice", "l_quantity", "l_discount", "l_tax"]


# The column layout of the star-schema tables (as stored in
# their Parquet files).  Passing the schema avoids a footer-reading schema
# inference job per read; columns are still pruned at the scan.
TABLE_SCHEMAS = {
    "lineitem": ("l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                 "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                 "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"),
    "orders": ("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
               "o_orderdate timestamp_ntz, o_orderpriority string"),
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read
    if name in TABLE_SCHEMAS:
        reader = reader.schema(TABLE_SCHEMAS[name])
    return reader.parquet(table_path(sf_dir, name))


def _site_coords(site):
    return F.lit(LAT0) + F.lit(DLAT) * site, F.lit(LON0) + F.lit(DLON) * site


def nation_sites(spark: SparkSession, sf_dir: str, sites: int = DEFAULT_SITES) -> DataFrame:
    """Per-nation site attributes, computed once per nation rather than once
    per lineitem: site, coordinates (rounded to 6 decimals), nation and
    region names (raw and lower-cased).  Nation and region are fixed-size
    dimension tables (25 and 5 rows), so the result may be broadcast."""
    nat = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    reg = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    site = f"(n_nationkey % {int(sites)})"
    lat, lon = f"({LAT0!r}D + {DLAT!r}D * {site})", f"({LON0!r}D + {DLON!r}D * {site})"
    # projections are SQL expression strings: one driver call per projection
    return (nat.join(reg, nat.n_regionkey == reg.r_regionkey)
            .selectExpr("n_nationkey", f"{site} AS site", f"{lat} AS lat_raw", f"{lon} AS lon_raw",
                        f"round({lat}, 6) AS lat", f"round({lon}, 6) AS lon", "n_name", "r_name",
                        "lower(n_name) AS state", "lower(r_name) AS county"))


def _lineitem_sites(spark: SparkSession, sf_dir: str, cols: list[str], sites: int = DEFAULT_SITES) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", *cols)
    # a caller's choice: a table stored as one row group is one task, however
    # many cores wait; unset (the default), the scan is never shuffled
    parts = spark.conf.get("lagscope.scan.partitions", None)
    if parts:
        li = li.repartition(int(parts), "l_orderkey")
    # supplier grows with the data: the join strategy is left to AQE
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    dim = nation_sites(spark, sf_dir, sites)
    return li.join(sup, li.l_suppkey == sup.s_suppkey).join(dim, sup.s_nationkey == dim.n_nationkey)


def _criteria(j: DataFrame, criteria: str):
    """(frame, criterion expression, value expression) as SQL strings."""
    if criteria == "flag":
        return j, "l_returnflag", "l_extendedprice"
    if criteria == "measure":
        cells = ", ".join(f"named_struct('p', '{m[2:]}', 'v', {m})" for m in MEASURES)
        return j.selectExpr("*", f"explode(array({cells})) AS _m"), "_m.p", "_m.v"
    raise ValueError("criteria must be 'flag' or 'measure'")


_LI_COLS = ["l_returnflag", "l_linestatus", "l_linenumber", "l_shipdate", *MEASURES]


def lineitem_raw_measurements(spark: SparkSession, sf_dir: str, sites: int = DEFAULT_SITES,
                              criteria: str = "flag") -> DataFrame:
    """Raw (all-string) measurement rows built from lineitem, in the layout
    of the hourly source files (plus one extra column the reader ignores).

    ``criteria="flag"``: one row per lineitem, criterion = return flag.
    ``criteria="measure"``: four rows per lineitem, one per numeric measure.
    """
    j, param, value = _criteria(_lineitem_sites(spark, sf_dir, _LI_COLS, sites), criteria)
    param, value = F.expr(param), F.expr(value)
    site = F.col("site")
    return j.select(
        param.alias("Parameter Name"),
        F.col("n_name").alias("State Name"),
        F.col("r_name").alias("County Name"),
        F.col("lat_raw").cast("string").alias("Latitude"),
        F.col("lon_raw").cast("string").alias("Longitude"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("Date GMT"),
        F.concat((F.col("l_linenumber") + 6).cast("string"), F.lit(":00")).alias("Time GMT"),
        value.cast("string").alias("Sample Measurement"),
        F.col("l_linestatus").alias("Units of Measure"),
        site.cast("string").alias("Site Num"),
    )


def lineitem_measurements(spark: SparkSession, sf_dir: str, sites: int = DEFAULT_SITES,
                          criteria: str = "flag") -> DataFrame:
    """Typed long measurement table, as a landed (already normalised) table
    would be read: the same rows ``normalize_measurements`` produces from
    ``lineitem_raw_measurements``, built without the string round trip."""
    j, param, value = _criteria(_lineitem_sites(spark, sf_dir, _LI_COLS, sites), criteria)
    # the hours are added without a time zone, as the raw path parses them: a
    # day on which the session's zone changes its clock has the same hours
    return j.selectExpr(
        f"{param} AS criteria", "state", "county", "lat", "lon",
        "CAST(l_shipdate + make_dt_interval(0, l_linenumber + 6) AS TIMESTAMP) AS ts",
        "to_date(l_shipdate) AS date", f"round(CAST({value} AS DOUBLE), {VALUE_DIGITS}) AS value",
        "l_linestatus AS unit")


def lineitem_site_days(spark: SparkSession, sf_dir: str, sites: int = DEFAULT_SITES) -> DataFrame:
    """One row per (site, day) with the mean of each of the four measures, the
    rows ``pivot_wide`` gives for the measure form, straight from one
    aggregation of lineitem (the measures are columns already)."""
    j = _lineitem_sites(spark, sf_dir, ["l_shipdate", *MEASURES], sites)
    means = [F.avg(F.round(F.col(m).cast("double"), VALUE_DIGITS)).alias(m[2:]) for m in MEASURES]
    keys = [F.round("lat", 3).alias("lat"), F.round("lon", 3).alias("lon"), F.to_date("l_shipdate").alias("date")]
    return j.groupBy(*keys).agg(*means).na.drop(subset=[m[2:] for m in MEASURES])


def lineitem_totals(spark: SparkSession, sf_dir: str, sites: int = DEFAULT_SITES) -> DataFrame:
    """Long daily totals per site ``(series, date, value)``, seven series per
    site (``count@0``, ``quantity@0``, ...): the totals of a site rise and fall
    together with its number of rows, so its series correlate."""
    j = _lineitem_sites(spark, sf_dir, ["l_shipdate", *MEASURES], sites)
    site = F.round((F.col("lat_raw") - LAT0) / DLAT).cast("int")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    totals = {"count": F.count(F.lit(1)).cast("double"), **{m[2:]: F.sum(m) for m in MEASURES}, "net": F.sum(net),
              "charge": F.sum(net * (1 + F.col("l_tax")))}
    daily = j.groupBy(site.alias("site"), F.to_date("l_shipdate").alias("date")).agg(
        *[v.alias(k) for k, v in totals.items()])
    long = daily.unpivot(["site", "date"], list(totals), "what", "value")
    return long.select(F.concat_ws("@", "what", F.col("site").cast("string")).alias("series"), "date", "value")


def lineitem_measurements_from_raw(spark: SparkSession, sf_dir: str, sites: int = DEFAULT_SITES,
                                   criteria: str = "flag") -> DataFrame:
    """The measurement table through the raw-file path (strings ->
    ``normalize_measurements``), for the ingest/cleaning query."""
    return normalize_measurements(lineitem_raw_measurements(spark, sf_dir, sites, criteria))


def order_raw_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw price strings: daily mean order total price per order date."""
    o = table(spark, sf_dir, "orders").select("o_orderdate", "o_totalprice")
    daily = o.groupBy(F.to_date("o_orderdate").alias("d")).agg(F.avg("o_totalprice").alias("p"))
    return daily.select(F.date_format("d", "yyyyMMdd").alias("Date"),
                        F.col("p").cast("string").alias("Price"))


def order_prices(spark: SparkSession, sf_dir: str, years=None) -> DataFrame:
    """Typed daily price ``(date, price, year, dayofyear)`` straight from one
    aggregate of orders (dates are unique by construction, so the string
    round trip and de-duplication of ``parse_prices`` are not needed)."""
    # days without a date are dropped up front: every later join on the day
    # would drop them anyway, and an explicit filter keeps the plan branches
    # that read the price (statistics, join) identical, so the scan is shared
    o = (table(spark, sf_dir, "orders").where(F.col("o_orderdate").isNotNull())
         .select(F.to_date("o_orderdate").alias("date"), "o_totalprice").where(F.col("date").isNotNull()))
    if years is not None:
        o = o.where(F.year("date").isin([int(y) for y in years]))
    daily = o.groupBy("date").agg(F.avg("o_totalprice").alias("price"))
    return daily.select("date", "price", F.year("date").alias("year"), F.dayofyear("date").alias("dayofyear"))


def ship_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily price ``(date, price)`` by ship date: the mean charge of a
    lineitem.  It covers every day that has measurements."""
    li = table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("date"), "l_extendedprice", "l_tax")
    return li.where(F.col("date").isNotNull()).groupBy("date").agg(
        F.avg(F.col("l_extendedprice") * (1 + F.col("l_tax"))).alias("price"))


def lineitem_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long measurements of nine criteria at one site, named as chemical agents
    are, with dots, commas and hyphens (``1.5-Agent, A``)."""
    j = _lineitem_sites(spark, sf_dir, ["l_returnflag", "l_linenumber", "l_shipdate", "l_extendedprice"], sites=1)
    name = F.concat((F.col("l_linenumber") % 3).cast("string"), F.lit(".5-Agent, "), "l_returnflag")
    return j.select(name.alias("criteria"), "lat", "lon", F.to_date("l_shipdate").alias("date"),
                    F.round(F.col("l_extendedprice").cast("double"), VALUE_DIGITS).alias("value"))


def order_prices_parsed(spark: SparkSession, sf_dir: str, years=None) -> DataFrame:
    """The same series through the raw-file path (strings -> ``parse_prices``)."""
    return parse_prices(order_raw_prices(spark, sf_dir), years)


def event_measurements(spark: SparkSession, sf_dir: str, sites: int = DEFAULT_SITES) -> DataFrame:
    """Hourly-grain long table from events (keeps ``event_id`` for order ties)."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    site = F.col("user_id") % F.lit(sites)
    lat, lon = _site_coords(site)
    return ev.select(
        "event_id",
        F.col("event_type").alias("criteria"),
        site.cast("int").alias("site"),
        F.round(lat, 6).alias("lat"),
        F.round(lon, 6).alias("lon"),
        F.col("ts"),
        F.to_date("ts").alias("date"),
        F.col("value"),
    )
