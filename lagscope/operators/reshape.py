"""Long <-> wide reshaping.

The canonical form is long ``(keys..., criteria, value)``; wide tables are
produced only where an operator needs one row per (site, day).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagscope.functions.exprs import sanitize_names
from lagscope.operators.clean import criteria_list, snap_coordinates
from lagscope.session import checkpoint_dir


def pivot_wide(df: DataFrame, criteria: Sequence[str] | None = None, precision: int | None = 3,
               drop_null: bool = True, with_unit: bool = False, extra_keys: Sequence[str] = (),
               keys: Sequence[str] = ("lat", "lon", "date"), criteria_col: str = "criteria",
               value_col: str = "value") -> DataFrame:
    """One row per (site, day), one mean column per criterion.

    * coordinates are snapped to ``precision`` decimals first (``None`` keeps
      them), so co-located sensors merge;
    * ``criteria`` fixes the pivot columns (sorted); passing them avoids the
      extra distinct job a value-less pivot runs.  Column names are
      sanitised (``PM2.5`` -> ``PM2_5``), collisions fail;
    * ``with_unit`` adds ``<criterion>_unit`` = the smallest unit string seen
      (deterministic, unlike ``first``);
    * ``drop_null`` keeps complete rows only (every criterion present).

    Plan: rows are first aggregated per (keys, criterion), partially before
    the shuffle, so raw rows never move and each updates one buffer however
    many criteria there are; the pivot then runs on the aggregated rows.
    """
    crit = sorted(criteria) if criteria is not None else criteria_list(df, criteria_col)
    sums = criterion_sums(df.where(F.col(criteria_col).isin(crit)), precision, with_unit, extra_keys, keys, criteria_col,
                          value_col)
    return pivot_sums(sums, crit, drop_null, with_unit, [*keys, *extra_keys], criteria_col)


def criterion_sums(df: DataFrame, precision: int | None = 3, with_unit: bool = False, extra_keys: Sequence[str] = (),
                   keys: Sequence[str] = ("lat", "lon", "date"), criteria_col: str = "criteria",
                   value_col: str = "value") -> DataFrame:
    """Sum and count of the values per (keys, criterion): what ``pivot_sums``
    turns wide.  A job whose criteria are not known stores this small table
    once and reads both the criteria and the pivot from it, so the raw rows
    are read once."""
    if precision is not None:
        df = snap_coordinates(df, precision)
    sums = [F.sum(value_col).alias("_s"), F.count(value_col).alias("_n")]
    if with_unit:
        sums.append(F.min("unit").alias("_u"))
    return df.groupBy(*keys, *extra_keys, criteria_col).agg(*sums)


def pivot_sums(sums: DataFrame, criteria: Sequence[str], drop_null: bool = True, with_unit: bool = False,
               keys: Sequence[str] = ("lat", "lon", "date"), criteria_col: str = "criteria") -> DataFrame:
    """One row per key, the mean of each criterion as a column.  ``sums`` has
    one row per key and criterion, as ``criterion_sums`` gives them.

    The cells of a key are gathered as one sorted array, so work and generated
    code follow the cells that are there, not rows x criteria.  A complete row
    has as many cells as there are criteria, and its columns are read from the
    array by place; only where incomplete rows are kept are cells numbered by a
    join with the criteria and the gaps between them filled."""
    crit = sorted(criteria)
    parts = {"_m": "try_divide(_s, _n)"} | ({"_u": "_u"} if with_unit else {})
    cells = sums.where(F.col(criteria_col).isin(crit)).withColumns({c: F.expr(e) for c, e in parts.items()})
    place = criteria_col
    if drop_null:
        cells = cells.where(" AND ".join(f"{c} IS NOT NULL" for c in parts))
    else:
        names = sums.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(c) for c in crit])).alias("_i", "_name"))
        cells, place = cells.join(names, F.col(criteria_col) == F.col("_name")), "_i"
    rows = cells.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(place).alias("_i"), *parts))).alias("_cells"))
    if drop_null:
        rows = rows.where(F.size("_cells") == len(crit))
    else:
        rows = rows.withColumn("_cells", _filled(rows.schema["_cells"].dataType.elementType.simpleString(), len(crit)))
    rows = rows.select(*keys, *[F.col(f"_cells.{c}").alias(c) for c in parts])
    names = sanitize_names(crit)
    wide = [(f"_m[{i}]", n) for i, n in enumerate(names)]
    if with_unit:
        wide = [x for i, (m, n) in enumerate(wide) for x in ((m, n), (f"_u[{i}]", n + "_unit"))]
    return rows.selectExpr(*[_quote(k) for k in keys], *[f"{e} AS {_quote(n)}" for e, n in wide])


def _filled(cell: str, many: int) -> Column:
    """``_cells`` (sorted by their place ``_i``) with a null at each of the
    ``many`` places that has none."""
    gap = f"CAST(NULL AS {cell})"
    return F.expr(f"""flatten(concat(
        transform(_cells, (c, j) -> concat(
            array_repeat({gap}, c._i - if(j = 0, -1, _cells[greatest(j - 1, 0)]._i) - 1), array(c))),
        array(array_repeat({gap}, {many - 1} - element_at(_cells, -1)._i))))""")


def discover_pivot(df: DataFrame, **how) -> tuple[DataFrame, list[str], list[str]]:
    """Pivot when the criteria are not known: ``(wide, criteria, labels)``.
    The per-criterion sums are checkpointed, so the raw rows are read once."""
    checkpoint_dir(df.sparkSession)
    sums = criterion_sums(df, **how).checkpoint()
    crit = criteria_list(sums)
    return pivot_sums(sums, crit), crit, sanitize_names(crit)


def discover_sums(sums: DataFrame) -> tuple[DataFrame, list[str]]:
    """``(wide, labels)`` from stored per-criterion sums: the criteria are
    those of the sums, which are checkpointed as both read them."""
    checkpoint_dir(sums.sparkSession)
    sums = sums.checkpoint()
    crit = criteria_list(sums)
    return pivot_sums(sums, crit), sanitize_names(crit)


def _quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], var: str = "series",
         val: str = "value") -> DataFrame:
    """Wide -> long: one row per (ids, column).  This is the distributed
    replacement for collecting each column into a driver-side array."""
    return df.unpivot(list(ids), list(values), var, val)


def to_vector(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    """Columns -> ML vector (adapter for MLlib stages)."""
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="keep").transform(df)


def from_vector(df: DataFrame, col: str, labels: Sequence[str], drop: bool = True) -> DataFrame:
    """ML vector -> one double column per label."""
    from pyspark.ml.functions import vector_to_array

    arr = vector_to_array(F.col(col))
    out = df.select("*", *[arr[i].alias(lab) for i, lab in enumerate(labels)])
    return out.drop(col) if drop else out
