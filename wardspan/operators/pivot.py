"""Entity-attribute-value reshaping."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardspan.functions.compat import col, epoch_us


@dataclass(frozen=True)
class Item:
    """One output column of a pivot: which item codes feed it and which values count."""

    codes: tuple
    agg: str = "max"
    lo: float | None = None
    hi: float | None = None
    lo_closed: bool = False
    hi_closed: bool = False
    text: bool = False
    scale: float | None = None


def item(*codes, **kw) -> Item:
    return Item(tuple(codes), **kw)


def _picked(it: Item, code: str, value: str, text: str) -> Column:
    v = F.col(text if it.text else value)
    ok = F.col(code).isin(*it.codes)
    if it.lo is not None:
        ok = ok & ((v >= it.lo) if it.lo_closed else (v > it.lo))
    if it.hi is not None:
        ok = ok & ((v <= it.hi) if it.hi_closed else (v < it.hi))
    return F.when(ok, v / F.lit(it.scale) if it.scale else v)


def pivot_items(
    df: DataFrame,
    keys: Sequence[str],
    spec: dict[str, Item],
    code: str = "itemid",
    value: str = "valuenum",
    text: str = "value",
    also: Sequence[Column] = (),
) -> DataFrame:
    """One row per key, one column per spec entry, in a single pass over the events.

    The union of all codes is applied as an ``IN`` filter so that it reaches the scan.
    """
    codes = sorted({c for it in spec.values() for c in it.codes})
    rows = df.filter(F.col(code).isin(*codes))
    aggs = [getattr(F, it.agg)(_picked(it, code, value, text)).alias(n) for n, it in spec.items()]
    return rows.groupBy(*keys).agg(*also, *aggs)


def hourly_grid(
    events: DataFrame,
    anchors: DataFrame,
    key: str,
    ts: str,
    t0: str,
    code: str,
    value: str,
    items: dict,
) -> DataFrame:
    """One row per (key, whole hour since ``t0``) with the mean of each item.

    Rows before ``t0`` are left out before grouping, and an hour whose values are all NULL gives
    no row. ``items`` maps item code to column name.
    """
    rows = events.filter(F.col(code).isin(*items)).select(key, ts, code, value)
    rows = rows.join(anchors.select(key, t0), key)
    us = epoch_us(ts) - epoch_us(t0)
    rows = rows.withColumn("hour", F.floor(us / F.lit(3_600_000_000)).cast("long"))
    rows = rows.filter(F.col("hour") >= 0)
    out = rows.groupBy(key, "hour").agg(
        *[F.avg(F.when(F.col(code) == c, F.col(value))).alias(n) for c, n in items.items()],
        F.count(value).alias("__n"),
    )
    return out.filter(F.col("__n") > 0).drop("__n")


def unify_vitals(grid: DataFrame) -> DataFrame:
    """Arterial before cuff pressure, Celsius before Fahrenheit, coma score only if complete."""
    gcs = F.col("gcs_eye") + F.col("gcs_verbal") + F.col("gcs_motor")
    return grid.withColumns(
        {
            "temp_c": F.coalesce("temp_c", (F.col("temp_f") - 32) * 5.0 / 9.0),
            "gcs_total": gcs,
            "sbp": F.coalesce("sbp_art", "sbp_ni"),
            "map": F.coalesce("map_art", "map_ni"),
        }
    )


def rank_pivot(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    value: str,
    n: int,
    prefix: str,
) -> DataFrame:
    """The first ``n`` values per key as columns; ranks beyond ``n`` are cut before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    top = df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n)
    return top.groupBy(*keys).agg(
        *[F.max(F.when(F.col("__rn") == i, F.col(value))).alias(f"{prefix}{i}") for i in range(1, n + 1)]
    )


def unpivot_long(
    df: DataFrame, keys: Sequence[str], cols: Sequence[str], name: str = "name", value: str = "value"
) -> DataFrame:
    """One row per non-NULL cell."""
    long = df.unpivot([F.col(k) for k in keys], [F.col(c) for c in cols], name, value)
    return long.filter(F.col(value).isNotNull())


def tagged_pivot(
    sources: dict[str, DataFrame], keys: Sequence[str], value: str, agg: str = "max"
) -> DataFrame:
    """Union of sources with a literal tag, then one aggregate column per tag."""
    parts = [s.select(*keys, F.col(value), F.lit(t).alias("__tag")) for t, s in sources.items()]
    f = getattr(F, agg)
    return (
        reduce(DataFrame.unionByName, parts)
        .groupBy(*keys)
        .agg(*[f(F.when(F.col("__tag") == t, F.col(value))).alias(t) for t in sources])
    )


def results_pivot(df: DataFrame, index: str, columns: str, values: list, value: str) -> DataFrame:
    """Mean per (index, column) with the column values known in advance."""
    return df.groupBy(index).pivot(columns, values).agg(F.avg(col(value)))
