"""Episodes, interval tiling and elementary segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardspan.functions.compat import date_diff_boundaries
from wardspan.operators.joins import interval_within
from wardspan.operators.scan import DAY, prefix_scan, time_bucket


def islands(
    df: DataFrame,
    keys: list[str],
    ts: str,
    status: str,
    max_gap: int = 14,
    unit: str = "hour",
    start: str = "starttime",
    end: str = "endtime",
    width_s: int = DAY,
) -> DataFrame:
    """Episodes of unchanged status.

    A row opens an episode if it is the first of its key, if the status differs from the row
    before, or if ``max_gap`` boundaries of ``unit`` passed since the last row of the same
    status. An episode ends at its last row, or at the row after it when that comes within the
    gap. Episodes whose rows all share one time are dropped.
    """
    rows = df.filter(F.col(status).isNotNull())
    rows = prefix_scan(
        rows,
        keys,
        [ts],
        time_bucket(ts, width_s),
        {"__ps": ("prev", status), "__pt": ("prev", ts), "__nt": ("next", ts)},
    )
    # within an unbroken run the row before has the same status, so its time is the one compared
    fresh = (
        F.col("__ps").isNull()
        | (F.col("__ps") != F.col(status))
        | (date_diff_boundaries(unit, "__pt", ts) >= max_gap)
    )
    rows = rows.withColumn("__new", fresh.cast("int"))
    rows = prefix_scan(
        rows, keys, [ts], time_bucket(ts, width_s), {"__seq": ("sum", "__new")}
    )
    last = F.when(
        F.col("__nt").isNull() | (date_diff_boundaries(unit, ts, "__nt") >= max_gap), F.col(ts)
    ).otherwise(F.col("__nt"))
    out = rows.groupBy(*keys, "__seq").agg(
        F.min(ts).alias(start),
        F.max(last).alias(end),
        F.max(status).alias(status),
        F.max(ts).alias("__last"),
    )
    return out.filter(F.col(start) != F.col("__last")).drop("__seq", "__last")


def tile_intervals(
    df: DataFrame,
    keys: list[str],
    start: str,
    end: str,
    end_fallback: Column,
    order: list[str | Column] | None = None,
    width_s: int = DAY,
) -> DataFrame:
    """Give every row the half-open interval up to the next row of its key."""
    out = prefix_scan(
        df, keys, order or [start], time_bucket(start, width_s), {"__nx": ("next", start)}
    )
    return out.withColumn(end, F.coalesce("__nx", end_fallback)).drop("__nx")


def tile_with_backfill(
    df: DataFrame,
    spans: DataFrame,
    keys: list[str],
    start: str,
    end: str,
    span_start: str,
    span_end: str,
    margin: str,
    values: list[str],
    order: list[str] | None = None,
) -> DataFrame:
    """Tile a key's whole span with its measurements.

    Each value holds until the next one, the last until ``margin`` after the span; if the first
    one comes after the span start, its value also covers the time from ``margin`` before it.
    """
    rows = df.join(spans.select(*keys, span_start, span_end), keys)
    tail = F.expr(f"{span_end} + interval {margin}")
    tiles = tile_intervals(rows, keys, start, end, tail, order or [start])
    ranked = F.struct(*[F.col(c) for c in (order or [start])])
    head = rows.groupBy(*keys).agg(
        F.min_by(F.struct(start, span_start, *values), ranked).alias("h")
    ).select(*keys, "h.*")
    head = head.filter(F.col(span_start) < F.col(start))
    head = head.select(
        *keys, F.expr(f"{span_start} - interval {margin}").alias("__s"), F.col(start).alias(end), *values
    ).withColumnRenamed("__s", start)
    return tiles.select(*keys, start, end, *values).unionByName(head)


def cut_points_of(spans: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Distinct starts and ends of a set of intervals."""
    both = spans.select(*keys, F.explode(F.array(F.col(start), F.col(end))).alias("__at"))
    return both.filter(F.col("__at").isNotNull()).distinct()


def segments(
    spans: DataFrame,
    keys: list[str],
    start: str,
    end: str,
    value: str,
    tag: str,
    tags: list[str],
    width_s: int = DAY,
) -> DataFrame:
    """Cut overlapping tagged intervals into elementary segments, one value column per tag.

    All sources travel in one frame: the cut points come from one distinct, and the containment
    join runs once for all sources rather than once per source. Where several rows of one tag
    cover a segment, each combination gives a row; otherwise a segment is one row.
    """
    rows = spans.filter(F.col(tag).isin(*tags))
    cuts = cut_points_of(rows, keys, start, end)
    seg = prefix_scan(cuts, keys, ["__at"], time_bucket("__at", width_s), {"__to": ("next", "__at")})
    seg = seg.filter(F.col("__to").isNotNull())
    seg = seg.select(*keys, F.col("__at").alias(start), F.col("__to").alias(end))
    outer = rows.select(
        *keys, F.col(start).alias("__s"), F.col(end).alias("__e"),
        F.struct(F.col(tag).alias("t"), F.col(value).alias("v")).alias("__v"),
    )
    hit = interval_within(seg, outer, keys, (start, end), ("__s", "__e"), "left", width_s)
    # one list per segment, not one per tag: a segment has few rows, and every list would be shuffled
    out = hit.groupBy(*keys, start, end).agg(F.collect_list("__v").alias("__all"))
    of = lambda t: F.filter("__all", lambda x: x["t"] == t)
    for t in tags:
        out = out.withColumn(t, F.explode_outer(of(t))).withColumn(t, F.col(t)["v"])
    return out.drop("__all")
