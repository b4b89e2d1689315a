"""Reporting tables: daily summaries, shift handover, weekly digest, ward lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardspan.functions.compat import epoch_us, from_epoch_us
from wardspan.operators.sampling import topk

_HOUR_US = 3_600_000_000


def daily_summary(
    grid: DataFrame,
    key: str,
    hour: str,
    score: str,
    tier: str,
    starts: dict[str, DataFrame],
    anchors: DataFrame,
    t0: str,
    labs: DataFrame | None = None,
) -> DataFrame:
    """One row per entity and day: score and tier by hour, what started, tier at day's end.

    ``starts`` maps a flag name to first-start times (key, event_time). A day has at most 24
    grid rows, so the hourly arrays are bounded.
    """
    d = grid.withColumn("day_index", F.floor(F.col(hour) / 24).cast("long"))
    rows = F.array_sort(F.collect_list(F.struct(F.col(hour).alias("h"), F.col(score).alias("s"), F.col(tier).alias("t"))))
    g = d.groupBy(key, "day_index").agg(rows.alias("r"), F.max_by(tier, hour).alias("outstanding_tier"))
    g = g.select(
        key, "day_index", "outstanding_tier",
        F.transform("r", lambda x: x["s"]).alias("score_trajectory"),
        F.transform("r", lambda x: x["t"]).alias("tier_trajectory"),
    )
    for name, s in starts.items():
        at = s.join(anchors.select(key, t0), key)
        day = F.floor((epoch_us("event_time") - epoch_us(t0)) / F.lit(24 * _HOUR_US)).cast("long")
        hit = at.select(key, day.alias("day_index"), F.lit(True).alias(name)).distinct()
        g = g.join(hit, [key, "day_index"], "left").withColumn(name, F.coalesce(name, F.lit(False)))
    if labs is not None:
        n = labs.groupBy(key).agg(F.count(F.lit(1)).alias("abnormal_labs"))
        g = g.join(n, key, "left").withColumn("abnormal_labs", F.coalesce("abnormal_labs", F.lit(0)))
    return g


def shift_handover(
    grid: DataFrame,
    key: str,
    abs_time: str,
    score: str,
    tier: str,
    starts: dict[str, DataFrame],
    active_alerts: DataFrame,
    hours: int = 4,
) -> DataFrame:
    """Per entity the rows in its newest calendar block: first and last score, new starts."""
    us = epoch_us(abs_time)
    b = F.floor(us / F.lit(hours * _HOUR_US)).cast("long")
    per = grid.withColumn("__b", b).groupBy(key, "__b").agg(
        F.min(abs_time).alias("window_start"), F.max(abs_time).alias("window_end"),
        F.min_by(score, abs_time).alias("score_start"), F.max_by(score, abs_time).alias("score_end"),
        F.max_by(tier, abs_time).alias("tier_end"),
    )
    rest = ["window_start", "window_end", "score_start", "score_end", "tier_end"]
    out = per.groupBy(key).agg(F.max_by(F.struct(*rest), F.col("__b")).alias("s")).select(key, "s.*")
    for name, s in starts.items():
        out = out.join(s.select(key, F.col("event_time").alias("__e")), key, "left")
        within = F.col("__e").between(F.col("window_start"), F.col("window_end"))
        out = out.withColumn(name, F.coalesce(within, F.lit(False))).drop("__e")
    n = active_alerts.filter(F.col("status").isin("active", "escalated")).groupBy(key)
    out = out.join(n.agg(F.count(F.lit(1)).alias("active_alerts")), key, "left")
    return out.withColumn("active_alerts", F.coalesce("active_alerts", F.lit(0)))


def weekly_digest(obs: DataFrame, key: str, ts: str, channel: str, value: str, days: int = 7) -> DataFrame:
    """Per elapsed day since the first observation: means of the channels seen, and sample count.

    A channel without a sample that day is absent from the map, not zero. Means are computed per
    (entity, day, channel) first, so a map is built from one row per channel.
    """
    first = obs.groupBy(key).agg(F.min(ts).alias("__t0"))
    d = obs.join(first, key)
    day = F.floor((epoch_us(ts) - epoch_us("__t0")) / F.lit(24 * _HOUR_US)).cast("long") + 1
    d = d.withColumn("day_index", day).filter(F.col("day_index") <= days)
    per = d.groupBy(key, "day_index", channel).agg(F.avg(value).alias("__m"), F.count(F.lit(1)).alias("__n"))
    m = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(channel), F.col("__m")))))
    return per.groupBy(key, "day_index").agg(m.alias("means"), F.sum("__n").alias("n_samples"))


def ward_list(grid: DataFrame, key: str, hour: str, cols: list[str]) -> DataFrame:
    """Latest grid row per entity."""
    best = F.max_by(F.struct(hour, *cols), F.col(hour)).alias("s")
    return grid.groupBy(key).agg(best).select(key, "s.*")


def latest_abnormal(labs: DataFrame, key: str, ts: str, tie: str, n: int = 10) -> DataFrame:
    return topk(labs, [key], [F.col(ts).desc_nulls_last(), F.col(tie).desc()], n)


def set_names(flags: dict[str, Column]) -> Column:
    """Names of the flags that are set, in the given order."""
    return F.filter(F.array(*[F.when(c == 1, F.lit(n)) for n, c in flags.items()]), lambda x: x.isNotNull())


def assessment_hour(grid: DataFrame, key: str, hour: str, escalates: Column) -> DataFrame:
    """Latest escalating hour per entity, else the latest hour, with the basis in words."""
    g = grid.groupBy(key).agg(
        F.max(F.when(escalates, F.col(hour))).alias("__e"), F.max(hour).alias("__l")
    )
    basis = F.when(F.col("__e").isNotNull(), "latest escalating hour").otherwise(
        "latest scored hour (no hour escalates)"
    )
    return g.select(key, F.coalesce("__e", "__l").alias("hour"), basis.alias("basis"))


def stay_of_ref(ref: Column, prefix: str = "ICUStay/") -> Column:
    """Numeric id behind a reference; NULL for any other form."""
    return F.regexp_extract(ref, f"^{prefix}(-?[0-9]+)$", 1).try_cast("long")


def most_escalating(grid: DataFrame, key: str, escalates: Column, n: int) -> DataFrame:
    g = grid.groupBy(key).agg(F.count(F.when(escalates, 1)).alias("n_escalating"))
    return g.orderBy(F.col("n_escalating").desc(), key).limit(n)


__all__ = [
    "assessment_hour", "daily_summary", "from_epoch_us", "latest_abnormal", "most_escalating",
    "set_names", "shift_handover", "stay_of_ref", "ward_list", "weekly_digest",
]
