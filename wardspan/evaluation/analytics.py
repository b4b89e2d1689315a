"""Descriptive statistics over event timelines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardspan.functions.compat import all_present, col, epoch_us
from wardspan.operators.scan import exact_percentiles, prefix_scan, time_bucket, weighted_ranks


def hours_between(a: Column | str, b: Column | str) -> Column:
    return (epoch_us(b) - epoch_us(a)) / F.lit(3.6e9)


def corr_matrix(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation of each unordered column pair over rows where both are present."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    aggs = []
    for a, b in pairs:
        both = all_present(a, b)
        x, y = F.when(both, F.col(a).cast("double")), F.when(both, F.col(b).cast("double"))
        aggs.append(F.corr(x, y).alias(f"{a}|{b}"))
    one = df.groupBy(*by).agg(*aggs)
    cells = F.array(
        *[
            F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r"))
            for a, b in pairs
        ]
    )
    return one.select(*by, F.inline(cells))


def line_fit(df: DataFrame, by: Sequence[str], y: Column, x: Column) -> DataFrame:
    return df.groupBy(*by).agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
        F.regr_count(y, x).alias("n"),
    )


def fixed_histogram(df: DataFrame, value: Column, lo: int, hi: int, by: Sequence[str] = ()) -> DataFrame:
    """Counts per unit bin in [lo, hi) with empty bins kept."""
    spark = df.sparkSession
    b = F.floor(value).cast("long")
    counts = df.withColumn("bin", b).filter((F.col("bin") >= lo) & (F.col("bin") < hi))
    counts = counts.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))
    if by:
        axis = df.select(*by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(lo).cast("long"), F.lit(hi - 1).cast("long"))))
    else:
        axis = spark.range(lo, hi).withColumnRenamed("id", "bin")
    out = axis.join(counts, [*by, "bin"], "left")
    return out.withColumn("n", F.coalesce("n", F.lit(0)))


def at_risk(spans: DataFrame, hours: str, max_h: int) -> DataFrame:
    """Entities whose span is longer than ``h`` for every hour, from one count per length.

    Lengths are cut to whole hours first, so the running total is over at most ``max_h`` rows.
    """
    # length > h for integer h means h <= ceil(length) - 1
    top = F.least(F.ceil(hours), F.lit(max_h)).cast("long") - 1
    per = spans.groupBy(top.alias("hour")).agg(F.count(F.lit(1)).alias("c"))
    axis = spans.sparkSession.range(0, max_h).withColumnRenamed("id", "hour")
    w = Window.orderBy(F.col("hour").desc())
    out = axis.join(per, "hour", "left")
    return out.select("hour", F.coalesce(F.sum("c").over(w), F.lit(0)).alias("at_risk"))


def at_risk_rates(
    events: DataFrame,
    spans: DataFrame,
    family: str,
    event_hour: str,
    span_hours: str,
    max_h: int,
    min_at_risk: int = 10,
    smooth: int = 3,
) -> DataFrame:
    """Events per entity-hour still at risk, by family and hour.

    Hours with too few entities take the mean rate of the well-covered hours. The smoothed rate
    is a centred average with zero padding.
    """
    risk = at_risk(spans, span_hours, max_h)
    h = F.floor(event_hour).cast("long")
    counts = events.withColumn("hour", h).filter((F.col("hour") >= 0) & (F.col("hour") < max_h))
    counts = counts.groupBy(family, "hour").agg(F.count(F.lit(1)).alias("n"))
    axis = events.select(family).distinct()
    axis = axis.withColumn("hour", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max_h - 1).cast("long"))))
    g = axis.join(F.broadcast(risk), "hour").join(counts, [family, "hour"], "left")
    g = g.withColumn("raw", F.coalesce("n", F.lit(0)) / F.greatest("at_risk", F.lit(1)))
    ok = F.col("at_risk") >= min_at_risk
    # a family has at most max_h rows here
    fam = Window.partitionBy(family)
    g = g.withColumn("rate", F.when(ok, F.col("raw")).otherwise(F.avg(F.when(ok, F.col("raw"))).over(fam)))
    half = smooth // 2
    w = Window.partitionBy(family).orderBy("hour").rowsBetween(-half, half)
    return g.select(family, "hour", "at_risk", "rate", (F.sum("rate").over(w) / smooth).alias("smoothed"))


def stationary_rates(
    rates: DataFrame, family: str, burst_h: int = 24, min_at_risk: int = 10
) -> DataFrame:
    """Mean rate after the first day over well-covered hours, and the first-day burst ratio."""
    late = (F.col("hour") >= burst_h) & (F.col("at_risk") >= min_at_risk)
    s = rates.groupBy(family).agg(
        F.avg(F.when(late, F.col("rate"))).alias("late"),
        F.avg("rate").alias("overall"),
        F.avg(F.when(F.col("hour") < burst_h, F.col("rate"))).alias("early"),
    )
    s = s.withColumn("stationary_rate", F.coalesce("late", "overall"))
    return s.select(family, "stationary_rate", F.try_divide(F.col("early"), F.col("late")).alias("burst_ratio"))


def peak_total_rate(rates: DataFrame) -> DataFrame:
    """Largest hourly sum of the smoothed rates over all families."""
    return rates.groupBy("hour").agg(F.sum("smoothed").alias("r")).agg(F.max("r").alias("peak_rate"))


def diurnal_profile(df: DataFrame, by: Sequence[str], ts: str) -> DataFrame:
    """Per hour of day: events and their multiple of an even spread, empty hours as 0."""
    n = df.groupBy(*by).agg(
        *[F.count(F.when(F.hour(F.col(ts)) == h, 1)).alias(f"h{h}") for h in range(24)],
        F.count(F.lit(1)).alias("total"),
    )
    cells = F.array(*[F.struct(F.lit(h).alias("hour"), F.col(f"h{h}").alias("n")) for h in range(24)])
    out = n.select(*by, "total", F.inline(cells))
    return out.select(*by, "hour", "n", (F.col("n") / F.col("total") * 24).alias("multiplier"))


def slot_share(df: DataFrame, by: Sequence[str], ts: str, every: int = 4) -> DataFrame:
    """Share of events in hours divisible by ``every``, and the busiest hour (smallest on ties)."""
    per = df.groupBy(*by, F.hour(F.col(ts)).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("m"), F.col("h").alias("h")))
    return per.groupBy(*by).agg(
        (F.sum(F.when(F.col("h") % every == 0, F.col("n")).otherwise(0)) / F.sum("n")).alias("slot_share"),
        best["h"].alias("peak_hour"),
    )


def icc(df: DataFrame, group: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Between-group and within-group variance and the share between, from group moments."""
    v = F.col(value).cast("double")
    g = df.filter(v.isNotNull()).groupBy(*by, group).agg(
        F.count(v).alias("n"), F.avg(v).alias("m"), F.var_pop(v).alias("s")
    )
    n, m = F.col("n"), F.col("m")
    total = F.sum(n)
    grand = F.sum(n * m) / total
    out = g.groupBy(*by).agg(
        (F.sum(n * m * m) / total - grand * grand).alias("between_var"),
        (F.sum(n * F.col("s")) / total).alias("within_var"),
    )
    both = F.col("between_var") + F.col("within_var")
    return out.withColumn("icc", F.try_divide(F.col("between_var"), both))


def autocorr(
    df: DataFrame,
    key: str,
    hour: str,
    value: str,
    max_lag: int = 36,
    min_rows: int = 24,
    min_pairs: int = 8,
) -> DataFrame:
    """Mean over entities of the within-entity correlation at each lag in hours.

    ``df`` has one fresh value per (key, hour). Each row is sent to the hour it is compared with,
    one copy per lag, and met there by an equi join on (key, hour). The copies are not in Spark's size
    estimate, so neither side may be taken for small and sent to every executor.
    """
    rows = df.filter(F.col(value).isNotNull()).select(key, hour, F.col(value).cast("double").alias("a"))
    enough = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_rows)
    rows = rows.join(enough.select(key), key, "left_semi")
    lead = rows.withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(max_lag))))
    lead = lead.select(key, (F.col(hour) - F.col("lag")).alias(hour), "lag", F.col("a").alias("b"))
    pairs = rows.join(lead.hint("merge"), [key, hour])
    per = pairs.groupBy(key, "lag").agg(
        F.count(F.lit(1)).alias("n"), F.corr("a", "b").alias("r"),
        F.stddev_samp("a").alias("sa"), F.stddev_samp("b").alias("sb"),
    )
    per = per.filter((F.col("n") > min_pairs) & (F.col("sa") > 0) & (F.col("sb") > 0))
    return per.groupBy("lag").agg(F.avg("r").alias("acf"), F.count(F.lit(1)).alias("n_entities"))


def event_aligned(
    df: DataFrame, events: DataFrame, key: str, hour: str, event_hour: str, value: str, back: int = 24
) -> DataFrame:
    """Mean value by hours before the event and its change from the earliest hour shown."""
    j = df.join(events.select(key, event_hour), key)
    lag = F.rint(F.col(event_hour) - F.col(hour)).cast("long")
    j = j.withColumn("hours_before", lag).filter(F.col("hours_before").between(0, back))
    m = j.groupBy("hours_before").agg(F.avg(value).alias("mean"), F.countDistinct(key).alias("support"))
    # at most back + 1 rows remain
    ref = F.max(F.when(F.col("hours_before") == back, F.col("mean"))).over(Window.partitionBy(F.lit(0)))
    return m.withColumn("deviation", F.col("mean") - ref)


def prevalence_by(df: DataFrame, band: Column, y: str) -> DataFrame:
    return df.groupBy(band.alias("band")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.col(y).cast("long")).alias("positives"),
        F.avg(F.col(y).cast("double")).alias("prevalence"),
    )


def missing_ratio(df: DataFrame, y: str, flags: Sequence[str]) -> DataFrame:
    """Share of set flags among positives and negatives and their ratio, one row per flag."""
    aggs = []
    for f in flags:
        x = F.col(f).cast("double")
        aggs += [F.avg(F.when(F.col(y) == 1, x)).alias(f"p_{f}"), F.avg(F.when(F.col(y) == 0, x)).alias(f"n_{f}")]
    one = df.agg(*aggs)
    cells = F.array(
        *[
            F.struct(
                F.lit(f).alias("flag"), F.col(f"p_{f}").alias("if_positive"), F.col(f"n_{f}").alias("if_negative")
            )
            for f in flags
        ]
    )
    out = one.select(F.inline(cells))
    return out.withColumn("ratio", F.try_divide(F.col("if_positive"), F.col("if_negative")))


def gap_stats(df: DataFrame, key: str, ts: str, by: Sequence[str] = (), lo_min: float = 55, hi_min: float = 65) -> DataFrame:
    """Median of per-entity median gaps in minutes, and the share of gaps within a range."""
    keys = [*by, key]
    rows = prefix_scan(df, keys, [ts], time_bucket(ts), {"__p": ("prev", ts)})
    gap = (epoch_us(ts) - epoch_us("__p")) / F.lit(6e7)
    rows = rows.withColumn("gap", gap).filter(F.col("gap").isNotNull())
    med = exact_percentiles(rows, keys, "gap", {"m": 0.5}).withColumn("__g", F.lit(1))
    mm = exact_percentiles(med, ["__g", *by], "m", {"median_gap": 0.5})
    share = rows.withColumn("__g", F.lit(1)).groupBy("__g", *by).agg(
        F.avg(F.col("gap").between(lo_min, hi_min).cast("double")).alias("share_hourly"),
        F.count(F.lit(1)).alias("n_gaps"),
    )
    return mm.join(share, ["__g", *by]).drop("__g")


def lift_table(df: DataFrame, key: str, group: str, flag: str, min_members: int = 5) -> DataFrame:
    """Share of a group's entities with the flag against the share over all entities."""
    per = df.groupBy(group, key).agg(F.max(F.col(flag).cast("int")).alias("f"))
    g = per.groupBy(group).agg(F.count(F.lit(1)).alias("members"), F.sum("f").alias("with_event"))
    everyone = df.groupBy(key).agg(F.max(F.col(flag).cast("int")).alias("f"))
    overall = everyone.agg(F.avg(F.col("f").cast("double")).alias("overall_share"))
    g = g.filter(F.col("members") >= min_members).withColumn("__one", F.lit(1))
    out = g.join(F.broadcast(overall.withColumn("__one", F.lit(1))), "__one").drop("__one")
    share = F.col("with_event") / F.col("members")
    return out.select(
        group, "members", share.alias("share_with_event"), "overall_share",
        F.try_divide(share, F.col("overall_share")).alias("lift"),
    )


def mann_whitney(df: DataFrame, value: str, first: Column) -> DataFrame:
    """U statistic of the group ``first`` against the rest with tie correction; one-sided z, p.

    The p-value is the upper tail of the normal approximation with continuity correction.
    """
    d = df.withColumn("__a", F.when(first, 1).otherwise(0)).withColumn("__g", F.lit(1))
    r = weighted_ranks(d, ["__g"], value, {"n": F.lit(1), "a": F.col("__a")})
    rank = F.col("n_upto") - F.col("n") + (F.col("n") + 1) / 2
    s = r.agg(
        F.sum(F.col("a") * rank).alias("r1"),
        F.max("a_all").cast("double").alias("n1"),
        F.max(F.col("n_all") - F.col("a_all")).cast("double").alias("n2"),
        F.sum(F.pow(F.col("n").cast("double"), 3) - F.col("n")).alias("ties"),
    )
    n = F.col("n1") + F.col("n2")
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    var = F.col("n1") * F.col("n2") / 12 * ((n + 1) - F.col("ties") / (n * (n - 1)))
    s = s.withColumns({"u": u, "z": (u - F.col("n1") * F.col("n2") / 2 - 0.5) / F.sqrt(var)})
    return s.select("u", "z", "n1", "n2", normal_tail(F.col("z")).alias("p_greater"))


def normal_tail(z: Column) -> Column:
    """Upper tail of the standard normal by a five-term rational approximation (error < 1e-7)."""
    x = F.abs(z)
    k = 1 / (1 + 0.2316419 * x)
    # fixed values: coefficients of the approximation, highest power first
    poly = F.lit(1.330274429)
    for c in (-1.821255978, 1.781477937, -0.356563782, 0.319381530):
        poly = poly * k + c
    tail = F.exp(-x * x / 2) * 0.3989422804014327 * poly * k
    return F.when(z >= 0, tail).otherwise(1 - tail)


def frequency_of_frequencies(df: DataFrame, code: str) -> DataFrame:
    n = df.groupBy(code).agg(F.count(F.lit(1)).alias("times_used"))
    return n.groupBy("times_used").agg(F.count(F.lit(1)).alias("n_codes"))


def coverage(df: DataFrame, category: str, item: str, entity: str, value: str | None = None) -> DataFrame:
    """Rows, distinct items and distinct entities per category."""
    aggs = [F.count(F.lit(1)).alias("rows"), F.countDistinct(item).alias("items")]
    out = df.groupBy(category).agg(*aggs)
    ent = df.select(category, entity).distinct().groupBy(category).agg(F.count(F.lit(1)).alias("entities"))
    return out.join(ent, category)


def describe(df: DataFrame, by: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Count, mean, deviation, extremes and exact percentiles."""
    v = col(value)
    base = df.groupBy(*by).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"), F.max(v).alias("max"),
    )
    return base.join(exact_percentiles(df, by, value, probs), by)
