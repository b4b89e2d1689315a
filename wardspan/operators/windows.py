"""Time-series windows over entity timelines, built on the bucketed scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardspan.functions.compat import col, epoch_us, from_epoch_us
from wardspan.operators.scan import (
    DAY,
    prefix_scan,
    rolling_range,
    rolling_rows,
    row_numbers,
    time_bucket,
)

HOURS_PER_BUCKET = 24 * 30


def hour_bucket(hour: str) -> Column:
    return F.floor(F.col(hour) / F.lit(HOURS_PER_BUCKET)).cast("long")


def ffill_flagged(grid: DataFrame, keys: list[str], hour: str, cols: Sequence[str]) -> DataFrame:
    """Carry each column forward within its key.

    Adds ``<c>_was_imputed`` (empty before, filled after) and ``<c>_hours_since_last_obs``.
    """
    specs: dict[str, tuple[str, Column]] = {}
    for c in cols:
        seen = F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"), F.col(hour).alias("h")))
        specs[f"__f_{c}"] = ("last", seen)
    out = prefix_scan(grid, keys, [hour], hour_bucket(hour), specs)
    new: dict[str, Column] = {}
    for c in cols:
        f = F.col(f"__f_{c}")
        new[f"{c}_was_imputed"] = F.col(c).isNull() & f["v"].isNotNull()
        new[f"{c}_hours_since_last_obs"] = F.col(hour) - f["h"]
    out = out.withColumns(new)
    out = out.withColumns({c: F.col(f"__f_{c}")["v"] for c in cols})
    return out.drop(*[f"__f_{c}" for c in cols])


def rolling_stats(
    df: DataFrame,
    keys: list[str],
    order: str,
    cols: Sequence[str],
    widths: Sequence[int],
    bucket: Column | None = None,
) -> DataFrame:
    """Mean, population deviation and slope per hour over the last ``w`` rows.

    The slope is against ``order``. It is 0 with fewer than two rows and NULL when a value in
    the window is missing; the deviation of a single value is 0.
    """
    b = hour_bucket(order) if bucket is None else bucket
    aggs: dict[str, tuple[Column, int, int]] = {}
    for w in widths:
        frame = (-(w - 1), 0)
        aggs[f"__rows_{w}"] = (F.count(F.lit(1)), *frame)
        for c in cols:
            v, h = F.col(c).cast("double"), F.col(order).cast("double")
            aggs[f"{c}_{w}h_mean"] = (F.avg(v), *frame)
            aggs[f"{c}_{w}h_std"] = (F.stddev_pop(v), *frame)
            aggs[f"__s_{c}_{w}"] = (F.regr_slope(v, h), *frame)
            aggs[f"__n_{c}_{w}"] = (F.count(v), *frame)
    out = rolling_rows(df, keys, [order], b, 0, 0, aggs)
    slopes = {
        f"{c}_{w}h_slope": F.when(F.col(f"__n_{c}_{w}") < F.col(f"__rows_{w}"), F.lit(None))
        .when(F.col(f"__rows_{w}") < 2, F.lit(0.0))
        .otherwise(F.col(f"__s_{c}_{w}"))
        for c in cols
        for w in widths
    }
    return out.withColumns(slopes).drop(*[n for n in aggs if n.startswith("__")])


def trailing_drop(
    df: DataFrame,
    keys: list[str],
    order: str,
    value: str,
    lookback: int,
    points: float,
    unless: Column,
    name: str,
    bucket: Column | None = None,
) -> DataFrame:
    """True where the value fell by ``points`` below the best of the ``lookback`` rows before."""
    b = hour_bucket(order) if bucket is None else bucket
    out = rolling_rows(df, keys, [order], b, -lookback, -1, {"__best": F.max(value)})
    fell = (F.col("__best") - F.col(value)) >= points
    return out.withColumn(name, F.coalesce(fell & ~unless, F.lit(False))).drop("__best")


def prior_counts(
    df: DataFrame, keys: list[str], ts: str, days: int, name: str, unit_us: int = 1
) -> DataFrame:
    """Number of earlier rows of the key inside the trailing ``days``, strictly before.

    The running count before the row less the running count before the start of its window: one
    scan, whatever the number of rows in the window. Rows of equal time are combined first.
    """
    span = days * 86_400_000_000 // unit_us
    at = F.floor(epoch_us(ts) / F.lit(unit_us)).cast("long")
    d = df.withColumn("__at", at)
    per = d.filter(F.col("__at").isNotNull()).groupBy(*keys, "__at").agg(F.count(F.lit(1)).alias("__n"))
    entry = lambda t, side, n, kind: F.struct(
        t.alias("__t"), F.lit(side).alias("__side"), n.alias("__w"), F.lit(kind).alias("__kind"))
    none = F.lit(0).cast("long")
    entries = F.array(entry(F.col("__at"), 1, F.col("__n"), 0), entry(F.col("__at"), 0, none, 1), entry(F.col("__at") - span, 0, none, -1))
    stack = per.select(*keys, "__at", F.inline(entries))
    bucket = F.floor(F.col("__t") / F.lit(max(1, span // 12))).cast("long")
    run = prefix_scan(stack, keys, ["__t", "__side", "__at"], bucket, {"__run": ("sum", "__w")}).filter("__kind <> 0")
    k = F.struct(*keys, "__at")
    counts = run.groupBy(k.alias("__k")).agg(F.sum(F.col("__run") * F.col("__kind")).alias(name))
    out = d.withColumn("__k", k).join(counts, "__k", "left")
    return out.withColumn(name, F.coalesce(name, none)).drop("__k", "__at")


def trailing_event_counts(
    grid: DataFrame,
    events: DataFrame,
    keys: list[str],
    at: str,
    event_at: str,
    widths: Sequence[int],
    prefix: str,
    weight: Column | None = None,
) -> DataFrame:
    """Per grid row, events of a second stream with time in ``(at - w, at]`` for each width.

    Times of the grid and events are stacked and scanned together, so no pairs are formed. Positions are
    fractional hours; they are compared at microsecond precision. ``weight`` is how many events
    a row stands for.
    """
    scale = 3_600_000_000
    at_us = F.round(F.col(at) * scale).cast("long")
    # the counts depend on key and time alone: the other columns of the grid meet them at the end
    g = grid.select(*keys, at_us.alias("__t"), F.lit(0).alias("__ev"), F.lit(True).alias("__asked")).distinct()
    e = events.select(
        *keys, F.round(F.col(event_at) * scale).cast("long").alias("__t"), (F.lit(1) if weight is None else weight).alias("__ev")
    )
    out = g.unionByName(e, allowMissingColumns=True)
    frames = {f"{prefix}{w}h": (F.sum("__ev"), -(w * scale - 1), 0) for w in widths}
    out = rolling_range(out, keys, F.col("__t"), 0, 0, frames).filter("__asked")
    names = [f"{prefix}{w}h" for w in widths]
    out = out.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__t").alias("__at"), *names)
    same = at_us.eqNullSafe(F.col("__at"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return grid.join(out, same).select(*grid.columns, *names)


def dense_ranks(df: DataFrame, keys: list[str], order: str, bucket: Column, name: str) -> DataFrame:
    """Dense rank: distinct order values are numbered, then joined back."""
    values = df.select(*keys, order).distinct()
    ranked = row_numbers(values, keys, [order], bucket, name)
    return df.join(ranked, [*keys, order])


def sequence_features(
    df: DataFrame, keys: list[str], ts: str, end_ts: str, tie: Sequence[str] = ()
) -> DataFrame:
    """Position in the key's history, days to the next start and days since the previous end."""
    out = prefix_scan(
        df,
        keys,
        [ts, *tie],
        time_bucket(ts, 365 * DAY),
        {"__n": ("sum", F.lit(1)), "next_start": ("next", ts), "prev_end": ("prev", end_ts)},
    )
    day = F.lit(86_400_000_000.0)
    return out.withColumns(
        {
            "n_prior": (F.col("__n") - 1).cast("long"),
            "days_to_next": (epoch_us("next_start") - epoch_us(end_ts)) / day,
            "days_since_prev": (epoch_us(ts) - epoch_us("prev_end")) / day,
        }
    ).drop("__n")


def path_string(
    df: DataFrame,
    keys: list[str],
    ts: str,
    value: str,
    name: str = "path",
    sep: str = " -> ",
    width_s: int = DAY,
    repeats: bool = False,
) -> DataFrame:
    """Ordered values, without consecutive repeats unless ``repeats``, joined to one string per key.

    Strings are first joined inside time slices, then across slices.
    """
    b = time_bucket(ts, width_s)
    moves = df
    if not repeats:
        moves = prefix_scan(df, keys, [ts], b, {"__pv": ("prev", value)})
        moves = moves.filter(F.col("__pv").isNull() | (F.col("__pv") != F.col(value)))

    def joined(frame: DataFrame, by: list[str], at: str, text: str) -> DataFrame:
        pairs = F.array_sort(F.collect_list(F.struct(F.col(at).alias("a"), F.col(text).alias("t"))))
        return frame.groupBy(*by).agg(F.array_join(F.transform(pairs, lambda p: p["t"]), sep).alias(name))

    part = joined(moves.withColumn("__sl", time_bucket(ts, width_s)), [*keys, "__sl"], ts, value)
    return joined(part, keys, "__sl", name)


def interpolate(
    df: DataFrame,
    keys: list[str],
    ts: str,
    value: str,
    step_s: int,
    max_gap_s: int,
    origin: str | None = None,
    width_s: int = DAY,
) -> DataFrame:
    """Linear interpolation to a fixed cadence between neighbouring anchors.

    Cadence points are multiples of ``step_s`` after ``origin`` (a timestamp column, else the
    epoch). A point on an anchor belongs to the span that ends there, the first anchor to the
    first span. Spans longer than ``max_gap_s`` give no points; nothing lies beyond the anchors.
    """
    rows = df.filter(F.col(value).isNotNull())
    rows = prefix_scan(
        rows, keys, [ts], time_bucket(ts, width_s), {"__t0": ("prev", ts), "__v0": ("prev", value), "__n": ("sum", F.lit(1))}
    )
    zero = epoch_us(origin) if origin else F.lit(0).cast("long")
    step = F.lit(step_s * 1_000_000)
    rows = rows.withColumns({"__z": zero, "__a": epoch_us("__t0"), "__b": epoch_us(ts)})
    rows = rows.filter(F.col("__a").isNotNull())
    rows = rows.filter((F.col("__b") - F.col("__a")) <= max_gap_s * 1_000_000)
    from_a, to_b = F.col("__a") - F.col("__z"), F.col("__b") - F.col("__z")
    first = F.when(F.col("__n") == 2, F.ceil(from_a / step)).otherwise(F.floor(from_a / step) + 1)
    rows = rows.withColumns({"__i": first.cast("long"), "__k": F.floor(to_b / step).cast("long")})
    rows = rows.filter(F.col("__i") <= F.col("__k"))
    rows = rows.withColumn("__i", F.explode(F.sequence("__i", "__k")))
    rows = rows.withColumn("__us", F.col("__z") + F.col("__i") * step)
    frac = (F.col("__us") - F.col("__a")) / (F.col("__b") - F.col("__a"))
    return rows.select(
        *keys,
        from_epoch_us(F.col("__us")).alias("at"),
        (F.col("__v0") + (F.col(value) - F.col("__v0")) * frac).alias(value),
    )


def last_bucket(df: DataFrame, keys: list[str], ts: str, hours: int, value: str) -> DataFrame:
    """First and last value inside the newest calendar bucket of each key."""
    us = epoch_us(ts)
    b = F.floor(us / F.lit(hours * 3_600_000_000)).cast("long")
    per = (
        df.withColumn("__b", b)
        .groupBy(*keys, "__b")
        .agg(
            F.min_by(value, us).alias("first_value"),
            F.max_by(value, us).alias("last_value"),
            F.count(F.lit(1)).alias("n"),
        )
    )
    best = F.max_by(F.struct("__b", "first_value", "last_value", "n"), F.col("__b")).alias("s")
    out = per.groupBy(*keys).agg(best)
    start = from_epoch_us(F.col("s.__b") * F.lit(hours * 3_600_000_000))
    return out.select(*keys, start.alias("bucket_start"), "s.first_value", "s.last_value", "s.n")


def pad_sequences(
    df: DataFrame, keys: list[str], order: str, cols: Sequence[str], n: int, bucket: Column
) -> DataFrame:
    """The last ``n`` rows up to each row as an array of arrays, left-padded with zeros."""
    vec = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols])
    rows = df.withColumn("__v", vec)
    out = rolling_rows(rows, keys, [order], bucket, -(n - 1), 0, {"seq": F.collect_list("__v")})
    zero = F.array(*[F.lit(0.0) for _ in cols])
    padded = F.concat(F.array_repeat(zero, n - F.size("seq")), F.col("seq"))
    return out.withColumn("seq", padded).drop("__v")


def rmssd(df: DataFrame, keys: list[str], ts: str, value: str, width_s: int = DAY) -> DataFrame:
    """Root mean square of successive differences; 0 with fewer than two values."""
    rows = prefix_scan(df, keys, [ts], time_bucket(ts, width_s), {"__p": ("prev", value)})
    sq = F.avg(F.pow(F.col(value) - F.col("__p"), 2))
    return rows.groupBy(*keys).agg(F.coalesce(F.sqrt(sq), F.lit(0.0)).alias("rmssd"))


def gaps(df: DataFrame, keys: list[str], ts: str, name: str = "gap_s", width_s: int = DAY) -> DataFrame:
    """Seconds since the previous row of the key (NULL on the first)."""
    rows = prefix_scan(df, keys, [ts], time_bucket(ts, width_s), {"__p": ("prev", ts)})
    return rows.withColumn(name, (epoch_us(ts) - epoch_us("__p")) / F.lit(1e6)).drop("__p")


def carried(
    df: DataFrame,
    keys: list[str],
    ts: str,
    cols: Sequence[str],
    valid_s: int,
    suffix: str = "_prev",
    width_s: int = DAY,
) -> DataFrame:
    """Previous row's values where that row is less than ``valid_s`` seconds old."""
    specs = {f"{c}{suffix}": ("prev", F.col(c)) for c in cols}
    rows = prefix_scan(df, keys, [ts], time_bucket(ts, width_s), {**specs, "__pt": ("prev", col(ts))})
    fresh = epoch_us(ts) - epoch_us("__pt") < F.lit(valid_s * 1_000_000)
    rows = rows.withColumns({c: F.when(fresh, F.col(c)) for c in specs})
    return rows.withColumn("prev_fresh", F.coalesce(fresh, F.lit(False))).drop("__pt")


__all__ = [
    "carried", "ffill_flagged", "gaps", "hour_bucket", "interpolate", "last_bucket",
    "pad_sequences", "path_string", "prior_counts", "rmssd", "rolling_range", "rolling_rows",
    "rolling_stats", "row_numbers", "sequence_features", "trailing_drop", "trailing_event_counts",
]
