"""Interval, as-of and windowed joins.

Range predicates are turned into equi joins on ``(keys, time slice)``: a point lies in exactly
one slice and an interval is copied to every slice it touches, so a hot key is spread over its
slices and no pair is ever formed outside one slice. These joins are merge joins: Spark's sizes do not
count the copies and are of compressed rows, so many small spans would be sent whole to the driver. The
strategy of all other joins is left to Spark.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardspan.functions.compat import col, epoch_us
from wardspan.operators.scan import DAY, prefix_scan, time_bucket

_SLICE = "__slice"


def _lower(ts: Column, bound: Column, closed: bool) -> Column:
    return ts >= bound if closed else ts > bound


def _upper(ts: Column, bound: Column, closed: bool) -> Column:
    return ts <= bound if closed else ts < bound


def _slices(start: Column, end: Column, width_s: int) -> Column:
    return F.explode(F.sequence(time_bucket(start, width_s), time_bucket(end, width_s)))


def point_in_interval(
    points: DataFrame,
    intervals: DataFrame,
    on: list[str],
    ts: str,
    start: str,
    end: str,
    closed: tuple[bool, bool] = (True, False),
    how: str = "inner",
    width_s: int = DAY,
) -> DataFrame:
    """Join each point to the intervals of its key that contain it.

    ``closed`` says which ends belong to the interval; ``how`` may be ``inner``, ``left``,
    ``left_semi`` or ``left_anti``. Non-key column names must differ between the sides.
    """
    p = points.withColumn(_SLICE, time_bucket(ts, width_s)).alias("p")
    i = (
        intervals.filter(F.col(start) <= F.col(end))
        .withColumn(_SLICE, _slices(F.col(start), F.col(end), width_s))
        .alias("i")
    )
    cond = F.col(f"p.{_SLICE}") == F.col(f"i.{_SLICE}")
    for k in on:
        cond = cond & (F.col(f"p.{k}") == F.col(f"i.{k}"))
    cond = cond & _lower(F.col(f"p.{ts}"), F.col(f"i.{start}"), closed[0])
    cond = cond & _upper(F.col(f"p.{ts}"), F.col(f"i.{end}"), closed[1])
    out = p.join(i.hint("merge"), cond, how)
    keep = [F.col(f"p.{c}") for c in points.columns]
    if how in ("inner", "left"):
        keep += [F.col(f"i.{c}") for c in intervals.columns if c not in on]
    return out.select(*keep)


def overlaps(
    a: DataFrame,
    b: DataFrame,
    on: list[str],
    a_span: tuple[str, str],
    b_span: tuple[str, str],
    closed: bool = False,
    width_s: int = DAY,
) -> DataFrame:
    """Pairs of intervals of one key that overlap, each pair once."""
    left = a.withColumn(_SLICE, _slices(F.col(a_span[0]), F.col(a_span[1]), width_s)).alias("a")
    right = b.withColumn(_SLICE, _slices(F.col(b_span[0]), F.col(b_span[1]), width_s)).alias("b")
    a0, a1 = F.col(f"a.{a_span[0]}"), F.col(f"a.{a_span[1]}")
    b0, b1 = F.col(f"b.{b_span[0]}"), F.col(f"b.{b_span[1]}")
    cond = F.col(f"a.{_SLICE}") == F.col(f"b.{_SLICE}")
    for k in on:
        cond = cond & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    cond = cond & (((a0 <= b1) & (a1 >= b0)) if closed else ((a0 < b1) & (a1 > b0)))
    first_common = time_bucket(F.greatest(a0, b0), width_s) == F.col(f"a.{_SLICE}")
    out = left.join(right.hint("merge"), cond & first_common, "inner")
    return out.select(
        *[F.col(f"a.{c}") for c in a.columns], *[F.col(f"b.{c}") for c in b.columns if c not in on]
    )


def overlap_flag(
    a: DataFrame,
    b: DataFrame,
    on: list[str],
    a_span: tuple[str, str],
    b_span: tuple[str, str],
    name: str,
    closed: bool = False,
    width_s: int = DAY,
) -> DataFrame:
    """``a`` with a boolean: does any interval of ``b`` with the same key overlap the row?"""
    spans = a.select(*on, *a_span).distinct()
    right = b.select(*on, F.col(b_span[0]).alias("__b0"), F.col(b_span[1]).alias("__b1"))
    hit = overlaps(spans, right, on, a_span, ("__b0", "__b1"), closed, width_s)
    hit = hit.select(*on, *a_span).distinct().withColumn("__hit", F.lit(True))
    out = a.join(hit, [*on, *a_span], "left")
    return out.withColumn(name, F.coalesce("__hit", F.lit(False))).drop("__hit")


def interval_within(
    inner: DataFrame,
    outer: DataFrame,
    on: list[str],
    inner_span: tuple[str, str],
    outer_span: tuple[str, str],
    how: str = "left",
    width_s: int = DAY,
) -> DataFrame:
    """Attach the intervals of ``outer`` that contain the whole inner interval."""
    i0, i1 = inner_span
    o0, o1 = outer_span
    p = inner.withColumn(_SLICE, time_bucket(i0, width_s)).alias("p")
    o = (
        outer.filter(F.col(o0) <= F.col(o1))
        .withColumn(_SLICE, _slices(F.col(o0), F.col(o1), width_s))
        .alias("o")
    )
    cond = F.col(f"p.{_SLICE}") == F.col(f"o.{_SLICE}")
    for k in on:
        cond = cond & (F.col(f"p.{k}") == F.col(f"o.{k}"))
    cond = cond & (F.col(f"p.{i0}") >= F.col(f"o.{o0}")) & (F.col(f"p.{i1}") <= F.col(f"o.{o1}"))
    keep = [F.col(f"p.{c}") for c in inner.columns]
    keep += [F.col(f"o.{c}") for c in outer.columns if c not in on]
    return p.join(o.hint("merge"), cond, how).select(*keep)


def window_agg(
    anchors: DataFrame,
    events: DataFrame,
    on: list[str],
    t0: str,
    ts: str,
    before: str | None,
    after: str | None,
    aggs: list[Column],
    closed: tuple[bool, bool] = (True, True),
    width_s: int = DAY,
) -> DataFrame:
    """Aggregate the events in ``[t0 - before, t0 + after]`` for every anchor row.

    Anchors without events are kept. Offsets are interval texts such as ``'6 hours'``. An anchor
    is identified by ``on`` and ``t0``.
    """
    ident = [*on, t0]
    lo = F.expr(f"{t0} - interval {before}") if before else F.col(t0)
    hi = F.expr(f"{t0} + interval {after}") if after else F.col(t0)
    spans = anchors.select(*ident).distinct().withColumns({"__lo": lo, "__hi": hi})
    pairs = point_in_interval(
        events, spans, on, ts, "__lo", "__hi", closed=closed, how="inner", width_s=width_s
    )
    return anchors.join(pairs.groupBy(*ident).agg(*aggs), ident, "left")


def asof_latest(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    lts: str,
    rts: str,
    cols: Sequence[str],
    tolerance_s: int | None = None,
    tie: Sequence[Column] = (),
    strict: bool = False,
    direction: str = "backward",
    width_s: int = DAY,
) -> DataFrame:
    """Each left row with the nearest right row of its key not after (or not before) it.

    Both sides are stacked and scanned in time order, so there is no pair product: the state
    carried along is the latest right row. ``tie`` orders right rows of equal time (the last one
    wins); ``strict`` leaves out right rows at exactly the left time.
    """
    forward = direction == "forward"
    sign = -1 if forward else 1
    right_rank = 1 if strict else 0
    payload = F.struct(F.col(rts).alias("__rts"), *[F.col(c) for c in cols])
    lid = left.withColumn("__row", F.struct(*left.columns))
    lpart = lid.select(
        *on, (epoch_us(lts) * sign).alias("__t"), F.lit(1 - right_rank).alias("__side"), "__row"
    )
    ties = [f"__tie{i}" for i in range(len(tie))]
    rpart = right.filter(F.col(rts).isNotNull()).select(
        *on,
        (epoch_us(rts) * sign).alias("__t"),
        F.lit(right_rank).alias("__side"),
        *[c.alias(n) for c, n in zip(tie, ties)],
        payload.alias("__pay"),
    )
    both = lpart.unionByName(rpart, allowMissingColumns=True)
    bucket = F.floor(F.col("__t") / F.lit(width_s * 1_000_000)).cast("long")
    out = prefix_scan(both, on, ["__t", "__side", *ties], bucket, {"__hit": ("last", "__pay")})
    out = out.filter(F.col("__row").isNotNull())
    hit = F.col("__hit")
    if tolerance_s is not None:
        gap = F.col("__t") - epoch_us(F.col("__hit.__rts")) * sign
        hit = F.when(gap <= F.lit(tolerance_s * 1_000_000), F.col("__hit"))
    out = out.withColumn("__hit", hit)
    return out.select("__row.*", *[F.col(f"__hit.{c}").alias(c) for c in cols])


def range_self_agg(
    df: DataFrame, keys: list[str], ts: str, lo_s: int, hi_s: int, aggs: dict[str, Column]
) -> DataFrame:
    """Aggregates over rows of the same key whose time lies in ``[ts+lo, ts+hi]`` seconds."""
    from wardspan.functions.compat import epoch_s
    from wardspan.operators.scan import rolling_range

    return rolling_range(df, keys, epoch_s(ts), lo_s, hi_s, aggs)


def hour_bucket_attach(
    slots: DataFrame,
    events: DataFrame,
    on: list[str],
    slot: str,
    t0: str,
    ts: str,
    aggs: list[Column],
) -> DataFrame:
    """Attach events to hourly slots by arithmetic: slot ``k`` holds ``(t0+k-1h, t0+k]``.

    ``slots`` has one row per (on, slot); ``events`` carry ``t0`` of their key. Events are
    reduced to one row per slot before the join.
    """
    hours = F.ceil((epoch_us(ts) - epoch_us(t0)) / F.lit(3_600_000_000)).cast("long")
    per_slot = events.withColumn(slot, hours).groupBy(*on, slot).agg(*aggs)
    return slots.join(per_slot, [*on, slot], "left")


def latest_per_key(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The row with the greatest order per key, by a map-side combined ``max_by``."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*[col(o) for o in order])).alias("__best")
    return df.groupBy(*keys).agg(best).select(*keys, "__best.*").select(*df.columns)


def with_fallback(
    df: DataFrame,
    dim: DataFrame,
    on: str,
    fallback_key: str,
    cols: list[str],
    flag: str = "is_fallback",
) -> DataFrame:
    """Join a dimension; rows whose key has no entry take the fallback entry, flagged.

    The fallback entry is a single row, so it is broadcast.
    """
    own = dim.filter(F.col(on) != fallback_key).withColumn("__own", F.lit(True))
    # an aggregate is one row, whatever the dimension holds; of several fallback entries the greatest is used
    pooled = dim.filter(F.col(on) == fallback_key).agg(F.max(F.struct(*cols)).alias("__f"))
    pooled = pooled.select(F.lit(1).alias("__one"), *[F.col("__f")[c].alias(f"__f_{c}") for c in cols])
    out = df.join(own.select(on, "__own", *cols), on, "left").withColumn("__one", F.lit(1))
    out = out.join(F.broadcast(pooled), "__one", "left")
    out = out.withColumns({c: F.when(F.col("__own"), F.col(c)).otherwise(F.col(f"__f_{c}")) for c in cols})
    out = out.withColumn(flag, F.col("__own").isNull() & F.col(on).isNotNull())
    return out.drop("__own", "__one", *[f"__f_{c}" for c in cols])


def full_merge(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Full outer join with coalesced keys and, for shared columns, ``a`` preferred."""
    shared = [c for c in a.columns if c in b.columns and c not in on]
    left = a.alias("a")
    right = b.alias("b")
    cond = F.lit(True)
    for k in on:
        cond = cond & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    out = left.join(right, cond, "full")
    cols = [F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in on]
    cols += [F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in shared]
    cols += [F.col(f"a.{c}") for c in a.columns if c not in on and c not in shared]
    cols += [F.col(f"b.{c}") for c in b.columns if c not in on and c not in shared]
    return out.select(*cols)


def anti(child: DataFrame, parent: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``child`` whose key is missing in ``parent``; parent keys are deduplicated first."""
    return child.join(parent.select(*on).distinct(), on, "left_anti")


def semi(df: DataFrame, cohort: DataFrame, on: list[str]) -> DataFrame:
    return df.join(cohort.select(*on).distinct(), on, "left_semi")


def asof_either_payload(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    ts: str,
    exact: str,
    day: str,
    payload: str,
    before: tuple[int, int],
    after: tuple[int, int],
    names: tuple[str, str],
) -> DataFrame:
    """First match before and first match after each left row, on two granularities.

    A right row with a time matches by ``before[0]``/``after[0]`` hours, one with only a day by
    ``before[1]``/``after[1]`` days. "First" is the earliest day, a timed row before an untimed
    one, then the smallest ``payload.rank_id``. A left row asks four questions, each "the first
    right row from here on". All questions and both kinds of right rows are stacked once and
    scanned once, backwards in time; no candidate pairs are formed. ``day`` must be the day of
    ``exact``. The two results are structs of the payload.
    """
    r = right.select(*on, F.col(exact).alias("__e"), F.col(day).alias("__d"), F.col(payload).alias("__p"))
    # a struct of negated numbers cannot be relied on, so the smallest rank per time is kept first
    smallest = F.min_by("__p", F.col("__p.rank_id")).alias("__p")
    timed = r.filter(F.col("__e").isNotNull()).groupBy(*on, "__e").agg(smallest, F.min("__d").alias("__d"))
    dated = r.filter(F.col("__e").isNull() & F.col("__d").isNotNull()).groupBy(*on, "__d").agg(smallest)
    found = lambda e: F.struct("__d", e.alias("__e"), "__p")
    far = F.lit("9999-01-01").cast("timestamp_ntz")
    back = lambda t: -epoch_us(t)
    start = F.date_trunc("day", F.col(ts)).cast("timestamp_ntz")
    asked = {
        "t_before": (F.expr(f"{ts} - interval {before[0]} hours"), 2), "t_after": (F.col(ts), 0),
        "d_before": (start - F.expr(f"interval {before[1]} days"), 2), "d_after": (start, 2),
    }
    # seen backwards, a right row (side 1) comes before a question at its own time, except the strict one
    questions = F.array(*[F.struct(F.lit(k).alias("__q"), back(t).alias("__t"), F.lit(side).alias("__side")) for k, (t, side) in asked.items()])
    probes = left.withColumn("__row", F.struct(*left.columns)).select(*on, "__row", F.inline(questions))
    stack = probes.unionByName(timed.select(*on, back("__e").alias("__t"), F.lit(1).alias("__side"), found(F.col("__e")).alias("__timed")), True)
    stack = stack.unionByName(dated.select(*on, back("__d").alias("__t"), F.lit(1).alias("__side"), found(far).alias("__dated")), True)
    bucket = F.floor(F.col("__t") / F.lit(DAY * 1_000_000)).cast("long")
    seen = prefix_scan(stack, on, ["__t", "__side", "__q"], bucket, {"__ht": ("last", "__timed"), "__hd": ("last", "__dated")})
    answer = lambda q, hit: F.first(F.when(F.col("__q") == q, F.col(hit)), ignorenulls=True).alias(q)
    per = seen.filter(F.col("__q").isNotNull()).groupBy("__row").agg(
        F.count(F.when(F.col("__q") == "t_after", 1)).alias("__times"),
        *[answer(q, "__ht" if q.startswith("t") else "__hd") for q in asked],
    )
    out = per.withColumn("__again", F.explode(F.sequence(F.lit(1), F.col("__times").cast("int"))))
    out = out.select("__row.*", *asked)
    limits = {
        "t_before": F.col("t_before.__e") < F.col(ts),
        "t_after": F.col("t_after.__e") <= F.expr(f"{ts} + interval {after[0]} hours"),
        "d_before": F.col("d_before.__d") <= start,
        "d_after": F.col("d_after.__d") <= start + F.expr(f"interval {after[1]} days"),
    }
    for name, a, b in ((names[0], "t_before", "d_before"), (names[1], "t_after", "d_after")):
        x, y = F.when(limits[a], F.col(a)), F.when(limits[b], F.col(b))
        x_first = y.isNull() | (x["__d"] < y["__d"]) | ((x["__d"] == y["__d"]) & (x["__e"] <= y["__e"]))
        out = out.withColumn(name, F.when(x.isNotNull() & x_first, x["__p"]).otherwise(y["__p"]))
    return out.drop(*asked)


def asof_either(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    ts: str,
    exact: str,
    day: str,
    ident: str,
    before: tuple[int, int],
    after: tuple[int, int],
    names: tuple[str, str],
) -> DataFrame:
    """As ``asof_either_payload`` with the ids of the matches, ties by the smallest id."""
    r = right.withColumn("__pl", F.struct(F.col(ident).alias("rank_id")))
    out = asof_either_payload(left, r, on, ts, exact, day, "__pl", before, after, names)
    return out.withColumns({n: F.col(n)["rank_id"] for n in names})


def boundary_hour_sums(
    df: DataFrame,
    keys: list[str],
    ts: str,
    sums: dict[str, str],
    boundary: dict[str, int],
    exact_hours: dict[str, int],
) -> DataFrame:
    """Trailing sums including the row itself.

    ``boundary`` windows reach back by clock hours (at most ``n`` hour marks between the rows):
    the whole hours before plus the running sum inside the row's own hour. ``exact_hours``
    windows reach back by elapsed hours. Output columns are ``<sum>_<window>``.
    """
    from pyspark.sql import Window

    from wardspan.functions.compat import unit_index

    if not boundary and not exact_hours:
        return df
    # one cut into slices of whole hours for all windows: rows go to the slices that look back at them
    back = max([*boundary.values(), *exact_hours.values()])
    width = max(4 * back, 1)
    out = df.withColumn("__hr", unit_index("hour", ts))
    slices = F.sequence(F.floor(F.col("__hr") / F.lit(width)).cast("long"), F.floor((F.col("__hr") + back) / F.lit(width)).cast("long"))
    out = out.withColumn("__bucket", F.explode(slices))
    hours, times = (Window.partitionBy(*keys, "__bucket").orderBy(c) for c in (F.col("__hr"), epoch_us(ts)))
    exact = {f"{n}_{w}": F.sum(c).over(times.rangeBetween(-h * 3_600_000_000, 0)) for w, h in exact_hours.items() for n, c in sums.items()}
    hourly = {f"__b_{n}_{w}": F.sum(c).over(hours.rangeBetween(-h, -1)) for w, h in boundary.items() for n, c in sums.items()}
    own = Window.partitionBy(*keys, "__bucket", "__hr").orderBy(epoch_us(ts)).rangeBetween(Window.unboundedPreceding, 0)
    out = out.withColumns(exact).withColumns(hourly)
    out = out.filter(F.floor(F.col("__hr") / F.lit(width)).cast("long") == F.col("__bucket"))
    out = out.withColumns({f"__own_{n}": F.sum(c).over(own) for n, c in sums.items()})
    both = {
        f"{n}_{w}": F.when(
            F.col(f"__own_{n}").isNotNull() | F.col(f"__b_{n}_{w}").isNotNull(),
            F.coalesce(f"__own_{n}", F.lit(0)) + F.coalesce(f"__b_{n}_{w}", F.lit(0)),
        )
        for w in boundary
        for n in sums
    }
    out = out.withColumns(both)
    names = [f"{n}_{w}" for w in [*boundary, *exact_hours] for n in sums]
    return out.select(*df.columns, *names)
