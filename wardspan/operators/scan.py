"""Ordered computations over groups of any size.

A plain ``Window.partitionBy(key)`` puts a whole group in one task. Here a group is first cut
into buckets by a monotone function of its order (a time slice, a block of row numbers, a slice
of values), so that one hot key spreads over as many tasks as it has buckets:

* the running state inside each bucket comes from a window over ``(keys, bucket)``;
* each bucket is also folded to one summary row (map-side combined), and the state before or
  after each bucket comes from a window over those few rows;
* both are joined on ``(keys, bucket)``.

A NULL key is a group like any other, and rows without an order value form the first bucket, as
Spark sorts them: keys and bucket travel as one struct, whose comparison treats NULLs as equal.
The order must be total within a key. Rows and summaries come from one shuffle on ``(keys, bucket)``,
which Spark reuses, so the input is made once and a scan may go into another. Rows with a map cannot be
hashed; their scan makes its input twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardspan.functions.compat import col, epoch_us

DAY = 86400
BUCKET = "__bucket"
GROUP = "__group"
#: No hash of a row is below it.
_LEAST = -(1 << 31)


def time_bucket(ts: Column | str, width_s: int = DAY) -> Column:
    return F.floor(epoch_us(ts) / F.lit(width_s * 1_000_000)).cast("long")


SLICE = "__slice"


def value_slices(df: DataFrame, keys: list[str], value: str, rows: int = 65_536, most: int = 1_024, of: DataFrame | None = None) -> DataFrame:
    """``df`` with ``__slice``, the number of a slice of the value axis, rising with the value.

    The edges are percentiles of a sketch per key (combined on the map side), so slices hold about ``rows`` rows each,
    whatever the distribution, and there are at most ``most`` per key; a group of fewer rows is one slice. Rows of one value
    are in one slice: combine them first. NULL is in the first slice, NaN in the last, as Spark sorts them. ``of`` has the same
    keys and values, and its rows are counted instead.
    """
    v = F.col(value).cast("double")
    key = F.struct(F.lit(0).alias("__0"), *[F.col(k) for k in keys])
    cuts = [i / most for i in range(1, most)]
    edges = (df if of is None else of).groupBy(key.alias("__key")).agg(F.percentile_approx(v, cuts).alias("e"), F.count(F.lit(1)).alias("n"))
    step = F.greatest(F.lit(1), F.floor(F.lit(most * rows) / F.col("n")).cast("int"))
    edges = edges.select("__key", step.alias("__step"), "e").select(
        "__key", F.coalesce(F.array_distinct(F.filter("e", lambda x, i: (i + 1) % F.col("__step") == 0)), F.array().cast("array<double>")).alias("__edges"))
    # how many edges lie below the value, by halving: only as many steps as the group's edges need
    powers = F.array(*[F.lit(1 << i) for i in range(most.bit_length() - 1, -1, -1)])
    edges = edges.withColumn("__steps", F.filter(powers, lambda k: k <= F.size("__edges")))
    below = F.aggregate("__steps", F.lit(0), lambda at, k: F.when(F.coalesce(F.get("__edges", at + k - 1) < v, F.lit(False)), at + k).otherwise(at))
    found = F.when(F.size("__edges") > 0, below).otherwise(F.lit(0)).alias(SLICE)
    return df.withColumn("__key", key).join(edges, "__key").select(*df.columns, found)


def _order(order: list[Column | str]) -> list[Column]:
    return [col(o) for o in order]


def prefix_scan(
    df: DataFrame,
    keys: list[str],
    order: list[Column | str],
    bucket: Column,
    specs: dict[str, tuple[str, Column | str]],
) -> DataFrame:
    """Add one running column per spec ``name -> (kind, expression)``.

    Kinds, all within ``keys`` and in ``order``:
    ``sum``, ``max``, ``min``, ``last`` (latest non-NULL) up to and including the row;
    ``prev`` / ``next`` the expression on the neighbouring row; ``next_seen`` the earliest
    non-NULL strictly after the row; ``total`` over the whole group.
    """
    ordered = _order(order)
    shared = not any(x in t for _, t in df.dtypes for x in ("map<", "variant"))
    # a number of the whole row: either side of the scan asks for it, so that neither drops a column before the shuffle
    whole = F.hash(*[F.col(f"`{c}`") for c in df.columns]) if shared else None
    df = df.withColumn(GROUP, F.struct(*[F.col(k) for k in keys], bucket.alias(BUCKET)))
    if shared:
        df = df.repartition(F.col(GROUP))
    w = Window.partitionBy(GROUP).orderBy(*ordered)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    # frames that begin at the end are evaluated anew for every row, so what lies ahead is read backwards
    after = Window.partitionBy(GROUP).orderBy(*[o.desc_nulls_last() for o in ordered]).rowsBetween(Window.unboundedPreceding, -1)
    pos = F.struct(*ordered)

    inside: dict[str, Column] = {}
    partial: list[Column] = []
    carry: dict[str, Column] = {}
    kw = Window.partitionBy(*[F.col(GROUP)[k] for k in keys]) if keys else Window.partitionBy(F.lit(0))
    at = F.col(GROUP)[BUCKET]
    before = kw.orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    behind = kw.orderBy(at.desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)

    for name, (kind, expr) in specs.items():
        e = col(expr)
        i, p, c = f"__i_{name}", f"__p_{name}", f"__c_{name}"
        if kind == "sum":
            inside[i] = F.sum(e).over(upto)
            partial.append(F.sum(e).alias(p))
            carry[c] = F.sum(p).over(before)
        elif kind == "total":
            partial.append(F.sum(e).alias(p))
            carry[c] = F.sum(p).over(kw)
        elif kind in ("max", "min"):
            f = getattr(F, kind)
            inside[i] = f(e).over(upto)
            partial.append(f(e).alias(p))
            carry[c] = f(p).over(before)
        elif kind == "last":
            inside[i] = F.last(e, ignorenulls=True).over(upto)
            partial.append(F.max_by(e, F.when(e.isNotNull(), pos)).alias(p))
            carry[c] = F.last(p, ignorenulls=True).over(before)
        elif kind == "prev":
            boxed = F.struct(e.alias("v"))
            inside[i] = F.lag(boxed).over(w)
            partial.append(F.max_by(boxed, pos).alias(p))
            carry[c] = F.last(p, ignorenulls=True).over(before)
        elif kind == "next":
            boxed = F.struct(e.alias("v"))
            inside[i] = F.lead(boxed).over(w)
            partial.append(F.min_by(boxed, pos).alias(p))
            carry[c] = F.last(p, ignorenulls=True).over(behind)
        elif kind == "next_seen":
            inside[i] = F.last(e, ignorenulls=True).over(after)
            partial.append(F.min_by(e, F.when(e.isNotNull(), pos)).alias(p))
            carry[c] = F.last(p, ignorenulls=True).over(behind)
        else:
            raise ValueError(f"unknown scan kind {kind!r}")

    rows = df.withColumns(inside) if inside else df
    if shared:
        rows = rows.filter(whole >= _LEAST)
        summary = df.groupBy(GROUP).agg(*partial, F.min(whole).alias("__whole")).filter(F.col("__whole") >= _LEAST)
    else:
        summary = df.groupBy(GROUP).agg(*partial)
    summary = summary.withColumns(carry).select(GROUP, *carry)
    out = rows.join(summary, GROUP, "left")

    final: dict[str, Column] = {}
    for name, (kind, _) in specs.items():
        i, c = F.col(f"__i_{name}"), F.col(f"__c_{name}")
        if kind == "sum":
            final[name] = F.when(
                i.isNotNull() | c.isNotNull(), F.coalesce(i, F.lit(0)) + F.coalesce(c, F.lit(0))
            )
        elif kind == "total":
            final[name] = c
        elif kind == "max":
            final[name] = F.greatest(i, c)
        elif kind == "min":
            final[name] = F.least(i, c)
        elif kind in ("prev", "next"):
            final[name] = F.coalesce(i, c)["v"]
        else:
            final[name] = F.coalesce(i, c)
    drop = [GROUP, *inside, *carry]
    return out.withColumns(final).drop(*drop)


def row_numbers(
    df: DataFrame, keys: list[str], order: list[Column | str], bucket: Column, name: str = "rn"
) -> DataFrame:
    """``row_number()`` within ``keys`` that never holds a whole group in one task."""
    out = prefix_scan(df, keys, order, bucket, {name: ("sum", F.lit(1))})
    return out.withColumn(name, F.col(name).cast("long"))


Frames = dict[str, "Column | tuple[Column, int, int]"]


def _framed(aggs: Frames, lo: int, hi: int) -> dict[str, tuple[Column, int, int]]:
    return {n: a if isinstance(a, tuple) else (a, lo, hi) for n, a in aggs.items()}


def rolling_range(
    df: DataFrame,
    keys: list[str],
    at: Column,
    lo: int,
    hi: int,
    aggs: Frames,
    slice_width: int | None = None,
) -> DataFrame:
    """Aggregates over rows whose integer position lies in ``[at+lo, at+hi]``.

    The axis ``at`` is cut into slices; rows within reach of a neighbouring slice are copied to
    it, so every frame is complete inside its slice. Peers of the current row are in the frame.
    An aggregate given as ``(expression, lo, hi)`` has a frame of its own; all share one shuffle.
    """
    framed = _framed(aggs, lo, hi)
    reach_back = max([-f[1] for f in framed.values()] + [0])
    reach_on = max([f[2] for f in framed.values()] + [0])
    width = slice_width or max(4 * max(reach_back, reach_on), 1)
    d = df.withColumn("__at", at)
    first = F.floor((F.col("__at") - reach_on) / F.lit(width)).cast("long")
    final = F.floor((F.col("__at") + reach_back) / F.lit(width)).cast("long")
    d = d.withColumn(BUCKET, F.explode(F.sequence(first, final)))
    own = F.floor(F.col("__at") / F.lit(width)).cast("long") == F.col(BUCKET)
    w = Window.partitionBy(*keys, BUCKET).orderBy("__at")
    d = d.withColumns({n: c.over(w.rangeBetween(a, b)) for n, (c, a, b) in framed.items()})
    return d.filter(own).drop(BUCKET, "__at")


def rolling_rows(
    df: DataFrame,
    keys: list[str],
    order: list[Column | str],
    bucket: Column,
    lo: int,
    hi: int,
    aggs: Frames,
    block: int | None = None,
) -> DataFrame:
    """Aggregates over the rows ``lo..hi`` around each row (offsets, both at most 0).

    Rows are numbered by a bucketed scan and cut into blocks of equal row count; the last rows
    of a block that later frames reach are copied to the next one. An aggregate given as
    ``(expression, lo, hi)`` has a frame of its own; all share one numbering and one shuffle.
    """
    framed = _framed(aggs, lo, hi)
    if any(a > b or b > 0 for _, a, b in framed.values()):
        raise ValueError("offsets must satisfy lo <= hi <= 0")
    back = max(-a for _, a, _ in framed.values())
    size = block or max(8 * back, 8192)
    d = row_numbers(df, keys, order, bucket, "__rn")
    here = F.floor((F.col("__rn") - 1) / F.lit(size)).cast("long")
    later = F.floor((F.col("__rn") - 1 + back) / F.lit(size)).cast("long")
    d = d.withColumn("__own", here).withColumn(BUCKET, F.explode(F.sequence(here, later)))
    w = Window.partitionBy(*keys, BUCKET).orderBy("__rn")
    d = d.withColumns({n: c.over(w.rowsBetween(a, b)) for n, (c, a, b) in framed.items()})
    return d.filter(F.col("__own") == F.col(BUCKET)).drop(BUCKET, "__own", "__rn")


def weighted_ranks(
    df: DataFrame, keys: list[str], value: str, sums: dict[str, Column]
) -> DataFrame:
    """One row per distinct value with totals and running totals in ascending value order.

    For each name in ``sums`` the result has ``<name>`` (at this value), ``<name>_upto``
    (inclusive) and ``<name>_all`` (whole group). Rows of equal value are combined before the
    shuffle; the ordered pass runs over slices of the value axis.
    """
    g = df.filter(F.col(value).isNotNull()).groupBy(*keys, value)
    g = g.agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    specs = {f"{n}_upto": ("sum", n) for n in sums} | {f"{n}_all": ("total", n) for n in sums}
    return prefix_scan(value_slices(g, keys, value), keys, [value], F.col(SLICE), specs).drop(SLICE)


def exact_percentiles(
    df: DataFrame, keys: list[str], value: str, probs: dict[str, float], weight: Column | None = None
) -> DataFrame:
    """Linear-interpolated percentiles per group, exact, without a per-group value buffer."""
    n = F.lit(1) if weight is None else weight
    r = weighted_ranks(df, keys, value, {"n": n})
    below = F.col("n_upto") - F.col("n")
    pieces = []
    for name, p in probs.items():
        pos = F.lit(p) * (F.col("n_all") - 1)
        lo, hi = F.floor(pos), F.ceil(pos)
        covers = lambda k: (below <= k) & (k < F.col("n_upto"))
        pieces += [
            F.max(F.when(covers(lo), F.col(value))).alias(f"__lo_{name}"),
            F.max(F.when(covers(hi), F.col(value))).alias(f"__hi_{name}"),
            F.max(pos - lo).alias(f"__f_{name}"),
        ]
    agg = r.groupBy(*keys).agg(*pieces)
    outs = [
        (
            F.col(f"__lo_{name}")
            + (F.col(f"__hi_{name}") - F.col(f"__lo_{name}")) * F.col(f"__f_{name}")
        ).alias(name)
        for name in probs
    ]
    return agg.select(*keys, *outs)
