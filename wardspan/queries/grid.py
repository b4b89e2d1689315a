"""Hourly grid, forward fill and tiering over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardspan.functions.scoring import score_bands, tier, total
from wardspan.operators.pivot import hourly_grid
from wardspan.operators.scan import exact_percentiles
from wardspan.operators.windows import ffill_flagged, trailing_drop
from wardspan.queries.registry import Tables, query

TYPES = ["view", "signup", "error", "click", "purchase"]
# (upper bound inclusive, points); the last catches the rest
BANDS = [(10.0, 0), (40.0, 1), (90.0, 2), (None, 3)]


def user_grid(t: Tables):
    ev = t("events")
    first = ev.groupBy("user_id").agg(F.min("ts").alias("t0"))
    return hourly_grid(ev, first, "user_id", "ts", "t0", "event_type", "value", {c: c for c in TYPES})


def filled_grid(t: Tables):
    return ffill_flagged(user_grid(t), ["user_id"], "hour", TYPES)


def scored_grid(t: Tables):
    g = filled_grid(t)
    parts = {f"{c}_pts": score_bands(c, BANDS) for c in TYPES}
    g = g.withColumns(parts)
    return g.withColumns(
        {
            "score": total(*parts).cast("int"),
            "max_component": F.greatest(*[F.coalesce(F.col(p), F.lit(0)) for p in parts]),
        }
    )


GRID_SQL = """
first_seen as (select user_id, min(ts) t0 from events group by 1),
grid as (
  select e.user_id, cast(floor((epoch_us(ts) - epoch_us(t0)) / 3600000000.0) as bigint) as hour,
    %s
  from events e join first_seen f on e.user_id = f.user_id
  group by 1, 2 having count(value) > 0
)""" % ", ".join(f"avg(value) filter (event_type = '{c}') as {c}" for c in TYPES)

FILL_SQL = GRID_SQL + """,
filled as (
  select user_id, hour, %s from grid
  window w as (partition by user_id order by hour rows between unbounded preceding and current row)
)""" % ", ".join(
    f"last_value({c} ignore nulls) over w as {c}, "
    f"({c} is null and last_value({c} ignore nulls) over w is not null) as {c}_was_imputed, "
    f"hour - last_value(case when {c} is not null then hour end ignore nulls) over w as {c}_hours_since_last_obs"
    for c in TYPES
)


def points_sql(c: str) -> str:
    return f"(case when {c} is null then null when {c} <= 10 then 0 when {c} <= 40 then 1 when {c} <= 90 then 2 else 3 end)"


SCORE_SQL = FILL_SQL + """,
scored as (
  select *, cast(%s as integer) as score, cast(%s as integer) as max_component from filled
)""" % (
    " + ".join(f"coalesce({points_sql(c)}, 0)" for c in TYPES),
    "greatest(" + ", ".join(f"coalesce({points_sql(c)}, 0)" for c in TYPES) + ")",
)


def r6(*cols):
    return [F.round(F.col(c), 6).alias(c) for c in cols]


def r6sql(*cols):
    return ", ".join(f"round({c}, 6) as {c}" for c in cols)


@query("hourly_grid", f"with {GRID_SQL} select user_id, hour, {r6sql(*TYPES)} from grid")
def _(t):
    return user_grid(t).select("user_id", "hour", *r6(*TYPES))


_FLAGS = [f"{c}_{s}" for c in TYPES for s in ("was_imputed", "hours_since_last_obs")]


@query(
    "grid_ffill",
    f"with {FILL_SQL} select user_id, hour, {r6sql(*TYPES)}, {', '.join(_FLAGS)} from filled",
)
def _(t):
    return filled_grid(t).select("user_id", "hour", *r6(*TYPES), *_FLAGS)


CUT_SQL = SCORE_SQL + """,
cuts as (
  select cast(trunc(quantile_cont(score, 0.75)) as integer) as medium,
         cast(trunc(quantile_cont(score, 0.90)) as integer) as high0 from scored
), tiered as (
  select s.*, case when score >= greatest(high0, medium + 1) then 'high'
                   when score >= medium then 'medium' else 'low' end as tier
  from scored s, cuts
)"""


def cut_points(df, keys, score):
    """75th and 90th percentile, truncated, the upper one at least one above the lower."""
    p = exact_percentiles(df, keys, score, {"p75": 0.75, "p90": 0.90})
    medium = F.floor("p75").cast("int")
    high = F.greatest(F.floor("p90").cast("int"), medium + 1)
    return p.select(*keys, medium.alias("medium"), high.alias("high"))


def tiered_grid(t: Tables):
    g = scored_grid(t).withColumn("__g", F.lit(1))
    cuts = cut_points(g, ["__g"], "score")
    g = g.join(F.broadcast(cuts), "__g").drop("__g")
    return g.withColumn("tier", tier("score", F.col("medium"), F.col("high")))


@query(
    "grid_score_tiers",
    f"with {CUT_SQL} select user_id, hour, score, max_component, tier from tiered",
)
def _(t):
    return tiered_grid(t).select("user_id", "hour", "score", "max_component", "tier")


@query(
    "tier_shares",
    f"""with {CUT_SQL}, per_user as (
      select user_id, max(case tier when 'high' then 2 when 'medium' then 1 else 0 end) r
      from tiered group by 1),
    names(tier, r) as (values ('low', 0), ('medium', 1), ('high', 2))
    select n.tier,
      round(100.0 * (select count(*) from tiered t where t.tier = n.tier) / (select count(*) from tiered), 6) as pct_hours,
      (select count(*) from per_user p where p.r >= n.r) as users_ever_at_least
    from names n""",
)
def _(t):
    g = tiered_grid(t)
    rank = F.when(F.col("tier") == "high", 2).when(F.col("tier") == "medium", 1).otherwise(0)
    per = g.groupBy("user_id").agg(
        F.max(rank).alias("top"),
        *[F.count(F.when(rank == i, 1)).alias(f"n{i}") for i in range(3)],
        F.count(F.lit(1)).alias("n"),
    )
    agg = per.agg(
        *[(F.sum(f"n{i}") * 100.0 / F.sum("n")).alias(f"p{i}") for i in range(3)],
        *[F.count(F.when(F.col("top") >= i, 1)).alias(f"e{i}") for i in range(3)],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(n).alias("tier"),
                F.round(F.col(f"p{i}"), 6).alias("pct_hours"),
                F.col(f"e{i}").alias("users_ever_at_least"),
            )
            for i, n in enumerate(("low", "medium", "high"))
        ]
    )
    return agg.select(F.inline(rows))


@query(
    "trailing_drop_flag",
    f"""with {FILL_SQL}, d as (
      select user_id, hour, click, max(click) over (partition by user_id order by hour rows between 4 preceding and 1 preceding) as best,
             error > 60 as busy
      from filled)
    select user_id, hour, round(click, 6) as click,
      coalesce(best - click >= 20 and not coalesce(busy, false), false) as dropped from d""",
)
def _(t):
    g = filled_grid(t)
    busy = F.coalesce(F.col("error") > 60, F.lit(False))
    out = trailing_drop(g, ["user_id"], "hour", "click", 4, 20, busy, "dropped")
    return out.select("user_id", "hour", F.round("click", 6).alias("click"), "dropped")
