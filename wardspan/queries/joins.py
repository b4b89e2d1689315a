"""Interval, as-of and windowed joins over events, orders and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardspan.functions.compat import date_diff_boundaries, epoch_s, unit_index
from wardspan.functions.scoring import tier
from wardspan.operators import joins as J
from wardspan.operators.scan import rolling_range
from wardspan.operators.windows import carried
from wardspan.queries.grid import CUT_SQL, cut_points, scored_grid
from wardspan.queries.registry import query


def of_type(t, kind, **names):
    e = t("events").filter(F.col("event_type") == kind)
    return e.select("user_id", *[F.col(c).alias(n) for n, c in names.items()])


@query(
    "first_window_agg",
    """with a as (select user_id, min(ts) t0 from events where event_type = 'purchase' group by 1)
    select a.user_id, a.t0, min(value) as v_min, max(value) as v_max, round(avg(value), 6) as v_mean,
           round(sum(value), 6) as v_sum, count(value) as n
    from a left join events e on a.user_id = e.user_id
      and e.ts >= a.t0 - interval 6 hour and e.ts <= a.t0 + interval 24 hour
    group by 1, 2""",
)
def _(t):
    a = of_type(t, "purchase", ts="ts").groupBy("user_id").agg(F.min("ts").alias("t0"))
    v = F.col("value")
    aggs = [F.min(v).alias("v_min"), F.max(v).alias("v_max"), F.round(F.avg(v), 6).alias("v_mean"),
            F.round(F.sum(v), 6).alias("v_sum"), F.count(v).alias("n")]
    ev = t("events").select("user_id", "ts", "value")
    out = J.window_agg(a, ev, ["user_id"], "t0", "ts", "6 hours", "24 hours", aggs)
    return out.withColumn("n", F.coalesce("n", F.lit(0)))


@query(
    "point_in_interval",
    """select p.event_id as point_id, i.event_id as interval_id
    from events p join events i on p.user_id = i.user_id and i.event_type = 'signup'
      and p.ts >= i.ts and p.ts < i.ts + to_microseconds(cast(round(i.value * 600) as bigint) * 1000000)
    where p.event_type = 'error'""",
)
def _(t):
    pts = of_type(t, "error", point_id="event_id", ts="ts")
    iv = of_type(t, "signup", interval_id="event_id", start="ts", value="value")
    span = F.make_dt_interval(secs=F.round(F.col("value") * 600, 0))
    iv = iv.withColumn("end", F.col("start") + span).drop("value")
    out = J.point_in_interval(pts, iv, ["user_id"], "ts", "start", "end", closed=(True, False))
    return out.select("point_id", "interval_id")


@query(
    "interval_within",
    """select p.event_id as inner_id, o.event_id as outer_id
    from events p left join events o on p.user_id = o.user_id and o.event_type = 'signup'
      and p.ts >= o.ts and p.ts + interval 30 minute <= o.ts + interval 8 hour
    where p.event_type = 'click'""",
)
def _(t):
    a = of_type(t, "click", inner_id="event_id", s="ts").withColumn("e", F.expr("s + interval 30 minutes"))
    b = of_type(t, "signup", outer_id="event_id", os="ts").withColumn("oe", F.expr("os + interval 8 hours"))
    out = J.interval_within(a, b, ["user_id"], ("s", "e"), ("os", "oe"))
    return out.select("inner_id", "outer_id")


@query(
    "interval_overlap_exists",
    """select a.event_id, exists (select 1 from events b where b.user_id = a.user_id
        and b.event_type = 'error' and a.ts < b.ts + interval 3 hour and a.ts + interval 1 hour > b.ts) as busy
    from events a where a.event_type = 'click'""",
)
def _(t):
    a = of_type(t, "click", event_id="event_id", s="ts").withColumn("e", F.expr("s + interval 1 hour"))
    b = of_type(t, "error", bs="ts").withColumn("be", F.expr("bs + interval 3 hours"))
    return J.overlap_flag(a, b, ["user_id"], ("s", "e"), ("bs", "be"), "busy").select("event_id", "busy")


@query(
    "asof_latest",
    """select l.event_id, arg_max(r.event_id, r.ts) as view_id, arg_max(r.value, r.ts) as view_value
    from events l left join events r on l.user_id = r.user_id and r.event_type = 'view'
      and r.ts <= l.ts and r.ts >= l.ts - interval 12 hour
    where l.event_type = 'purchase' group by 1""",
)
def _(t):
    left = of_type(t, "purchase", event_id="event_id", ts="ts")
    right = of_type(t, "view", rts="ts", view_id="event_id", view_value="value")
    out = J.asof_latest(left, right, ["user_id"], "ts", "rts", ["view_id", "view_value"], 12 * 3600)
    return out.select("event_id", "view_id", "view_value")


@query(
    "asof_bidirectional",
    """with l as (select * from events where event_type = 'purchase'),
    r as (select event_id, user_id, ts, value, case when event_id % 3 = 0 then null else ts end as exact_ts,
                 date_trunc('day', ts) as day from events where event_type = 'view'),
    prior as (select l.event_id, arg_min(r.event_id, (r.day, coalesce(r.exact_ts, timestamp '9999-01-01'), r.event_id)) as prior_id
      from l join r on l.user_id = r.user_id and (
        (r.exact_ts is not null and r.exact_ts < l.ts and r.exact_ts >= l.ts - interval 72 hour)
        or (r.exact_ts is null and r.day <= date_trunc('day', l.ts) and r.day >= date_trunc('day', l.ts) - interval 3 day))
      group by 1),
    later as (select l.event_id, arg_min(r.event_id, (r.day, coalesce(r.exact_ts, timestamp '9999-01-01'), r.event_id)) as later_id
      from l join r on l.user_id = r.user_id and (
        (r.exact_ts is not null and r.exact_ts > l.ts and r.exact_ts <= l.ts + interval 24 hour)
        or (r.exact_ts is null and r.day >= date_trunc('day', l.ts) and r.day <= date_trunc('day', l.ts) + interval 1 day))
      group by 1)
    select l.event_id, prior_id, later_id, coalesce(prior_id, later_id) as matched_id
    from l left join prior using (event_id) left join later using (event_id)""",
)
def _(t):
    left = of_type(t, "purchase", event_id="event_id", ts="ts")
    right = of_type(t, "view", rid="event_id", rts="ts")
    day = F.date_trunc("day", "rts").cast("timestamp_ntz")
    right = right.withColumn("rday", day)
    right = right.withColumn("exact", F.when(F.col("rid") % 3 != 0, F.col("rts")))
    out = J.asof_either(
        left, right, ["user_id"], "ts", "exact", "rday", "rid", before=(72, 3), after=(24, 1),
        names=("prior_id", "later_id"),
    )
    return out.select("event_id", "prior_id", "later_id", F.coalesce("prior_id", "later_id").alias("matched_id"))


@query(
    "prev_row_carry",
    """with b as (select event_id, user_id, ts, case when value < 5 then 0 when value < 60 then value end as v,
        case when event_type in ('view', 'click') then value end as m from events),
    p as (select *, case when lag(ts) over w > ts - interval 6 hour then lag(v) over w end as pv,
                    case when lag(ts) over w > ts - interval 6 hour then lag(m) over w end as pm
          from b window w as (partition by user_id order by ts))
    select event_id, round(case when v = 0 then 15 when v is null and pv = 0 then 15
       when pv = 0 then coalesce(m, 6) + coalesce(v, 5)
       else coalesce(m, pm, 6) + coalesce(v, pv, 5) end, 6) as score from p""",
)
def _(t):
    v = F.col("value")
    b = t("events").select(
        "event_id", "user_id", "ts",
        F.when(v < 5, 0.0).when(v < 60, v).alias("v"),
        F.when(F.col("event_type").isin("view", "click"), v).alias("m"),
    )
    b = carried(b, ["user_id"], "ts", ["v", "m"], 6 * 3600)
    vv, m, pv, pm = (F.col(c) for c in ("v", "m", "v_prev", "m_prev"))
    score = (
        F.when(vv == 0, 15.0)
        .when(vv.isNull() & (pv == 0), 15.0)
        .when(pv == 0, F.coalesce(m, F.lit(6.0)) + F.coalesce(vv, F.lit(5.0)))
        .otherwise(F.coalesce(m, pm, F.lit(6.0)) + F.coalesce(vv, pv, F.lit(5.0)))
    )
    return b.select("event_id", F.round(score, 6).alias("score"))


@query(
    "consecutive_pairs",
    """with s as (select *, row_number() over (partition by user_id order by ts) as seq
               from events where event_type = 'signup')
    select a.event_id, b.event_id as next_id, round(date_diff('minute', a.ts, b.ts) / 60.0, 6) as gap_h
    from s a join s b on a.user_id = b.user_id and b.seq = a.seq + 1
    where date_diff('minute', a.ts, b.ts) / 60.0 <= 72""",
)
def _(t):
    from wardspan.operators.scan import prefix_scan, time_bucket

    s = of_type(t, "signup", event_id="event_id", ts="ts")
    s = prefix_scan(s, ["user_id"], ["ts"], time_bucket("ts"), {"next_id": ("next", "event_id"), "nts": ("next", "ts")})
    gap = date_diff_boundaries("minute", "ts", "nts") / F.lit(60.0)
    return s.filter(gap <= 72).select("event_id", "next_id", F.round(gap, 6).alias("gap_h"))


@query(
    "range_self_min",
    """select a.event_id, min(case when b.ts >= a.ts - interval 48 hour then b.value end) as low_48h,
              min(b.value) as low_7d
    from events a left join events b on a.user_id = b.user_id and b.ts < a.ts and b.ts >= a.ts - interval 7 day
    group by 1""",
)
def _(t):
    from wardspan.functions.compat import epoch_us

    day = 86_400_000_000
    e = t("events").select("event_id", "user_id", "ts", "value")
    low = F.min("value")
    frames = {"low_48h": (low, -2 * day, -1), "low_7d": (low, -7 * day, -1)}
    e = rolling_range(e, ["user_id"], epoch_us("ts"), 0, 0, frames)
    return e.select("event_id", "low_48h", "low_7d")


@query(
    "trailing_boundary_sums",
    """select a.event_id,
        round(sum(case when date_diff('hour', b.ts, a.ts) <= 5 then b.value end), 6) as sum_6h,
        round(sum(case when date_diff('hour', b.ts, a.ts) <= 11 then b.value end), 6) as sum_12h,
        round(sum(b.value), 6) as sum_24h
    from events a join events b on a.user_id = b.user_id and a.ts >= b.ts and a.ts <= b.ts + interval 23 hour
    group by 1""",
)
def _(t):
    e = t("events").select("event_id", "user_id", "ts", "value")
    out = J.boundary_hour_sums(e, ["user_id"], "ts", {"sum": "value"}, {"6h": 5, "12h": 11}, {"24h": 23})
    return out.select("event_id", *[F.round(f"sum_{w}", 6).alias(f"sum_{w}") for w in ("6h", "12h", "24h")])


@query(
    "full_outer_merge",
    """with a as (select user_id, date_trunc('day', ts) as day, max(value) as v from events where event_type = 'view' group by 1, 2),
    b as (select user_id, date_trunc('day', ts) as day, max(value) as v, count(*) as n from events where event_type = 'click' group by 1, 2)
    select coalesce(a.user_id, b.user_id) as user_id, coalesce(a.day, b.day) as day, coalesce(a.v, b.v) as v, b.n
    from a full join b on a.user_id = b.user_id and a.day = b.day""",
)
def _(t):
    day = F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")
    e = t("events")
    a = e.filter("event_type = 'view'").groupBy("user_id", day).agg(F.max("value").alias("v"))
    b = e.filter("event_type = 'click'").groupBy("user_id", day).agg(
        F.max("value").alias("v"), F.count(F.lit(1)).alias("n")
    )
    return J.full_merge(a, b, ["user_id", "day"]).select("user_id", "day", "v", "n")


@query(
    "full_then_filter",
    """with a as (select user_id, date_trunc('hour', ts) as h, value, row_number() over (
                 partition by user_id, date_trunc('hour', ts) order by value desc, event_id) as rn
               from events where event_type = 'view'),
    b as (select user_id, date_trunc('hour', ts) as h, count(*) as clicks from events where event_type = 'click' group by 1, 2)
    select coalesce(a.user_id, b.user_id) as user_id, coalesce(a.h, b.h) as h, a.value, b.clicks
    from a full join b on a.user_id = b.user_id and a.h = b.h where a.rn = 1""",
)
def _(t):
    # a full join filtered on one side keeps only that side's rows: written as the left join it is
    h = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("h")
    e = t("events")
    top = F.max_by(F.col("value"), F.struct("value", -F.col("event_id"))).alias("value")
    a = e.filter("event_type = 'view'").groupBy("user_id", h).agg(top)
    b = e.filter("event_type = 'click'").groupBy("user_id", h).agg(F.count(F.lit(1)).alias("clicks"))
    return a.join(b, ["user_id", "h"], "left").select("user_id", "h", "value", "clicks")


@query(
    "hour_bucket_attach",
    """with f as (select user_id, min(ts) t0, max(ts) t1 from events group by 1),
    slots as (select user_id, t0, unnest(generate_series(0, cast(ceil((epoch_us(t1) - epoch_us(t0)) / 3600000000.0) as bigint))) as hr from f)
    select s.user_id, s.hr, min(e.value) as v_min, max(e.value) as v_max
    from slots s left join events e on e.user_id = s.user_id
      and e.ts > s.t0 + to_hours(s.hr - 1) and e.ts <= s.t0 + to_hours(s.hr)
    group by 1, 2""",
)
def _(t):
    from wardspan.functions.compat import epoch_us

    e = t("events").select("user_id", "ts", "value")
    f = e.groupBy("user_id").agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    n = F.ceil((epoch_us("t1") - epoch_us("t0")) / F.lit(3_600_000_000)).cast("long")
    slots = f.select("user_id", F.explode(F.sequence(F.lit(0).cast("long"), n)).alias("hr"))
    ev = e.join(f.select("user_id", "t0"), "user_id")
    aggs = [F.min("value").alias("v_min"), F.max("value").alias("v_max")]
    return J.hour_bucket_attach(slots, ev, ["user_id"], "hr", "t0", "ts", aggs)


FALLBACK_SQL = CUT_SQL + """,
grouped as (select *, case when user_id % 7 < 5 then 'g' || (user_id % 7) else 'rare' || user_id end as grp from scored),
gcuts as (
  select grp, cast(trunc(quantile_cont(score, 0.75)) as integer) as m0, cast(trunc(quantile_cont(score, 0.90)) as integer) as h0,
         count(distinct user_id) as n_users
  from grouped group by 1 having count(distinct user_id) >= 20
)"""


def grouped_scores(t):
    g = scored_grid(t).select("user_id", "hour", "score")
    k = F.col("user_id") % 7
    name = F.when(k < 5, F.concat(F.lit("g"), k.cast("string")))
    return g.withColumn("grp", name.otherwise(F.concat(F.lit("rare"), F.col("user_id").cast("string"))))


def group_cuts(g):
    per = cut_points(g, ["grp"], "score")
    n = g.groupBy("grp").agg(F.countDistinct("user_id").alias("n_users"))
    return per.join(n, "grp")


@query(
    "fallback_threshold_join",
    f"""with {FALLBACK_SQL}
    select g.user_id, g.hour, g.score, g.grp, coalesce(c.m0, p.medium) as medium,
      case when c.grp is not null then greatest(c.h0, c.m0 + 1) else greatest(p.high0, p.medium + 1) end as high,
      c.grp is null as is_fallback
    from grouped g left join gcuts c on g.grp = c.grp, cuts p""",
)
def _(t):
    g = grouped_scores(t)
    own = group_cuts(g).filter(F.col("n_users") >= 20).select("grp", "medium", "high")
    pooled = cut_points(g.withColumn("grp", F.lit("__pooled__")), ["grp"], "score")
    return J.with_fallback(g, own.unionByName(pooled), "grp", "__pooled__", ["medium", "high"])


@query(
    "group_cutpoints",
    f"""with {FALLBACK_SQL}
    select grp, m0 as medium, greatest(h0, m0 + 1) as high, n_users from gcuts""",
)
def _(t):
    return group_cuts(grouped_scores(t)).filter(F.col("n_users") >= 20)


@query(
    "moved_tiers",
    f"""with {FALLBACK_SQL}, both_t as (
      select case when score >= greatest(p.high0, p.medium + 1) then 'high' when score >= p.medium then 'medium' else 'low' end as pooled,
        case when score >= coalesce(greatest(c.h0, c.m0 + 1), greatest(p.high0, p.medium + 1)) then 'high'
             when score >= coalesce(c.m0, p.medium) then 'medium' else 'low' end as own
      from grouped g left join gcuts c on g.grp = c.grp, cuts p)
    select pooled, own, count(*) as n from both_t group by 1, 2""",
)
def _(t):
    g = grouped_scores(t)
    own = group_cuts(g).filter(F.col("n_users") >= 20).select("grp", "medium", "high")
    pooled = cut_points(g.withColumn("grp", F.lit("__pooled__")), ["grp"], "score")
    out = J.with_fallback(g, own.unionByName(pooled), "grp", "__pooled__", ["medium", "high"])
    p = pooled.select(F.lit(1).alias("__k"), F.col("medium").alias("pm"), F.col("high").alias("ph"))
    out = out.withColumn("__k", F.lit(1)).join(F.broadcast(p), "__k")
    return out.groupBy(
        tier("score", F.col("pm"), F.col("ph")).alias("pooled"),
        tier("score", F.col("medium"), F.col("high")).alias("own"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "semi_cohort",
    """select o_orderkey, o_custkey, o_totalprice from orders
    where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')""",
)
def _(t):
    cohort = t("customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return J.semi(t("orders"), cohort, ["o_custkey"]).select("o_orderkey", "o_custkey", "o_totalprice")


@query(
    "latest_per_key",
    "select user_id, event_id, ts, event_type, value from events qualify row_number() over (partition by user_id order by ts desc) = 1",
)
def _(t):
    e = t("events").select("user_id", "event_id", "ts", "event_type", "value")
    return J.latest_per_key(e, ["user_id"], ["ts"])


@query(
    "series_unnest",
    """with f as (select user_id, min(ts) t0, max(ts) t1 from events group by 1),
    e as (select user_id, case when date_trunc('hour', t0) = t0 then t0 else date_trunc('hour', t0) + interval 1 hour end as base,
          unnest(generate_series(-24, date_diff('hour', t0, t1))) as hr from f)
    select user_id, hr, base + to_hours(hr) as endtime from e""",
)
def _(t):
    from wardspan.plans.series import hourly_slots

    f = t("events").groupBy("user_id").agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    return hourly_slots(f, "user_id", "t0", "t1", -24).select("user_id", "hr", "endtime")


@query(
    "ever_flags",
    """select c.c_custkey, coalesce(max(case when o_orderpriority = '1-URGENT' then 1 end), 0) as ever_urgent,
         coalesce(max(case when o_totalprice > 400000 then 1 end), 0) as ever_large
    from customer c left join orders o on o.o_custkey = c.c_custkey group by 1""",
)
def _(t):
    o = t("orders")
    urgent = o.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    large = o.filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")).distinct()
    out = t("customer").select("c_custkey")
    for name, flag in (("ever_urgent", urgent), ("ever_large", large)):
        out = out.join(flag.withColumn(name, F.lit(1)), "c_custkey", "left")
    return out.fillna(0, ["ever_urgent", "ever_large"])


@query(
    "star_join",
    """select r_name, n_name, count(*) as orders, round(sum(o_totalprice), 4) as total
    from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
      join region on n_regionkey = r_regionkey group by 1, 2""",
)
def _(t):
    # reduce the fact table to one row per customer before touching the dimensions
    per = t("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("s"))
    out = per.join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    out = out.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    out = out.join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return out.groupBy("r_name", "n_name").agg(
        F.sum("n").alias("orders"), F.round(F.sum("s"), 4).alias("total")
    )


@query(
    "left_chain",
    """with f as (select user_id, event_type, min(value) as lo, max(value) as hi from events group by 1, 2),
    u as (select distinct user_id from events)
    select u.user_id, a.lo as view_min, a.hi as view_max, b.lo as error_min, b.hi as error_max
    from u left join f a on u.user_id = a.user_id and a.event_type = 'view'
           left join f b on u.user_id = b.user_id and b.event_type = 'error'""",
)
def _(t):
    # a chain of left joins over per-key aggregates collapses to one conditional aggregate
    e = t("events")
    aggs = []
    for k in ("view", "error"):
        v = F.when(F.col("event_type") == k, F.col("value"))
        aggs += [F.min(v).alias(f"{k}_min"), F.max(v).alias(f"{k}_max")]
    return e.groupBy("user_id").agg(*aggs)


@query(
    "grid_label_join",
    """with g as (select user_id, date_trunc('hour', ts) as h, sum(value) as s from events group by 1, 2),
    l as (select user_id, date_trunc('hour', ts) as h, max(case when event_type = 'error' then 1 else 0 end) as y
          from events where value > 20 group by 1, 2)
    select user_id, h, round(s, 6) as s, y from g join l using (user_id, h)""",
)
def _(t):
    h = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("h")
    e = t("events")
    g = e.groupBy("user_id", h).agg(F.round(F.sum("value"), 6).alias("s"))
    y = F.max((F.col("event_type") == "error").cast("int")).alias("y")
    return g.join(e.filter("value > 20").groupBy("user_id", h).agg(y), ["user_id", "h"])
