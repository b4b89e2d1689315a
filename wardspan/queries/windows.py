"""Window, episode and interval queries over events and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardspan.functions.compat import epoch_s, epoch_us
from wardspan.operators import intervals as I
from wardspan.operators import pivot as P
from wardspan.operators import windows as W
from wardspan.operators.scan import prefix_scan, rolling_range, rolling_rows, row_numbers, time_bucket
from wardspan.queries.grid import FILL_SQL, SCORE_SQL, filled_grid, scored_grid
from wardspan.queries.registry import query


def ev(t, *cols):
    return t("events").select(*(cols or ("event_id", "user_id", "ts", "event_type", "value")))


@query(
    "row_number_first",
    """select user_id, event_type, event_id, ts from events
    qualify row_number() over (partition by user_id, event_type order by ts, event_id) = 1""",
)
def _(t):
    first = F.min_by(F.struct("event_id", "ts"), F.struct("ts", "event_id")).alias("s")
    return ev(t).groupBy("user_id", "event_type").agg(first).select("user_id", "event_type", "s.*")


@query(
    "dense_seq",
    """select o_orderkey, dense_rank() over (partition by o_custkey order by o_orderdate) as seq,
        dense_rank() over (partition by o_custkey order by o_orderdate) = 1 as is_first from orders""",
)
def _(t):
    from wardspan.operators.windows import dense_ranks

    o = t("orders").select("o_orderkey", "o_custkey", "o_orderdate")
    out = dense_ranks(o, ["o_custkey"], "o_orderdate", time_bucket("o_orderdate", 365 * 86400), "seq")
    return out.select("o_orderkey", "seq", (F.col("seq") == 1).alias("is_first"))


@query(
    "lag_lead",
    """select event_id, lag(value) over w as prev_value, lead(ts) over w as next_ts,
        lag(ts) over (partition by user_id, event_type order by ts) as prev_same_type
    from events window w as (partition by user_id order by ts)""",
)
def _(t):
    e = prefix_scan(ev(t), ["user_id"], ["ts"], time_bucket("ts"), {"prev_value": ("prev", "value"), "next_ts": ("next", "ts")})
    e = prefix_scan(e, ["user_id", "event_type"], ["ts"], time_bucket("ts"), {"prev_same_type": ("prev", "ts")})
    return e.select("event_id", "prev_value", "next_ts", "prev_same_type")


ISLAND_SQL = """with s as (select user_id, ts, event_type as status, lag(event_type) over w as ps, lead(ts) over w as nt,
      lag(ts) over (partition by user_id, event_type order by ts) as pt
    from events window w as (partition by user_id order by ts)),
  f as (select *, case when ps is null or ps <> status or date_diff('hour', pt, ts) >= 14 then 1 else 0 end as fresh from s),
  q as (select *, sum(fresh) over (partition by user_id order by ts) as seq from f)
  select user_id, min(ts) as starttime,
    max(case when nt is null or date_diff('hour', ts, nt) >= 14 then ts else nt end) as endtime, max(status) as status
  from q group by user_id, seq having min(ts) <> max(ts)"""


@query("islands", ISLAND_SQL)
def _(t):
    e = ev(t, "user_id", "ts", F.col("event_type").alias("status"))
    return I.islands(e, ["user_id"], "ts", "status", 14, "hour")


def _ranges(spec, body):
    return ", ".join(
        f"{body} over (partition by user_id order by epoch(ts)::bigint range between {s} preceding and current row) as {n}"
        for n, s in spec.items()
    )


@query(
    "range_sum_6_12_24h",
    """with e as (select *, cast(floor(epoch_us(ts) / 1000000) as bigint) as sec from events)
    select event_id, """
    + ", ".join(
        f"round(sum(value) over (partition by user_id order by sec range between {h * 3600} preceding and current row), 6) as s{h}"
        for h in (6, 12, 24)
    )
    + " from e",
)
def _(t):
    e = ev(t, "event_id", "user_id", "ts", "value")
    frames = {f"s{h}": (F.sum("value"), -h * 3600, 0) for h in (6, 12, 24)}
    e = rolling_range(e, ["user_id"], epoch_s("ts"), 0, 0, frames)
    return e.select("event_id", *[F.round(f"s{h}", 6).alias(f"s{h}") for h in (6, 12, 24)])


@query(
    "range_max_smooth",
    """with e as (select *, cast(floor(epoch_us(ts) / 1000000) as bigint) as sec from events)
    select event_id, max(value) over (partition by user_id order by sec range between 21600 preceding and current row) as smoothed from e""",
)
def _(t):
    e = ev(t, "event_id", "user_id", "ts", "value")
    e = rolling_range(e, ["user_id"], epoch_s("ts"), -21600, 0, {"smoothed": F.max("value")})
    return e.select("event_id", "smoothed")


@query(
    "rows_rolling_max",
    f"""with {SCORE_SQL} select user_id, hour, max(score) over w as max_24, max(max_component) over w as comp_24
    from scored window w as (partition by user_id order by hour rows between 23 preceding and current row)""",
)
def _(t):
    g = scored_grid(t).select("user_id", "hour", "score", "max_component")
    out = rolling_rows(
        g, ["user_id"], ["hour"], W.hour_bucket("hour"), -23, 0,
        {"max_24": F.max("score"), "comp_24": F.max("max_component")},
    )
    return out.select("user_id", "hour", "max_24", "comp_24")


def _roll_sql(c, w):
    win = f"(partition by user_id order by hour rows between {w - 1} preceding and current row)"
    return (
        f"round(avg({c}) over {win}, 6) as {c}_{w}h_mean, round(stddev_pop({c}) over {win}, 6) as {c}_{w}h_std, "
        f"round(case when count({c}) over {win} < count(*) over {win} then null when count(*) over {win} < 2 then 0.0 "
        f"else regr_slope({c}, hour) over {win} end, 6) as {c}_{w}h_slope"
    )


@query(
    "rolling_mean_std_slope",
    f"with {FILL_SQL} select user_id, hour, "
    + ", ".join(_roll_sql(c, w) for c in ("view", "error") for w in (4, 24))
    + " from filled",
)
def _(t):
    g = filled_grid(t).select("user_id", "hour", "view", "error")
    out = W.rolling_stats(g, ["user_id"], "hour", ["view", "error"], [4, 24])
    names = [f"{c}_{w}h_{s}" for c in ("view", "error") for w in (4, 24) for s in ("mean", "std", "slope")]
    return out.select("user_id", "hour", *[F.round(n, 6).alias(n) for n in names])


@query(
    "prior_counts",
    """select a.o_orderkey, count(b.o_orderkey) as n_prior_365d
    from orders a left join orders b on a.o_custkey = b.o_custkey and b.o_orderdate < a.o_orderdate
      and b.o_orderdate >= a.o_orderdate - interval 365 day
    group by 1""",
)
def _(t):
    o = t("orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return W.prior_counts(o, ["o_custkey"], "o_orderdate", 365, "n_prior_365d").select("o_orderkey", "n_prior_365d")


@query(
    "trailing_event_counts",
    f"""with {FILL_SQL}, first_e as (select user_id, min(ts) t0 from events group by 1),
    o as (select e.user_id, (epoch_us(ts) - epoch_us(t0)) as us from events e join first_e f on e.user_id = f.user_id where event_type = 'click')
    select g.user_id, g.hour, count(o.us) filter (o.us > (g.hour - 4) * 3600000000) as n_4h, count(o.us) as n_24h
    from grid g left join o on o.user_id = g.user_id and o.us <= g.hour * 3600000000 and o.us > (g.hour - 24) * 3600000000
    group by 1, 2""",
)
def _(t):
    g = filled_grid(t).select("user_id", "hour")
    e = ev(t)
    first = e.groupBy("user_id").agg(F.min("ts").alias("t0"))
    o = e.filter("event_type = 'click'").join(first, "user_id")
    o = o.select("user_id", ((epoch_us("ts") - epoch_us("t0")) / F.lit(3.6e9)).alias("at"))
    return W.trailing_event_counts(g, o, ["user_id"], "hour", "at", [4, 24], "n_")


@query(
    "interval_tiling",
    """with w as (select user_id, ts, value, min(ts) over (partition by user_id) - interval 6 hour as intime,
                max(ts) over (partition by user_id) as outtime from events where event_type = 'view'),
    w1 as (select user_id, ts as starttime, coalesce(lead(ts) over (partition by user_id order by ts), outtime + interval 2 hour) as endtime,
                value, intime from w),
    first_w as (select * from w1 qualify row_number() over (partition by user_id order by starttime) = 1)
    select user_id, starttime, endtime, value from w1
    union all select user_id, intime - interval 2 hour, starttime, value from first_w where intime < starttime""",
)
def _(t):
    e = ev(t, "user_id", "ts", "event_type", "value").filter("event_type = 'view'")
    span = e.groupBy("user_id").agg(F.min("ts").alias("lo"), F.max("ts").alias("outtime"))
    span = span.withColumn("intime", F.expr("lo - interval 6 hours"))
    return I.tile_with_backfill(
        e.select("user_id", F.col("ts").alias("starttime"), "value"), span, ["user_id"],
        "starttime", "endtime", "intime", "outtime", "2 hours", ["value"],
    )


SEG_SQL = """with iv as (select user_id, event_type, ts as s, ts + interval 5 hour as e, value from events),
  m as (select user_id, event_type, s, lead(s) over (partition by user_id, event_type order by s) as nx, e, value from iv),
  src as (select user_id, event_type, s, case when nx is not null and nx < e then nx else e end as e, value from m),
  cuts as (select user_id, s as mark from src where event_type in ('view', 'click', 'error') union select user_id, e from src where event_type in ('view', 'click', 'error')),
  seg as (select user_id, mark as starttime, lead(mark) over (partition by user_id order by mark) as endtime from cuts)
  select t.user_id, t.starttime, t.endtime, v.value as view, c.value as click, r.value as error
  from seg t left join src v on v.event_type = 'view' and t.user_id = v.user_id and t.starttime >= v.s and t.endtime <= v.e
    left join src c on c.event_type = 'click' and t.user_id = c.user_id and t.starttime >= c.s and t.endtime <= c.e
    left join src r on r.event_type = 'error' and t.user_id = r.user_id and t.starttime >= r.s and t.endtime <= r.e
  where t.endtime is not null"""


@query("elementary_segments", SEG_SQL)
def _(t):
    e = ev(t, "user_id", "event_type", F.col("ts").alias("starttime"), "value")
    e = prefix_scan(e, ["user_id", "event_type"], ["starttime"], time_bucket("starttime"), {"nx": ("next", "starttime")})
    end = F.expr("starttime + interval 5 hours")
    e = e.withColumn("endtime", F.when(F.col("nx") < end, F.col("nx")).otherwise(end))
    return I.segments(
        e, ["user_id"], "starttime", "endtime", "value", "event_type", ["view", "click", "error"]
    )


@query(
    "path_string",
    """with m as (select user_id, ts, event_type, lag(event_type) over (partition by user_id order by ts) as p from events)
    select user_id, string_agg(event_type, ' -> ' order by ts) as path from m where p is null or p <> event_type group by 1""",
)
def _(t):
    return W.path_string(ev(t, "user_id", "ts", "event_type"), ["user_id"], "ts", "event_type")


@query(
    "interpolate_cadence",
    """with p as (select user_id, epoch_us(lag(ts) over w) as a, lag(value) over w as va, epoch_us(ts) as b, value as vb,
                 row_number() over w as rn
               from events where event_type = 'view' window w as (partition by user_id order by ts)),
    k as (select *, unnest(generate_series(
            case when rn = 2 then cast(ceil(a / 1800000000.0) as bigint) else cast(floor(a / 1800000000.0) as bigint) + 1 end,
            cast(floor(b / 1800000000.0) as bigint))) as i
          from p where a is not null and b - a <= 6 * 3600000000)
    select user_id, make_timestamp(i * 1800000000) as at, round(va + (vb - va) * ((i * 1800000000 - a) / (b - a)), 6) as value from k""",
)
def _(t):
    e = ev(t, "user_id", "ts", "event_type", "value").filter("event_type = 'view'")
    out = W.interpolate(e, ["user_id"], "ts", "value", 1800, 6 * 3600)
    return out.select("user_id", "at", F.round("value", 6).alias("value"))


@query(
    "last_bucket",
    """with b as (select *, time_bucket(interval 4 hour, ts) as bk from events),
    m as (select user_id, max(bk) as bk from b group by 1)
    select user_id, bk as bucket_start, arg_min(value, ts) as first_value, arg_max(value, ts) as last_value, count(*) as n
    from b join m using (user_id, bk) group by 1, 2""",
)
def _(t):
    return W.last_bucket(ev(t), ["user_id"], "ts", 4, "value")


@query(
    "padded_sequences",
    f"""with {FILL_SQL}, s as (select user_id, hour, list([coalesce(view, 0.0), coalesce(click, 0.0)]) over (
        partition by user_id order by hour rows between 5 preceding and current row) as q from filled)
    select user_id, hour, len(q) as n_real,
       round(list_sum(list_transform(q, lambda x: x[1])), 6) as sum_view, round(q[1][1], 6) as first_real_view,
       list_concat(list_transform(generate_series(1, 6 - len(q)), lambda i: 0.0), list_transform(q, lambda x: round(x[2], 6))) as clicks
    from s""",
)
def _(t):
    g = filled_grid(t).select("user_id", "hour", "view", "click")
    out = W.pad_sequences(g, ["user_id"], "hour", ["view", "click"], 6, W.hour_bucket("hour"))
    r = row_numbers(out, ["user_id"], ["hour"], W.hour_bucket("hour"), "rn")
    n = F.least(F.col("rn"), F.lit(6)).cast("long")
    views = F.transform("seq", lambda x: x[0])
    return r.select(
        "user_id", "hour", n.alias("n_real"),
        F.round(F.aggregate(views, F.lit(0.0), lambda a, x: a + x), 6).alias("sum_view"),
        F.round(F.element_at(views, (F.lit(7) - n).cast("int")), 6).alias("first_real_view"),
        F.transform("seq", lambda x: F.round(x[1], 6)).alias("clicks"),
    )


@query(
    "rmssd",
    """with d as (select user_id, value - lag(value) over (partition by user_id order by ts) as d from events)
    select user_id, round(coalesce(sqrt(avg(d * d)), 0.0), 6) as rmssd from d group by 1""",
)
def _(t):
    return W.rmssd(ev(t), ["user_id"], "ts", "value").select("user_id", F.round("rmssd", 6).alias("rmssd"))


@query(
    "sequence_features",
    """with s as (select o_orderkey, o_custkey, o_orderdate, o_orderdate + to_days(cast(o_orderkey % 20 as integer)) as done from orders),
    n as (select *, row_number() over w - 1 as n_prior, lead(o_orderdate) over w as nx, lag(done) over w as pv
          from s window w as (partition by o_custkey order by o_orderdate, o_orderkey))
    select o_orderkey, n_prior, round((epoch_us(nx) - epoch_us(done)) / 86400000000.0, 6) as days_to_next,
      round((epoch_us(o_orderdate) - epoch_us(pv)) / 86400000000.0, 6) as days_since_prev from n""",
)
def _(t):
    o = t("orders").select("o_orderkey", "o_custkey", "o_orderdate")
    o = o.withColumn("done", F.expr("o_orderdate + make_dt_interval(int(o_orderkey % 20))"))
    out = W.sequence_features(o, ["o_custkey"], "o_orderdate", "done", tie=["o_orderkey"])
    return out.select(
        "o_orderkey", "n_prior", F.round("days_to_next", 6).alias("days_to_next"),
        F.round("days_since_prev", 6).alias("days_since_prev"),
    )


# --- pivots -------------------------------------------------------------------

@query(
    "pivot_items",
    """select user_id, date_trunc('day', ts) as day, max(case when event_type = 'view' and value <= 200 then value end) as view_max,
      round(avg(case when event_type in ('click', 'error') and value > 1 and value < 150 then value end), 6) as busy_avg,
      round(sum(case when event_type = 'purchase' then value / 1000.0 end), 6) as spend_k,
      max(case when event_type = 'signup' then props end) as last_props
    from events where event_type in ('view', 'click', 'error', 'purchase', 'signup') group by 1, 2""",
)
def _(t):
    e = t("events").withColumn("day", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    spec = {
        "view_max": P.item("view", hi=200, hi_closed=True),
        "busy_avg": P.item("click", "error", agg="avg", lo=1, hi=150),
        "spend_k": P.item("purchase", agg="sum", scale=1000.0),
        "last_props": P.item("signup", text=True),
    }
    out = P.pivot_items(e, ["user_id", "day"], spec, "event_type", "value", "props")
    return out.withColumns({"busy_avg": F.round("busy_avg", 6), "spend_k": F.round("spend_k", 6)})


@query(
    "pivot_caps",
    """select l_orderkey, max(case when l_returnflag = 'A' and l_quantity <= 40 then l_quantity end) as a_qty,
      max(case when l_returnflag = 'R' and l_extendedprice <= 50000 then l_extendedprice end) as r_price,
      round(avg(case when l_returnflag = 'N' then l_discount end), 6) as n_disc
    from lineitem where l_returnflag in ('A', 'R', 'N') group by 1""",
)
def _(t):
    flag = F.col("l_returnflag")
    li = t("lineitem").filter(flag.isin("A", "N", "R"))
    return li.groupBy("l_orderkey").agg(
        F.max(F.when((flag == "A") & (F.col("l_quantity") <= 40), F.col("l_quantity"))).alias("a_qty"),
        F.max(F.when((flag == "R") & (F.col("l_extendedprice") <= 50000), F.col("l_extendedprice"))).alias("r_price"),
        F.round(F.avg(F.when(flag == "N", F.col("l_discount"))), 6).alias("n_disc"),
    )


@query(
    "rank_pivot",
    """with r as (select user_id, event_id, row_number() over (partition by user_id order by value desc, event_id) as rn from events)
    select user_id, """
    + ", ".join(f"max(case when rn = {i} then event_id end) as top_{i}" for i in range(1, 5))
    + " from r group by 1",
)
def _(t):
    return P.rank_pivot(ev(t), ["user_id"], [F.col("value").desc(), F.col("event_id")], "event_id", 4, "top_")


@query(
    "unpivot_long",
    """select l_orderkey, l_linenumber, l_partkey, name, value from (
       select l_orderkey, l_linenumber, l_partkey, l_quantity as quantity, l_discount as discount,
              case when l_tax > 0.04 then l_tax end as tax from lineitem)
       unpivot (value for name in (quantity, discount, tax))""",
)
def _(t):
    li = t("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("quantity"),
        F.col("l_discount").alias("discount"), F.when(F.col("l_tax") > 0.04, F.col("l_tax")).alias("tax"),
    )
    return P.unpivot_long(li, ["l_orderkey", "l_linenumber", "l_partkey"], ["quantity", "discount", "tax"])


@query(
    "tagged_union_pivot",
    """select user_id, max(case when event_type = 'error' then value end) as error,
        max(case when event_type = 'purchase' then value end) as purchase
      from events where event_type in ('error', 'purchase') and value > 30 group by 1""",
)
def _(t):
    e = ev(t).filter("value > 30")
    src = {k: e.filter(F.col("event_type") == k) for k in ("error", "purchase")}
    return P.tagged_pivot(src, ["user_id"], "value")


@query(
    "results_pivot",
    """select o_orderpriority, round(avg(case when o_orderstatus = 'F' then o_totalprice end), 4) as "F",
      round(avg(case when o_orderstatus = 'O' then o_totalprice end), 4) as "O",
      round(avg(case when o_orderstatus = 'P' then o_totalprice end), 4) as "P" from orders group by 1""",
)
def _(t):
    out = P.results_pivot(t("orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"], "o_totalprice")
    return out.select("o_orderpriority", *[F.round(c, 4).alias(c) for c in ("F", "O", "P")])
