"""Aggregates, distributions and event-rate statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardspan.evaluation import analytics as A
from wardspan.functions.compat import epoch_us
from wardspan.operators import sampling as S
from wardspan.operators.scan import exact_percentiles
from wardspan.queries.grid import FILL_SQL, GRID_SQL, SCORE_SQL, filled_grid, scored_grid, user_grid
from wardspan.queries.registry import query

TYPES = ["view", "signup", "error", "click", "purchase"]


def r(c, n=6, name=None):
    return F.round(F.col(c), n).alias(name or c)


def hours_in(t):
    """Events with hours since the user's first event, and each user's span in hours."""
    e = t("events")
    f = e.groupBy("user_id").agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    f = f.withColumn("span_h", (epoch_us("t1") - epoch_us("t0")) / F.lit(3.6e9))
    ev = e.join(f.select("user_id", "t0"), "user_id")
    return ev.withColumn("h", (epoch_us("ts") - epoch_us("t0")) / F.lit(3.6e9)), f


HOURS_SQL = """f as (select user_id, min(ts) t0, (epoch_us(max(ts)) - epoch_us(min(ts))) / 3600000000.0 as span_h from events group by 1),
 ev as (select e.*, (epoch_us(ts) - epoch_us(t0)) / 3600000000.0 as h from events e join f using (user_id))"""


@query(
    "group_aggregates",
    """select l_returnflag, l_linestatus, min(l_quantity) as min_q, max(l_quantity) as max_q, round(avg(l_extendedprice), 4) as avg_p,
      round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as n from lineitem group by 1, 2""",
)
def _(t):
    return t("lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.min("l_quantity").alias("min_q"), F.max("l_quantity").alias("max_q"),
        F.round(F.avg("l_extendedprice"), 4).alias("avg_p"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
        F.count(F.lit(1)).alias("n"),
    )


@query(
    "count_distinct",
    """select event_type, count(distinct user_id) as users, count(distinct date_trunc('day', ts)) as days from events group by 1""",
)
def _(t):
    e = t("events").select("event_type", "user_id", F.date_trunc("day", "ts").alias("d"))
    return e.groupBy("event_type").agg(F.countDistinct("user_id").alias("users"), F.countDistinct("d").alias("days"))


@query("distinct_rows", "select distinct p_brand, p_type from part")
def _(t):
    return t("part").select("p_brand", "p_type").distinct()


@query(
    "sum_distinct",
    "select l_orderkey, sum(distinct l_quantity) as uo from lineitem group by 1",
)
def _(t):
    return t("lineitem").groupBy("l_orderkey").agg(F.sum_distinct("l_quantity").alias("uo"))


@query(
    "listagg_distinct",
    """select user_id, date_trunc('day', ts) as day, string_agg(distinct event_type, '; ' order by event_type) as kinds from events group by 1, 2""",
)
def _(t):
    day = F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")
    kinds = F.array_join(F.sort_array(F.collect_set("event_type")), "; ")
    return t("events").groupBy("user_id", day).agg(kinds.alias("kinds"))


@query(
    "having_filter",
    "select l_orderkey, count(*) as n, max(l_shipdate) as last_ship from lineitem group by 1 having count(*) > 6 and min(l_shipdate) <> max(l_shipdate)",
)
def _(t):
    g = t("lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n"), F.max("l_shipdate").alias("last_ship"), F.min("l_shipdate").alias("lo")
    )
    return g.filter("n > 6 and lo <> last_ship").drop("lo")


@query(
    "mode_per_group",
    """select user_id, event_type, n from (select user_id, event_type, count(*) as n from events group by 1, 2)
    qualify row_number() over (partition by user_id order by n desc, event_type) = 1""",
)
def _(t):
    return S.mode_per_group(t("events"), ["user_id"], "event_type")


@query(
    "any_value_flags",
    "select user_id, min(event_type) as some_type, max(cast(value > 100 as integer)) as ever_large from events group by 1",
)
def _(t):
    return t("events").groupBy("user_id").agg(
        F.min("event_type").alias("some_type"), F.max((F.col("value") > 100).cast("int")).alias("ever_large")
    )


@query(
    "percentile_cutpoints",
    """select event_type, round(quantile_cont(value, 0.75), 6) as p75, round(quantile_cont(value, 0.9), 6) as p90 from events group by 1""",
)
def _(t):
    p = exact_percentiles(t("events"), ["event_type"], "value", {"p75": 0.75, "p90": 0.9})
    return p.select("event_type", r("p75"), r("p90"))


@query(
    "describe_values",
    """select l_returnflag, count(l_extendedprice) as n, round(avg(l_extendedprice), 4) as mean, round(stddev_samp(l_extendedprice), 4) as std,
      min(l_extendedprice) as min, max(l_extendedprice) as max, round(quantile_cont(l_extendedprice, 0.25), 4) as p25,
      round(quantile_cont(l_extendedprice, 0.5), 4) as p50, round(quantile_cont(l_extendedprice, 0.99), 4) as p99
    from lineitem group by 1""",
)
def _(t):
    d = A.describe(t("lineitem"), ["l_returnflag"], "l_extendedprice", {"p25": 0.25, "p50": 0.5, "p99": 0.99})
    return d.select("l_returnflag", "n", r("mean", 4), r("std", 4), "min", "max", r("p25", 4), r("p50", 4), r("p99", 4))


@query(
    "first_event_per_user",
    """with u as (select user_id, ts, 'big' as kind from events where value > 150 union all
      select user_id, ts, 'error' from events where event_type = 'error' union all
      select user_id, ts, 'buy' from events where event_type = 'purchase' and value > 60)
    select user_id, min(ts) as event_time, arg_min(kind, (ts, kind)) as event_type from u group by 1""",
)
def _(t):
    from wardspan.plans.labels import first_event

    e = t("events")
    src = {
        "big": e.filter("value > 150"),
        "error": e.filter("event_type = 'error'"),
        "buy": e.filter("event_type = 'purchase' and value > 60"),
    }
    return first_event({k: d.select("user_id", F.col("ts").alias("event_time")) for k, d in src.items()}, "user_id")


@query(
    "last_row_per_group",
    f"""with {SCORE_SQL} select user_id, max(hour) as hour, arg_max(score, hour) as last_score, max(score) as max_score from scored group by 1""",
)
def _(t):
    g = scored_grid(t)
    return g.groupBy("user_id").agg(
        F.max("hour").alias("hour"), F.max_by("score", "hour").alias("last_score"), F.max("score").alias("max_score")
    )


def daily(t):
    day = F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")
    e = t("events")
    return e.groupBy("user_id", day).agg(
        *[F.avg(F.when(F.col("event_type") == k, F.col("value"))).alias(k) for k in TYPES]
    )


DAILY_SQL = "daily as (select user_id, date_trunc('day', ts) as day, " + ", ".join(
    f"avg(value) filter (event_type = '{k}') as {k}" for k in TYPES
) + " from events group by 1, 2)"


@query(
    "corr_matrix",
    f"with {DAILY_SQL} "
    + " union all ".join(
        f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 6) as r from daily"
        for i, a in enumerate(TYPES) for b in TYPES[i + 1 :]
    ),
)
def _(t):
    return A.corr_matrix(daily(t), TYPES).select("a", "b", r("r"))


@query(
    "ols_fit",
    f"""with {HOURS_SQL} select user_id, round(regr_slope(value, h), 6) as slope, round(regr_intercept(value, h), 6) as intercept,
      round(regr_r2(value, h), 6) as r2, count(*) as n from ev group by 1""",
)
def _(t):
    ev, _ = hours_in(t)
    fit = A.line_fit(ev, ["user_id"], F.col("value"), F.col("h"))
    return fit.select("user_id", r("slope"), r("intercept"), r("r2"), "n")


@query(
    "loglog_fit",
    """with g as (select l_quantity as q, avg(l_extendedprice) as p from lineitem group by 1)
    select round(regr_slope(ln(p), ln(q)), 6) as slope, round(regr_intercept(ln(p), ln(q)), 6) as intercept,
      round(regr_r2(ln(p), ln(q)), 6) as r2, count(*) as n from g""",
)
def _(t):
    g = t("lineitem").groupBy("l_quantity").agg(F.avg("l_extendedprice").alias("p"))
    return A.line_fit(g, [], F.ln("p"), F.ln("l_quantity")).select(r("slope"), r("intercept"), r("r2"), "n")


@query(
    "hist_fixed_bins",
    f"""with {HOURS_SQL}, n as (select cast(floor(h) as bigint) as bin, count(*) as c from ev group by 1)
    select b.bin, coalesce(c, 0) as n from (select unnest(generate_series(0, 167)) as bin) b left join n using (bin)""",
)
def _(t):
    ev, _ = hours_in(t)
    return A.fixed_histogram(ev, F.col("h"), 0, 168)


@query(
    "stay_progress_hist",
    f"""with {HOURS_SQL}, n as (select event_type, cast(floor(100 * h / span_h / 2) as bigint) as bin, count(*) as c
       from ev join f using (user_id) where span_h >= 24 group by 1, 2)
    select k.event_type, b.bin, coalesce(c, 0) as n from (select unnest(generate_series(0, 49)) as bin) b
      cross join (select distinct event_type from events) k left join n on n.bin = b.bin and n.event_type = k.event_type""",
)
def _(t):
    ev, f = hours_in(t)
    j = ev.join(f.select("user_id", "span_h"), "user_id").filter("span_h >= 24")
    return A.fixed_histogram(j, F.lit(100) * F.col("h") / F.col("span_h") / 2, 0, 50, ["event_type"])


RISK_SQL = HOURS_SQL + """, axis as (select unnest(generate_series(0, 167)) as hour),
 risk as (select hour, (select count(*) from f where span_h > hour) as at_risk from axis),
 raw as (select k.event_type, r.hour, r.at_risk, (select count(*) from ev where ev.event_type = k.event_type and ev.h >= r.hour and ev.h < r.hour + 1)
     / greatest(r.at_risk, 1) as raw from risk r cross join (select distinct event_type from events) k),
 rates as (select event_type, hour, at_risk, case when at_risk >= 145 then raw
     else avg(raw) filter (at_risk >= 145) over (partition by event_type) end as rate from raw),
 smooth as (select *, sum(rate) over (partition by event_type order by hour rows between 1 preceding and 1 following) / 3 as smoothed from rates)"""


def rates_of(t):
    ev, f = hours_in(t)
    return A.at_risk_rates(ev, f, "event_type", "h", "span_h", 168, min_at_risk=145)


@query(
    "at_risk_rate",
    f"with {RISK_SQL} select event_type, hour, at_risk, round(rate, 6) as rate, round(smoothed, 6) as smoothed from smooth",
)
def _(t):
    return rates_of(t).select("event_type", "hour", "at_risk", r("rate"), r("smoothed"))


@query(
    "burst_ratio",
    f"""with {RISK_SQL}, s as (select event_type, avg(rate) filter (hour >= 24 and at_risk >= 145) as late, avg(rate) as overall,
        avg(rate) filter (hour < 24) as early from rates group by 1)
    select event_type, round(coalesce(late, overall), 6) as stationary_rate, round(early / late, 6) as burst_ratio from s""",
)
def _(t):
    s = A.stationary_rates(rates_of(t), "event_type", min_at_risk=145)
    return s.select("event_type", r("stationary_rate"), r("burst_ratio"))


@query(
    "peak_total_rate",
    f"with {RISK_SQL}, h as (select hour, sum(smoothed) as s from smooth group by 1) select round(max(s), 6) as peak_rate, round(max(s) * 1000 / 3600, 6) as per_sec_1000 from h",
)
def _(t):
    p = A.peak_total_rate(rates_of(t))
    return p.select(r("peak_rate"), F.round(F.col("peak_rate") * 1000 / 3600, 6).alias("per_sec_1000"))


@query(
    "moving_average",
    """with d as (select event_type, date_trunc('day', ts) as day, count(*) as n from events group by 1, 2)
    select event_type, day, round(sum(n) over (partition by event_type order by day rows between 1 preceding and 1 following) / 3.0, 6) as ma from d""",
)
def _(t):
    from pyspark.sql import Window

    day = F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")
    d = t("events").groupBy("event_type", day).agg(F.count(F.lit(1)).alias("n"))
    # one row per (type, day) is left, so the window is over days only
    w = Window.partitionBy("event_type").orderBy("day").rowsBetween(-1, 1)
    return d.select("event_type", "day", F.round(F.sum("n").over(w) / 3.0, 6).alias("ma"))


@query(
    "diurnal_profile",
    """with n as (select event_type, extract(hour from ts) as hour, count(*) as n from events group by 1, 2),
    tot as (select event_type, count(*) as total from events group by 1)
    select t.event_type, cast(x.hour as integer) as hour, coalesce(n.n, 0) as n, round(coalesce(n.n, 0) / total * 24, 6) as multiplier
    from tot t cross join (select unnest(generate_series(0, 23)) as hour) x left join n on n.event_type = t.event_type and n.hour = x.hour""",
)
def _(t):
    return A.diurnal_profile(t("events"), ["event_type"], "ts").select("event_type", "hour", "n", r("multiplier"))


@query(
    "slot_share",
    """with n as (select event_type, cast(extract(hour from ts) as integer) as h, count(*) as n from events group by 1, 2)
    select event_type, round(sum(case when h % 4 = 0 then n else 0 end) / sum(n), 6) as slot_share,
      arg_min(h, (-n, h)) as peak_hour from n group by 1""",
)
def _(t):
    return A.slot_share(t("events"), ["event_type"], "ts").select("event_type", r("slot_share"), "peak_hour")


@query(
    "icc",
    """with g as (select event_type, user_id, count(*) as n, avg(value) as m from events group by 1, 2),
    grand as (select event_type, avg(value) as gm from events group by 1),
    b as (select event_type, sum(n * (m - gm) * (m - gm)) / sum(n) as between_var from g join grand using (event_type) group by 1),
    w as (select e.event_type, avg((e.value - g.m) * (e.value - g.m)) as within_var from events e join g on e.event_type = g.event_type and e.user_id = g.user_id group by 1)
    select event_type, round(between_var, 4) as between_var, round(within_var, 4) as within_var,
      round(between_var / (between_var + within_var), 6) as icc from b join w using (event_type)""",
)
def _(t):
    out = A.icc(t("events"), "user_id", "value", ["event_type"])
    return out.select("event_type", r("between_var", 4), r("within_var", 4), r("icc"))


@query(
    "autocorr_lags",
    f"""with {GRID_SQL}, v as (select user_id, hour, coalesce(view, click, error, signup, purchase) as a from grid),
    ok as (select user_id from v group by 1 having count(*) >= 24),
    p as (select x.user_id, l.lag, x.a, y.a as b from v x join ok using (user_id), (select unnest(generate_series(0, 36)) as lag) l, v y
          where y.user_id = x.user_id and y.hour = x.hour + l.lag),
    c as (select user_id, lag, corr(a, b) as r from p group by 1, 2 having count(*) > 3 and stddev_samp(a) > 0 and stddev_samp(b) > 0)
    select lag, round(avg(r), 6) as acf, count(*) as n_entities from c group by 1""",
)
def _(t):
    g = user_grid(t).withColumn("v", F.coalesce("view", "click", "error", "signup", "purchase"))
    out = A.autocorr(g, "user_id", "hour", "v", 36, 24, min_pairs=3)
    return out.select(F.col("lag").cast("long").alias("lag"), r("acf"), "n_entities")


@query(
    "event_aligned_profile",
    f"""with {HOURS_SQL}, first_err as (select user_id, min(h) as he from ev where event_type = 'purchase' and value > 100 group by 1),
    j as (select ev.user_id, value, cast(round_even(he - floor(h), 0) as bigint) as hours_before from ev join first_err using (user_id)),
    m as (select hours_before, avg(value) as mean, count(distinct user_id) as support from j where hours_before between 0 and 24 group by 1)
    select hours_before, round(mean, 6) as mean, support, round(mean - (select mean from m where hours_before = 24), 6) as deviation from m""",
)
def _(t):
    ev, _ = hours_in(t)
    e = ev.filter("event_type = 'purchase' and value > 100").groupBy("user_id").agg(F.min("h").alias("he"))
    d = ev.withColumn("hour", F.floor("h"))
    out = A.event_aligned(d, e, "user_id", "hour", "he", "value", 24)
    return out.select("hours_before", r("mean"), "support", r("deviation"))


@query(
    "prevalence_bins",
    f"""with {SCORE_SQL}, y as (select hour, (score >= 8) as y from scored)
    select cast(hour // 24 as bigint) as band, count(*) as n_rows, cast(sum(cast(y as integer)) as bigint) as positives,
      round(avg(cast(y as double)), 6) as prevalence from y group by 1""",
)
def _(t):
    g = scored_grid(t).withColumn("y", F.col("score") >= 8)
    out = A.prevalence_by(g, F.floor(F.col("hour") / 24).cast("long"), "y")
    return out.select("band", "n_rows", "positives", r("prevalence"))


_FL = [f"{c}_was_imputed" for c in TYPES]


@query(
    "missing_ratio",
    f"with {SCORE_SQL.replace('scored as (', 'scored as materialized (')} "
    + " union all ".join(
        f"select '{f}' as flag, round(avg({f}::int) filter (score >= 8), 6) as if_positive, round(avg({f}::int) filter (score < 8), 6) as if_negative, "
        f"round(avg({f}::int) filter (score >= 8) / avg({f}::int) filter (score < 8), 6) as ratio from scored"
        for f in _FL
    ),
)
def _(t):
    g = scored_grid(t).withColumn("y", (F.col("score") >= 8).cast("int"))
    return A.missing_ratio(g, "y", _FL).select("flag", r("if_positive"), r("if_negative"), r("ratio"))


@query(
    "fresh_rate_by_hour",
    f"""with {FILL_SQL} select hour % 24 as hour_of_day, round(1 - avg(view_was_imputed::int), 6) as view_fresh,
      round(1 - avg(error_was_imputed::int), 6) as error_fresh from filled group by 1""",
)
def _(t):
    return filled_grid(t).groupBy((F.col("hour") % 24).alias("hour_of_day")).agg(
        *[F.round(1 - F.avg(F.col(f"{c}_was_imputed").cast("double")), 6).alias(f"{c}_fresh") for c in ("view", "error")]
    )


@query(
    "gap_stats",
    """with g as (select event_type, user_id, (epoch_us(ts) - epoch_us(lag(ts) over (partition by event_type, user_id order by ts))) / 60000000.0 as gap from events),
    m as (select event_type, user_id, median(gap) as m from g where gap is not null group by 1, 2),
    s as (select event_type, avg((gap between 600 and 1800)::int) as share_hourly, count(*) as n_gaps from g where gap is not null group by 1)
    select event_type, round(median(m), 6) as median_gap, round(any_value(share_hourly), 6) as share_hourly, any_value(n_gaps) as n_gaps from m join s using (event_type) group by 1""",
)
def _(t):
    out = A.gap_stats(t("events"), "user_id", "ts", ["event_type"], 600, 1800)
    return out.select("event_type", r("median_gap"), r("share_hourly"), "n_gaps")


@query(
    "lift_table",
    """with u as (select o_custkey, o_orderpriority, max(cast(o_totalprice > 450000 as integer)) as f from orders group by 1, 2),
    a as (select o_custkey, max(cast(o_totalprice > 450000 as integer)) as f from orders group by 1)
    select o_orderpriority, count(*) as members, round(avg(f), 6) as share_with_event, round((select avg(f) from a), 6) as overall_share,
      round(avg(f) / (select avg(f) from a), 6) as lift from u group by 1 having count(*) >= 5""",
)
def _(t):
    o = t("orders").withColumn("flag", F.col("o_totalprice") > 450000)
    out = A.lift_table(o, "o_custkey", "o_orderpriority", "flag", 5)
    return out.select("o_orderpriority", "members", r("share_with_event"), r("overall_share"), r("lift"))


@query(
    "mann_whitney",
    """with d as (select round(value) as v, event_type = 'purchase' as a from events where event_type in ('purchase', 'view')),
    k as (select v, a, rank() over (order by v) + (count(*) over (partition by v) - 1) / 2.0 as rk from d),
    s as (select sum(rk) filter (a) as r1, count(*) filter (a) as n1, count(*) filter (not a) as n2 from k),
    ties as (select sum(c * c * c - c) as tt from (select count(*)::double as c from d group by v)),
    u as (select r1 - n1 * (n1 + 1) / 2.0 as u, n1, n2, tt from s, ties)
    select round(u, 4) as u, round((u - n1 * n2 / 2.0 - 0.5) / sqrt(n1 * n2 / 12.0 * ((n1 + n2 + 1) - tt / ((n1 + n2) * (n1 + n2 - 1.0)))), 6) as z,
      cast(n1 as double) as n1, cast(n2 as double) as n2 from u""",
)
def _(t):
    e = t("events").filter("event_type in ('purchase', 'view')").withColumn("v", F.round("value"))
    out = A.mann_whitney(e, "v", F.col("event_type") == "purchase")
    return out.select(r("u", 4), r("z"), "n1", "n2")


@query(
    "flag_cooccurrence",
    """with f as (select o_custkey, max((o_orderstatus = 'F')::int) as f, max((o_orderstatus = 'P')::int) as p, max((o_orderpriority = '1-URGENT')::int) as u from orders group by 1)
    select 'f' as a, 'p' as b, round(corr(f, p), 6) as r from f union all select 'f', 'u', round(corr(f, u), 6) from f union all select 'p', 'u', round(corr(p, u), 6) from f""",
)
def _(t):
    st, pr = F.col("o_orderstatus"), F.col("o_orderpriority")
    f = t("orders").groupBy("o_custkey").agg(
        F.max((st == "F").cast("int")).alias("f"), F.max((st == "P").cast("int")).alias("p"),
        F.max((pr == "1-URGENT").cast("int")).alias("u"),
    )
    return A.corr_matrix(f, ["f", "p", "u"]).select("a", "b", r("r"))


@query(
    "frequency_of_frequencies",
    "select times_used, count(*) as n_codes from (select l_partkey, count(*) as times_used from lineitem group by 1) group by 1",
)
def _(t):
    return A.frequency_of_frequencies(t("lineitem"), "l_partkey")


@query(
    "catalog_coverage",
    """select p_type, count(*) as rows, count(distinct l_partkey) as items, count(distinct l_orderkey) as entities
    from lineitem join part on l_partkey = p_partkey group by 1""",
)
def _(t):
    j = t("lineitem").select("l_partkey", "l_orderkey").join(t("part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    return A.coverage(j, "p_type", "l_partkey", "l_orderkey")


@query(
    "comorbidity_index",
    """with f as (select l_orderkey, max((l_returnflag = 'R')::int) as a, max((l_returnflag = 'A')::int) as b, max((l_quantity > 45)::int) as c,
         max((l_discount > 0.09)::int) as d from lineitem group by 1)
    select l_orderkey, greatest(a, 3 * b) + greatest(2 * c, 6 * d) + 2 * a as index_score from f""",
)
def _(t):
    from wardspan.functions.compat import greatest_strict

    f = t("lineitem").groupBy("l_orderkey").agg(
        F.max((F.col("l_returnflag") == "R").cast("int")).alias("a"),
        F.max((F.col("l_returnflag") == "A").cast("int")).alias("b"),
        F.max((F.col("l_quantity") > 45).cast("int")).alias("c"),
        F.max((F.col("l_discount") > 0.09).cast("int")).alias("d"),
    )
    s = greatest_strict(F.col("a"), F.col("b") * 3) + greatest_strict(F.col("c") * 2, F.col("d") * 6) + F.col("a") * 2
    return f.select("l_orderkey", s.alias("index_score"))
