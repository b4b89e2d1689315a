"""Alert replay and its evaluation, outcome labels, return cohorts."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardspan.functions.compat import epoch_us
from wardspan.plans import alerts as AL
from wardspan.plans import labels as L
from wardspan.queries.analytics import HOURS_SQL, hours_in, r, rates_of, RISK_SQL
from wardspan.queries.grid import GRID_SQL, SCORE_SQL, scored_grid, user_grid
from wardspan.queries.registry import query

# replay: an hour of a user escalates from 7 points on
_HIST = SCORE_SQL + """,
 esc as (select s.user_id, t0 + to_hours(hour) as at, score from scored s join first_seen f on s.user_id = f.user_id where score >= 7),
 hist as (select user_id, time_bucket(interval 4 hour, at) as bucket, min(at) as raised_at, max(at) as last_seen_at, count(*) as repeat_count,
     case when count(*) >= 3 then 'escalated' else 'active' end as status from esc group by 1, 2)"""


def replay(t):
    first = t("events").groupBy("user_id").agg(F.min("ts").alias("t0"))
    g = scored_grid(t).filter("score >= 7").select("user_id", "hour", "score").join(first, "user_id")
    at = F.col("t0") + F.expr("make_dt_interval(0, hour)")
    g = g.select(F.col("user_id"), at.alias("at"), F.lit("score").alias("alert_type"), F.lit("high").alias("severity"))
    return AL.dedup_alerts(g, "user_id", "alert_type", "at", "severity")


@query("alert_replay", f"with {_HIST.replace(' at,', ' at_,').replace('(at)', '(at_)').replace('hour, at)', 'hour, at_)')} select * from hist")
def _(t):
    return replay(t).select("user_id", "bucket", "raised_at", "last_seen_at", "repeat_count", "status")


_HIST = _HIST.replace(" at,", " at_,").replace("(at)", "(at_)").replace("hour, at)", "hour, at_)")


@query(
    "alerts_per_day",
    f"with {_HIST} select (select count(*) from hist) as n_alerts, round((select count(*) from hist) / ((select count(*) from grid) / 24.0), 6) as per_patient_day",
)
def _(t):
    n = replay(t).agg(F.count(F.lit(1)).alias("n_alerts")).withColumn("k", F.lit(1))
    d = user_grid(t).agg(F.count(F.lit(1)).alias("rows")).withColumn("k", F.lit(1))
    return n.join(d, "k").select("n_alerts", F.round(F.col("n_alerts") / (F.col("rows") / 24.0), 6).alias("per_patient_day"))


_FIRST = """fe as (select user_id, min(ts) as event_time from events where event_type = 'purchase' and value > 120 group by 1)"""


def first_big(t):
    e = t("events").filter("event_type = 'purchase' and value > 120")
    return e.groupBy("user_id").agg(F.min("ts").alias("event_time"))


@query(
    "lead_time",
    f"""with {_HIST}, {_FIRST} select fe.user_id, fe.event_time, max(raised_at) as last_alert_at, round((epoch_us(fe.event_time) - epoch_us(max(raised_at))) / 3600000000.0, 6) as lead_h
    from fe left join hist on fe.user_id = hist.user_id and raised_at < event_time group by 1, 2""",
)
def _(t):
    out = AL.lead_time(replay(t), first_big(t), "user_id", "raised_at", "event_time")
    return out.select("user_id", "event_time", "last_alert_at", r("lead_h"))


@query(
    "lead_time_summary",
    f"""with {_HIST}, {_FIRST}, l as (select fe.user_id, (epoch_us(any_value(fe.event_time)) - epoch_us(max(raised_at))) / 3600000000.0 as lead_h
       from fe left join hist on fe.user_id = hist.user_id and raised_at < event_time group by 1)
    select count(lead_h) as n_covered, count(*) as n_events, round(median(lead_h), 6) as median_lead_h, round(count(lead_h) / count(*), 6) as coverage from l""",
)
def _(t):
    out = AL.lead_time(replay(t), first_big(t), "user_id", "raised_at", "event_time")
    return AL.lead_time_summary(out).select("n_covered", "n_events", r("median_lead_h"), r("coverage"))


@query(
    "false_alarm_by_hour",
    f"""with {_HIST}, {_FIRST}, j as (select hour(raised_at)::integer as hour_of_day, coalesce(event_time >= raised_at and event_time <= raised_at + interval 72 hour, false) as hit
       from hist left join fe on hist.user_id = fe.user_id)
    select hour_of_day, count(*) as n_alerts, count(*) filter (hit) as n_true, round(1 - count(*) filter (hit) / count(*), 6) as false_alarm_rate from j group by 1""",
)
def _(t):
    out = AL.false_alarms_by_hour(replay(t), first_big(t), "user_id", "raised_at", "event_time", 72)
    return out.select("hour_of_day", "n_alerts", "n_true", r("false_alarm_rate"))


@query(
    "alert_history",
    """with l as (select user_id, event_type, ts, case when event_type in ('view', 'click', 'error') then 'raise' when event_type = 'purchase' then 'acknowledge' else 'suppress' end as kind,
        case when value > 60 then 'high' else 'medium' end as sev, time_bucket(interval 1 day, ts) as bucket from events),
    g as (select *, coalesce(sum((kind = 'acknowledge')::int) over (partition by user_id, bucket order by ts rows between unbounded preceding and 1 preceding), 0) as gen from l),
    a as (select user_id, bucket, gen, min(ts) filter (kind = 'raise') as raised_at, max(ts) filter (kind = 'raise') as last_seen_at, count(*) filter (kind = 'raise') as repeat_count,
        arg_min(sev, ts) filter (kind = 'raise') as severity, max(ts) filter (kind = 'acknowledge') as acknowledged_at, min(ts) filter (kind = 'suppress') as suppressed_at from g group by 1, 2, 3)
    select user_id, bucket, raised_at, last_seen_at, repeat_count, severity, acknowledged_at, suppressed_at,
      case when acknowledged_at is not null then 'acknowledged' when suppressed_at is not null then 'suppressed' when repeat_count >= 3 then 'escalated' else 'active' end as status
    from a where raised_at is not null""",
)
def _(t):
    k = F.col("event_type")
    kind = F.when(k.isin("view", "click", "error"), "raise").when(k == "purchase", "acknowledge").otherwise("suppress")
    log = t("events").select("user_id", F.lit("a").alias("alert_type"), "ts", kind.alias("kind"), F.when(F.col("value") > 60, "high").otherwise("medium").alias("sev"))
    return AL.alert_history(log, "user_id", "alert_type", "ts", "kind", "sev", hours=24).drop("alert_type")


@query(
    "alert_status_fold",
    """with l as (select user_id, ts, case when event_type in ('view', 'click') then 'status' when event_type = 'error' then 'severity' else 'acknowledged_by' end as field,
        case when value > 60 then 'x' else 'y' end as v from events)
    select user_id, coalesce(arg_max(v, ts) filter (field = 'status'), 'active') as status, arg_max(v, ts) filter (field = 'severity') as severity,
      arg_max(v, ts) filter (field = 'acknowledged_by') as acknowledged_by, max(ts) as updated_at from l group by 1""",
)
def _(t):
    k = F.col("event_type")
    field = F.when(k.isin("view", "click"), "status").when(k == "error", "severity").otherwise("acknowledged_by")
    e = t("events").select("user_id", "ts", field.alias("field"), F.when(F.col("value") > 60, "x").otherwise("y").alias("v"))
    return AL.fold_status(e, "user_id", "ts", "field", "v")


@query(
    "alert_regrade",
    """select event_id, case when user_id % 3 > 0 and value > 30 and event_type <> 'view' then case when value > 100 then 'high' else 'low' end else 'medium' end as severity from events""",
)
def _(t):
    grade = F.when(F.col("value") > 100, "high").when(F.col("value") > 30, "low")
    sev = AL.regrade(F.lit("medium"), F.col("user_id") % 3 > 0, grade, F.col("event_type") != "view")
    return t("events").select("event_id", sev.alias("severity"))


@query(
    "event_rate_norm",
    f"""with {RISK_SQL}, s as (select event_type, coalesce(avg(rate) filter (hour >= 24 and at_risk >= 145), avg(rate)) as base from rates group by 1),
    n as (select user_id, event_type, count(*) as n from events group by 1, 2)
    select user_id, n.event_type, n, round(n / 720.0 / base, 6) as normalized_rate from n join s on n.event_type = s.event_type""",
)
def _(t):
    from wardspan.evaluation.analytics import stationary_rates

    n = t("events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    base = stationary_rates(rates_of(t), "event_type", min_at_risk=145)
    return AL.normalized_rate(n, base, "event_type", "n", 720.0).select("user_id", "event_type", "n", r("normalized_rate"))


# --- labels -------------------------------------------------------------------------------

_EVENTS3 = """u3 as (select user_id, ts, 'big' as kind from events where value > 180 union all
   select user_id, ts, 'buy' from events where event_type = 'purchase' and value > 90),
  first3 as (select user_id, min(ts) as event_time, arg_min(kind, (ts, kind)) as event_type from u3 group by 1)"""


def first3(t):
    e = t("events")
    src = {"big": e.filter("value > 180"), "buy": e.filter("event_type = 'purchase' and value > 90")}
    return L.first_event({k: d.select("user_id", F.col("ts").alias("event_time")) for k, d in src.items()}, "user_id")


_LAB = GRID_SQL + f""", {_EVENTS3}, lab as (select g.user_id, g.hour, event_time, event_type,
    (event_time is not null and event_time <= t0 + to_hours(hour + 6))::int as label_6h, (event_time is not null and event_time <= t0 + to_hours(hour + 12))::int as label_12h
   from grid g join first_seen f on g.user_id = f.user_id left join first3 e on g.user_id = e.user_id where event_time is null or event_time > t0 + to_hours(hour))"""


def at_risk(t):
    e = t("events")
    anchors = e.groupBy("user_id").agg(F.min("ts").alias("icu_intime"))
    return L.at_risk_labels(user_grid(t).select("user_id", "hour"), anchors, first3(t), [6, 12], key="user_id")


@query("at_risk_censor", f"with {_LAB} select * from lab")
def _(t):
    return at_risk(t)


@query(
    "label_summary",
    f"""with {_LAB} """ + " union all ".join(
        f"select {h} as horizon_h, sum(label_{h}h)::bigint as positive_hours, count(*) as total_hours, count(distinct case when label_{h}h = 1 then user_id end) as positive_stays, round(avg(label_{h}h), 6) as prevalence from lab"
        for h in (6, 12)
    ),
)
def _(t):
    s = L.label_summary(at_risk(t), [6, 12], "user_id")
    return s.select("horizon_h", "positive_hours", "total_hours", "positive_stays", r("prevalence"))


@query(
    "composite_labels",
    f"with {_EVENTS3} select event_type, count(*) as n, min(event_time) as first_at from first3 group by 1",
)
def _(t):
    return first3(t).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_time").alias("first_at"))


_ADM = """adm as (select o_custkey as subject_id, o_orderkey as hadm_id, o_orderdate as admittime, o_orderdate + to_days((1 + o_orderkey % 12)::integer) as dischtime,
     (o_orderstatus = 'P' and o_orderkey % 9 = 0)::int as hospital_expire_flag, case when o_orderkey % 17 = 0 then 'HOSPICE' else 'HOME' end as discharge_location from orders),
  pat as (select c_custkey as subject_id, case when c_custkey % 4 = 0 then timestamp '1999-06-01' + to_days((c_custkey % 700)::integer) end as dod from customer),
  seq as (select a.*, dod, row_number() over w - 1 as n_prior_admissions, lag(dischtime) over w as prev_d, lead(admittime) over w as next_a
     from adm a join pat using (subject_id) window w as (partition by subject_id order by admittime, hadm_id)),
  co as (select *, (epoch_us(admittime) - epoch_us(prev_d)) / 86400000000.0 as days_since_last_discharge, (epoch_us(next_a) - epoch_us(dischtime)) / 86400000000.0 as days_to_next,
     coalesce((epoch_us(next_a) - epoch_us(dischtime)) / 86400000000.0 <= 30, false)::int as readmit_30d, (epoch_us(dod) - epoch_us(dischtime)) / 86400000000.0 as days_to_death,
     (select count(*) from adm b where b.subject_id = seq.subject_id and b.admittime < seq.admittime and b.admittime >= seq.admittime - interval 365 day) as n_prior_admissions_365d from seq),
  naive as (select *, discharge_location = 'HOSPICE' as excluded_hospice, coalesce(days_to_death <= 30, false) and readmit_30d = 0 as excluded_died, next_a is null as is_last from co where hospital_expire_flag = 0),
  strict_c as (select * from naive where not excluded_hospice and not excluded_died)"""


def admissions(t):
    k = F.col("o_orderkey")
    stay = F.make_dt_interval((1 + k % 12).cast("int"))
    return t("orders").select(
        F.col("o_custkey").alias("subject_id"), k.alias("hadm_id"), F.col("o_orderdate").alias("admittime"), (F.col("o_orderdate") + stay).alias("dischtime"),
        ((F.col("o_orderstatus") == "P") & (k % 9 == 0)).cast("int").alias("hospital_expire_flag"),
        F.when(k % 17 == 0, "HOSPICE").otherwise("HOME").alias("discharge_location"),
    )


def patients(t):
    c = F.col("c_custkey")
    dod = F.to_timestamp_ntz(F.lit("1999-06-01 00:00:00")) + F.make_dt_interval((c % 700).cast("int"))
    return t("customer").select(
        c.alias("subject_id"), F.when(c % 4 == 0, dod).alias("dod"), F.when(c % 2 == 0, "F").otherwise("M").alias("gender"), (20 + c % 60).alias("anchor_age")
    )


_OUT = "subject_id, hadm_id, n_prior_admissions, n_prior_admissions_365d, round(days_since_last_discharge, 6) as days_since_last_discharge, round(days_to_next, 6) as days_to_next, readmit_30d, is_last as is_last_admission"


@query("return_within_30d", f"with {_ADM} select {_OUT} from strict_c")
def _(t):
    c = L.return_cohort(admissions(t), patients(t))
    return c.select(
        "subject_id", "hadm_id", "n_prior_admissions", "n_prior_admissions_365d", r("days_since_last_discharge"), r("days_to_next"), "readmit_30d", "is_last_admission"
    )


@query(
    "return_cohort_summary",
    f"""with {_ADM} select 'all live discharges' as cohort, count(*) as admissions, sum(readmit_30d)::bigint as readmitted_30d, round(avg(readmit_30d), 6) as rate from naive
    union all select 'less hospice', count(*), sum(readmit_30d)::bigint, round(avg(readmit_30d), 6) from naive where not excluded_hospice
    union all select 'less died before return', count(*), sum(readmit_30d)::bigint, round(avg(readmit_30d), 6) from strict_c""",
)
def _(t):
    naive = L.return_cohort(admissions(t), patients(t), strict=False)
    return L.cohort_summary(naive).select("cohort", "admissions", "readmitted_30d", r("rate"))


@query(
    "return_censoring",
    f"""with {_ADM}, p as (select subject_id, count(*) as n from strict_c group by 1)
    select count(*) as admissions, sum(readmit_30d)::bigint as positives, round(avg(readmit_30d), 6) as rate, (select count(*) from p) as patients, round((select avg(n) from p), 6) as admissions_per_patient_mean,
      (select max(n) from p) as admissions_per_patient_max, count(*) filter (is_last) as right_censored, round(avg(is_last::int), 6) as right_censored_fraction from strict_c""",
)
def _(t):
    c = L.censoring_summary(L.return_cohort(admissions(t), patients(t)))
    return c.select(
        "admissions", "positives", r("rate"), "patients", r("admissions_per_patient_mean"), "admissions_per_patient_max", "right_censored", r("right_censored_fraction")
    )


@query(
    "lace_features",
    f"""with {_ADM}, li as (select l_orderkey as hadm_id, count(*) as n_diagnoses, count(distinct l_partkey) as n_distinct_drugs, max((l_returnflag = 'R')::int) as came_via_ed,
        greatest(max((l_quantity > 45)::int), 2 * max((l_tax > 0.07)::int)) as charlson from lineitem group by 1)
    select c.hadm_id, round((epoch_us(dischtime) - epoch_us(admittime)) / 86400000000.0, 6) as los_days, coalesce(n_diagnoses, 0) as n_diagnoses, coalesce(n_distinct_drugs, 0) as n_distinct_drugs,
      coalesce(came_via_ed, 0) as came_via_ed, charlson, n_prior_admissions_365d, readmit_30d from strict_c c left join li using (hadm_id)""",
)
def _(t):
    c = L.return_cohort(admissions(t), patients(t))
    li = t("lineitem").groupBy(F.col("l_orderkey").alias("hadm_id")).agg(
        F.count(F.lit(1)).alias("n_diagnoses"), F.countDistinct("l_partkey").alias("n_distinct_drugs"),
        F.max((F.col("l_returnflag") == "R").cast("int")).alias("came_via_ed"),
        F.greatest(F.max((F.col("l_quantity") > 45).cast("int")), 2 * F.max((F.col("l_tax") > 0.07).cast("int"))).alias("charlson"),
    )
    out = c.join(li, "hadm_id", "left").fillna(0, ["n_diagnoses", "n_distinct_drugs", "came_via_ed"])
    los = (epoch_us("dischtime") - epoch_us("admittime")) / F.lit(86_400_000_000.0)
    return out.select(
        "hadm_id", F.round(los, 6).alias("los_days"), "n_diagnoses", "n_distinct_drugs", "came_via_ed", "charlson", "n_prior_admissions_365d", "readmit_30d"
    )


@query(
    "first_day_features",
    f"""with {SCORE_SQL} select user_id, max(score) filter (hour < 24) as max_score_24h, round(avg(view) filter (hour < 24), 6) as mean_view_24h,
       max((score >= 8)::int) as ever_high, max((tier_rank > 0)::int) as ever_scored from (select *, score as tier_rank from scored) group by 1""",
)
def _(t):
    g = scored_grid(t)
    day1 = F.col("hour") < 24
    return g.groupBy("user_id").agg(
        F.max(F.when(day1, F.col("score"))).alias("max_score_24h"), F.round(F.avg(F.when(day1, F.col("view"))), 6).alias("mean_view_24h"),
        F.max((F.col("score") >= 8).cast("int")).alias("ever_high"), F.max((F.col("score") > 0).cast("int")).alias("ever_scored"),
    )


@query(
    "entity_encoding",
    f"""with {HOURS_SQL}, x as (select user_id, h, value, lag(value) over (partition by user_id order by ts) as p from ev)
    select user_id, round(avg(value), 6) as level, round(regr_slope(value, h), 6) as slope, round(stddev_pop(value), 6) as sd, round(corr(value, p), 6) as rho, count(*) as length from x group by 1""",
)
def _(t):
    from wardspan.plans.features import entity_parameters

    ev, _ = hours_in(t)
    out = entity_parameters(ev, "user_id", "ts", "h", ["value"])
    return out.select(
        "user_id", F.round("value_level", 6).alias("level"), F.round("value_slope", 6).alias("slope"),
        F.round("value_sd", 6).alias("sd"), F.round("value_rho", 6).alias("rho"), "length",
    )


_E = epoch_us
