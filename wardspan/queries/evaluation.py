"""Ranking metrics, calibration, bootstrap, audits and synthetic-data comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardspan.evaluation import metrics as M
from wardspan.evaluation import synthetic as Y
from wardspan.operators import sampling as S
from wardspan.operators.scan import exact_percentiles
from wardspan.queries.analytics import TYPES, r
from wardspan.queries.registry import query

# y: is the event an error or a large purchase; score: a noisy function of the value
SCORE_ROWS = """sc as (select event_id, user_id, event_type, (event_type = 'error' or (event_type = 'purchase' and value > 70))::int as y,
   floor(least(value, 300.0::double) / 300 * 600 + (event_id * 37 % 100) * 4 + case when event_type in ('error', 'purchase') then 80 else 0 end) / 1000.0::double as score, ts from events)"""


def score_rows(t):
    k, v = F.col("event_type"), F.col("value")
    y = ((k == "error") | ((k == "purchase") & (v > 70))).cast("int")
    s = F.least(v, F.lit(300.0)) / 300 * 600 + (F.col("event_id") * 37 % 100) * 4
    s = F.floor(s + F.when(k.isin("error", "purchase"), 80).otherwise(0)) / F.lit(1000.0)
    return t("events").select("event_id", "user_id", "event_type", y.alias("y"), s.alias("score"), "ts")


def _rank_sql(by, src="sc", w=None, tag=""):
    """Rank metrics in plain SQL over a relation with y and score."""
    g = ", ".join(by)
    cnt = w or "1"
    return f"""agg0{tag} as (select {g}, score, sum({cnt} * y)::double as p, sum({cnt} * (1 - y))::double as n, sum({cnt} * (score - y) * (score - y)) as b from {src} group by {g}, score),
    cum{tag} as (select *, sum(n) over (partition by {g} order by score) as n_upto, sum(p) over (partition by {g} order by score desc) as p_ge,
       sum(n) over (partition by {g} order by score desc) as n_ge, sum(p) over (partition by {g}) as pa, sum(n) over (partition by {g}) as na from agg0{tag}),
    rm{tag} as (select {g}, sum(p + n) as n_rows, sum(p) as n_positives,
       case when max(pa) > 0 and max(na) > 0 then sum(p * (n_upto - n + n / 2)) / max(pa * na) end as auroc,
       case when max(pa) > 0 and max(na) > 0 then sum(case when p > 0 then p * p_ge / (p_ge + n_ge) else 0 end) / max(pa) end as auprc, sum(b) / sum(p + n) as brier
     from cum{tag} group by {g})"""


@query(
    "ranked_metrics",
    f"with {SCORE_ROWS}, {_rank_sql(['grp'], '(select *, user_id % 6 as grp from sc)')} select grp, n_rows, n_positives, round(auroc, 6) as auroc, round(auprc, 6) as auprc, round(brier, 6) as brier from rm",
)
def _(t):
    d = score_rows(t).withColumn("grp", F.col("user_id") % 6)
    m = M.ranked_metrics(d, ["grp"])
    return m.select("grp", "n_rows", "n_positives", r("auroc"), r("auprc"), r("brier"))


@query(
    "label_auroc",
    f"""with sc as (select 1 as g, toxic as y, n_chars::double as score from labels join documents using (doc_id)), {_rank_sql(['g'])}
    select n_rows, n_positives, round(auroc, 6) as auroc, round(auprc, 6) as auprc from rm""",
)
def _(t):
    d = t("labels").join(t("documents").select("doc_id", "n_chars"), "doc_id")
    d = d.select(F.lit(1).alias("g"), F.col("toxic").alias("y"), F.col("n_chars").cast("double").alias("score"))
    return M.ranked_metrics(d, ["g"]).select("n_rows", "n_positives", r("auroc"), r("auprc"))


_EDGES = ", ".join(f"quantile_cont(score, {i / 10})" for i in range(1, 10))


@query(
    "calibration_bins",
    f"""with {SCORE_ROWS}, e as (select list_distinct([{_EDGES}]) as edges from sc)
    select len(list_filter(edges, lambda x: x < score))::integer as bin, round(avg(score), 6) as mean_predicted, round(avg(y), 6) as observed_rate, count(*) as n from sc, e group by 1""",
)
def _(t):
    return M.calibration(score_rows(t)).select("bin", r("mean_predicted"), r("observed_rate"), "n")


_TH = [0.01 + i * (0.49 / 49) for i in range(50)]


@query(
    "decision_curve",
    f"""with {SCORE_ROWS}, th as (select unnest({_TH!r}::double[]) as threshold), base as (select count(*)::double as n, avg(y) as prev from sc),
    c as (select threshold, count(*) filter (score >= threshold and y = 1) as tp, count(*) filter (score >= threshold and y = 0) as fp from sc, th group by 1)
    select round(threshold, 6) as threshold, round(tp / n - fp / n * (threshold / (1 - threshold)), 6) as net_benefit_model,
      round(prev - (1 - prev) * (threshold / (1 - threshold)), 6) as net_benefit_treat_all, 0.0::double as net_benefit_treat_none from c, base""",
)
def _(t):
    d = M.decision_curve(score_rows(t), _TH)
    return d.select(r("threshold"), r("net_benefit_model"), r("net_benefit_treat_all"), "net_benefit_treat_none")


# --- bootstrap: the same md5 draws in SQL -----------------------------------------------

def _hash(*parts):
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 12))::bigint / {float(16 ** 12)!r})"


def _boot_sql(unit, n, seed, src, strata=()):
    """draws(strata, replicate, unit, times) from a relation with the unit column."""
    g = ", ".join(strata)
    gs = f"{g}, " if g else ""
    part = f"partition by {g}" if g else ""
    return f"""u as (select distinct {gs}{unit} from {src}),
    un as (select *, row_number() over ({part} order by {_hash(repr(str(seed)), unit)}, {unit}) as i, count(*) over ({part}) as n from u),
    dr as (select {gs}b as replicate, floor({_hash(repr(f'b{seed}'), 'b', 'un.i')} * n)::bigint + 1 as i, count(*) as times
        from un, (select unnest(generate_series(1, {n})) as b) group by all),
    draws as (select {', '.join(f'dr.{s}' for s in strata) + ', ' if strata else ''}replicate, un.{unit}, times from dr join un on dr.i = un.i {' '.join(f'and dr.{s} = un.{s}' for s in strata)})"""


@query(
    "boot_ci",
    f"""with {SCORE_ROWS}, {_boot_sql('user_id', 1000, 5, 'sc')},
    rs as (select replicate, y, score, times from sc join draws using (user_id)), {_rank_sql(['replicate'], 'rs', 'times')}
    select round(quantile_cont(auroc, 0.025), 6) as lo, round(quantile_cont(auroc, 0.975), 6) as hi from rm""",
)
def _(t):
    d = score_rows(t).withColumn("g", F.lit(1))
    return M.boot_ci(d, ["g"], "user_id", "auroc", 1000, seed=5).select(r("lo"), r("hi"))


@query(
    "group_cutpoint_ci",
    f"""with {SCORE_ROWS}, x as (select user_id, (user_id % 4)::bigint as grp, floor(score * 200)::bigint as s from sc), {_boot_sql('user_id', 500, 2, 'x', ('grp',))},
    e as (select d.grp, replicate, s, sum(times) as w from x join draws d on x.user_id = d.user_id and x.grp = d.grp group by 1, 2, 3),
    c as (select grp, replicate, s, sum(w) over (partition by grp, replicate order by s) as upto, sum(w) over (partition by grp, replicate) as n from e),
    q as (select grp, replicate, min(s) filter (upto > floor(0.9 * (n - 1))) as lo, min(s) filter (upto > ceil(0.9 * (n - 1))) as hi, any_value(0.9 * (n - 1) - floor(0.9 * (n - 1))) as f from c group by 1, 2)
    select grp, round(quantile_cont((lo + (hi - lo) * f)::double, 0.025), 6) as high_lo, round(quantile_cont((lo + (hi - lo) * f)::double, 0.975), 6) as high_hi from q group by 1""",
)
def _(t):
    x = score_rows(t).select("user_id", (F.col("user_id") % 4).alias("grp"), F.floor(F.col("score") * 200).alias("s"))
    per = S.drawn_weights(x, ["grp"], "user_id", "s", 500, 2)
    q = exact_percentiles(per, ["grp", "replicate"], "s", {"q90": 0.9}, F.col("weight"))
    ci = exact_percentiles(q, ["grp"], "q90", {"high_lo": 0.025, "high_hi": 0.975})
    return ci.select("grp", r("high_lo"), r("high_hi"))


_DIMS = "unpivot (subgroup for dimension in (kind, part_of_day))"


@query(
    "subgroup_audit",
    f"""with {SCORE_ROWS}, lo0 as (select user_id, y, score, event_type::varchar as kind, case when hour(ts) < 6 then 'night' when hour(ts) < 18 then 'day' else 'evening' end as part_of_day from sc),
    x as (select user_id, y, score, dimension, subgroup from lo0 {_DIMS}),
    base as (select dimension, subgroup, count(*) as n_rows, sum(y)::bigint as n_positives, round(avg(y), 4) as event_rate, round(avg((score >= 0.4)::int), 4) as alert_rate from x group by 1, 2),
    ok as (select x.* from x join base using (dimension, subgroup) where base.n_rows >= 100 and n_positives >= 5), {_boot_sql('user_id', 600, 1, 'ok', ('dimension', 'subgroup'))},
    rs as (select d.dimension, d.subgroup, replicate, y, score, times from ok join draws d on ok.user_id = d.user_id and ok.dimension = d.dimension and ok.subgroup = d.subgroup),
    {_rank_sql(['dimension', 'subgroup', 'replicate'], 'rs', 'times')},
    ci as (select dimension, subgroup, quantile_cont(auroc, 0.025) as lo, quantile_cont(auroc, 0.975) as hi from rm group by 1, 2),
    {_rank_sql(['dimension', 'subgroup'], 'ok', tag='1')}
    select dimension, subgroup, b.n_rows, b.n_positives, event_rate, alert_rate, round(case when hi - lo <= 0.05 then auroc end, 6) as auroc,
      round(lo, 6) as auroc_lo, round(hi, 6) as auroc_hi, not coalesce(hi - lo <= 0.05, false) as uninformative
    from base b left join rm1 using (dimension, subgroup) left join ci using (dimension, subgroup)""",
)
def _(t):
    h = F.hour("ts")
    part = F.when(h < 6, "night").when(h < 18, "day").otherwise("evening")
    d = score_rows(t).select("user_id", "y", "score", F.col("event_type").alias("kind"), part.alias("part_of_day"))
    a = M.subgroup_audit(d, ["kind", "part_of_day"], 0.4, "user_id", n_boot=600, seed=1, max_width=0.05)
    return a.select(
        "dimension", "subgroup", "n_rows", "n_positives", "event_rate", "alert_rate", r("auroc"), r("auroc_lo"), r("auroc_hi"), "uninformative"
    )


# --- folds and repeats ------------------------------------------------------------------

FOLDS = f"""gp as (select user_id, sum(y)::bigint as pos from sc group by 1),
  gr as (select *, b as repeat, {_hash("'9'", 'b', 'user_id')} as d from gp, (select unnest(generate_series(0, 3)) as b)),
  folds as (select user_id, repeat, ((row_number() over (partition by repeat, pos order by d, user_id) - 1 + pos % 5) % 5)::integer as fold from gr)"""


@query("grouped_folds", f"with {SCORE_ROWS}, {FOLDS} select user_id, repeat::integer as repeat, fold from folds")
def _(t):
    return S.grouped_folds(score_rows(t), "y", "user_id", 5, 4, 9)


MODELS = f"""{SCORE_ROWS}, {FOLDS}, ms as (select f.repeat, f.fold, m.model, s.y,
     case m.model when 'full' then s.score when 'masked' then floor(s.score * 500 + (s.event_id * 13 % 50) * 10) / 1000.0::double else (s.event_id * 7 % 100) / 100.0 end::double as score
   from sc s join folds f using (user_id), (values ('full'), ('masked'), ('chance')) m(model))"""


def model_scores(t):
    s = score_rows(t)
    folds = S.grouped_folds(s, "y", "user_id", 5, 4, 9)
    e = F.col("event_id")
    arms = F.array(
        F.struct(F.lit("full").alias("model"), F.col("score").alias("score")),
        F.struct(F.lit("masked").alias("model"), (F.floor(F.col("score") * 500 + (e * 13 % 50) * 10) / F.lit(1000.0)).alias("score")),
        F.struct(F.lit("chance").alias("model"), ((e * 7 % 100) / 100.0).alias("score")),
    )
    return s.join(folds, "user_id").select("repeat", "fold", "y", F.inline(arms))


def fold_metrics(t):
    return M.ranked_metrics(model_scores(t), ["repeat", "fold", "model"]).select("repeat", "fold", "model", "auroc", "auprc")


@query(
    "fold_metrics",
    f"with {MODELS}, {_rank_sql(['repeat', 'fold', 'model'], 'ms')} select repeat::integer as repeat, fold, model, round(auroc, 6) as auroc, round(auprc, 6) as auprc from rm",
)
def _(t):
    return fold_metrics(t).select("repeat", "fold", "model", r("auroc"), r("auprc"))


_PER_REP = f"with {MODELS}, {_rank_sql(['repeat', 'fold', 'model'], 'ms')}, pr as (select repeat, model, avg(auprc) as m from rm group by 1, 2)"


@query(
    "wins_of_k",
    f"""{_PER_REP}, w as (select repeat, max(m) filter (model = 'full') as a, max(m) filter (model = 'masked') as b from pr group by 1)
    select count(*) filter (a > b) as wins, count(*) as repeats, round(avg(a), 6) as mean_model, round(avg(b), 6) as mean_baseline, round(avg(a) - avg(b), 6) as delta,
      count(*) filter (a > b) >= 0.75 * count(*) as earns_place from w""",
)
def _(t):
    v = M.ablation_verdict(fold_metrics(t), "full", "masked", "auprc")
    return v.select("wins", "repeats", r("mean_model"), r("mean_baseline"), r("delta"), "earns_place")


@query(
    "mask_study",
    f"""with {MODELS}, {_rank_sql(['repeat', 'fold', 'model'], 'ms')}, j as (select x.model, x.auroc, b.auroc as base from rm x join rm b on x.repeat = b.repeat and x.fold = b.fold and b.model = 'full')
    select model, round(avg(auroc), 6) as mean, count(*) filter (base > auroc) as baseline_wins, count(*) as n, round(avg(auroc) - avg(base), 6) as delta,
      round(avg(auroc) / avg(base) * 100, 6) as retained_pct, round(avg(auroc) / 0.5, 6) as lift from j group by 1""",
)
def _(t):
    m = M.mask_study(fold_metrics(t), "auroc", "full", 0.5)
    return m.select("model", r("mean"), "baseline_wins", "n", r("delta"), r("retained_pct"), r("lift"))


@query(
    "median_rule",
    f"""with {SCORE_ROWS}, {FOLDS}, v as (select s.event_id, s.user_id, f.repeat, f.fold, case when event_id % 5 > 0 then score end as x from sc s join folds f using (user_id)),
    k as (select repeat, fold, (select median(x) from v t where t.repeat = q.repeat and t.fold <> q.fold) as m from (select distinct repeat, fold from folds) q)
    select event_id, v.repeat::integer as repeat, v.fold, round(coalesce(x, m), 6) as rule_score from v join k on v.repeat = k.repeat and v.fold = k.fold""",
)
def _(t):
    s = score_rows(t)
    folds = S.grouped_folds(s, "y", "user_id", 5, 4, 9)
    d = s.select("event_id", "user_id", F.when(F.col("event_id") % 5 > 0, F.col("score")).alias("x"))
    return M.rule_baseline(d, "x", folds, "user_id").select("event_id", "repeat", "fold", r("rule_score"))


@query(
    "rank_weighted",
    """with m as (select user_id, avg(value) as lo_better, case when count(*) filter (event_type = 'click') > 12 then max(value) filter (event_type = 'click') end as hi_better from events group by 1),
    k as (select user_id, rank() over (order by lo_better) + (count(*) over (partition by lo_better) - 1) / 2.0 as ra,
       rank() over (order by -hi_better nulls last) + (count(*) over (partition by hi_better) - 1) / 2.0 as rb from m)
    select user_id, ra::double as rank_lo_better, rb::double as rank_hi_better, round(0.7 * ra + 0.3 * rb, 6)::double as overall from k""",
)
def _(t):
    e = t("events")
    c = F.when(F.col("event_type") == "click", F.col("value"))
    m = e.groupBy("user_id").agg(
        F.avg("value").alias("lo_better"), F.when(F.count(c) > 12, F.max(c)).alias("hi_better")
    )
    out = M.rank_rows(m, "user_id", {"lo_better": True, "hi_better": False}, {"lo_better": 0.7, "hi_better": 0.3})
    return out.select("user_id", "rank_lo_better", "rank_hi_better", r("overall"))


_CURVE = f"""with {SCORE_ROWS}, cu as (select distinct user_id from sc),
  fd as (select user_id, d, f from cu, (select unnest(generate_series(0, 4)) as d), (select unnest([0.25, 0.5, 0.75, 1.0]::double[]) as f)
     where {_hash("'4'", 'd', 'user_id')} < f),
  cv as (select f as fraction, d as draw, count(distinct user_id) filter (y = 1) as n_pos, count(*) as n_rows, stddev_samp(score) / sqrt(count(*)) * 3.92 as ci_width from sc join fd using (user_id) group by 1, 2)"""


def curve(t):
    s = score_rows(t)
    d = S.fraction_draws(s, "user_id", [0.25, 0.5, 0.75, 1.0], 5, 4)
    return s.join(d, "user_id").groupBy("fraction", "draw").agg(
        F.countDistinct(F.when(F.col("y") == 1, F.col("user_id"))).alias("n_pos"), F.count(F.lit(1)).alias("n_rows"),
        (F.stddev_samp("score") / F.sqrt(F.count(F.lit(1))) * 3.92).alias("ci_width"),
    )


@query("learning_curve", _CURVE + " select fraction, draw::integer as draw, n_pos, n_rows, round(ci_width, 6) as ci_width from cv")
def _(t):
    return curve(t).select("fraction", "draw", "n_pos", "n_rows", r("ci_width"))


@query(
    "ci_scaling",
    _CURVE + """, g as (select fraction, avg(n_pos) as n, avg(ci_width) as w from cv group by 1),
    fit as (select regr_slope(ln(w), ln(n)) as b, exp(regr_intercept(ln(w), ln(n))) as a, exp(avg(ln(w) + 0.5 * ln(n))) as s from g),
    e as (select a, b, s, 1 - sum(power(w - a * power(n, b), 2)) / sum(power(w - (select avg(w) from g), 2)) as r2 from g, fit group by 1, 2, 3)
    select round(a, 6) as a, round(b, 6) as b, round(s, 6) as sqrt_a, round(r2, 6) as r2, round(power(0.005 / a, 1 / b), 3) as n_free, round(power(s / 0.005, 2), 3) as n_sqrt from e""",
)
def _(t):
    fit = M.ci_scaling(curve(t))
    return fit.select(
        r("a"), r("b"), r("sqrt_a"), r("r2"), F.round(F.pow(F.lit(0.005) / F.col("a"), 1 / F.col("b")), 3).alias("n_free"),
        F.round(F.pow(F.col("sqrt_a") / 0.005, 2), 3).alias("n_sqrt"),
    )


@query(
    "resample_units",
    f"""with {SCORE_ROWS}, {_boot_sql('user_id', 1, 8, 'sc')}, n as (select user_id, times, sum(times) over (order by {_hash("'copies'", 'user_id')}, user_id) as hi from draws),
    c as (select user_id, -(hi - times + unnest(generate_series(1, times))) as synthetic_id from n)
    select synthetic_id::bigint as synthetic_id, count(*) as n_rows, round(sum(score), 6) as total from sc join c using (user_id) group by 1""",
)
def _(t):
    s = score_rows(t)
    times = S.bootstrap_counts(s, "user_id", [], 1, 8).select("user_id", "times")
    out = S.resample_units(s, "user_id", times)
    return out.groupBy("synthetic_id").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("score"), 6).alias("total"))


@query(
    "subject_split",
    f"""with {SCORE_ROWS} select case when {_hash("'11'", 'user_id')} < 0.7 then 'train' else 'test' end as split, count(*) as n, count(distinct user_id) as subjects, sum(y)::bigint as positives from sc group by 1""",
)
def _(t):
    s = S.hash_split(score_rows(t), "user_id", 0.7, 11)
    return s.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("subjects"), F.sum("y").alias("positives")
    )


@query(
    "arm_positives",
    f"""with {MODELS} , pu as (select f.repeat, f.fold, s.user_id, max(s.y) as y, count(*) as n from sc s join folds f using (user_id) group by 1, 2, 3)
    select repeat::integer as repeat, fold, count(*) filter (y = 1) as positive_subjects, sum(n)::bigint as n_rows from pu group by 1, 2""",
)
def _(t):
    s = score_rows(t)
    folds = S.grouped_folds(s, "y", "user_id", 5, 4, 9)
    per = s.groupBy("user_id").agg(F.max("y").alias("y"), F.count(F.lit(1)).alias("n")).join(folds, "user_id")
    return per.groupBy("repeat", "fold").agg(
        F.count(F.when(F.col("y") == 1, 1)).alias("positive_subjects"), F.sum("n").alias("n_rows")
    )


# --- real against synthetic ----------------------------------------------------------------

_HALF = "l_suppkey % 2 = 0"


def halves(t):
    li = t("lineitem")
    return li.filter(F.col("l_suppkey") % 2 == 0), li.filter(F.col("l_suppkey") % 2 == 1)


@query(
    "prevalence_diff",
    f"""with p as (select {_HALF} as a, avg((l_returnflag = 'R')::int) r, avg((l_linestatus = 'F')::int) f, avg((l_quantity > 40)::int) q from lineitem group by 1)
    select round((abs(x.r - y.r) + abs(x.f - y.f) + abs(x.q - y.q)) / 3, 9) as apd from p x, p y where x.a and not y.a""",
)
def _(t):
    def flags(d):
        return d.select((F.col("l_returnflag") == "R").cast("int").alias("r"), (F.col("l_linestatus") == "F").cast("int").alias("f"), (F.col("l_quantity") > 40).cast("int").alias("q"))

    a, b = halves(t)
    return Y.prevalence_diff(flags(a), flags(b), ["r", "f", "q"]).select(r("apd", 9))


def _w1(c):
    return f"""(with g as (select {c} as v, count(*) filter ({_HALF}) as a, count(*) filter (not ({_HALF})) as b from lineitem group by 1),
      c as (select v, sum(a) over (order by v)::double / sum(a) over () as fa, sum(b) over (order by v)::double / sum(b) over () as fb, lead(v) over (order by v) as nx from g)
      select sum(abs(fa - fb) * (nx - v)) from c where nx is not null)"""


@query(
    "wasserstein_1d",
    f"select 'l_extendedprice' as column_name, round({_w1('l_extendedprice')}, 6) as distance union all select 'l_discount', round({_w1('l_discount')}, 9)",
)
def _(t):
    a, b = halves(t)
    w = Y.wasserstein_1d(a, b, "l_extendedprice").select(F.lit("l_extendedprice").alias("column_name"), F.round("distance", 6).alias("distance"))
    return w.unionByName(Y.wasserstein_1d(a, b, "l_discount").select(F.lit("l_discount").alias("column_name"), F.round("distance", 9).alias("distance")))


_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "corr_diff",
    "select round(avg(d) * 100, 6) as score from (" + " union all ".join(
        f"select abs(corr({a}, {b}) filter ({_HALF}) - corr({a}, {b}) filter (not ({_HALF}))) as d from lineitem" if a != b else "select 0.0::double as d" for a in _NUM for b in _NUM
    ) + ")",
)
def _(t):
    a, b = halves(t)
    return Y.corr_diff(a, b, _NUM).select(r("score"))


@query(
    "abundance_distance",
    f"""with c as (select {_HALF} as a, (l_returnflag = 'R')::int + (l_linestatus = 'F')::int + (l_quantity > 40)::int + (l_tax > 0.05)::int as k from lineitem),
    h as (select k, count(*) filter (a) / (select count(*) from c where a)::double as pa, count(*) filter (not a) / (select count(*) from c where not a)::double as pb from c group by 1)
    select round(sum(abs(pa - pb)) / 2, 9) as distance from h""",
)
def _(t):
    def n(d):
        return d.select(*[c.cast("int").alias(x) for x, c in {"a": F.col("l_returnflag") == "R", "b": F.col("l_linestatus") == "F", "c": F.col("l_quantity") > 40, "d": F.col("l_tax") > 0.05}.items()])

    a, b = halves(t)
    return Y.abundance_distance(n(a), n(b), ["a", "b", "c", "d"]).select(r("distance", 9))


@query(
    "temporal_coherence",
    """with d as (select user_id, date_trunc('day', ts) as day, avg(value) filter (event_type = 'view') as v1, stddev_pop(value) as v2, avg(value) filter (event_type = 'error') as e1, max(value) as e2 from events group by 1, 2)
    select round((abs(corr(v1, v2) filter (user_id % 2 = 0) - corr(v1, v2) filter (user_id % 2 = 1)) + abs(corr(e1, e2) filter (user_id % 2 = 0) - corr(e1, e2) filter (user_id % 2 = 1))) / 2, 6) as gap from d""",
)
def _(t):
    e = t("events")
    day = F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")
    k, v = F.col("event_type"), F.col("value")
    d = e.groupBy("user_id", day).agg(
        F.avg(F.when(k == "view", v)).alias("v1"), F.stddev_pop(v).alias("v2"), F.avg(F.when(k == "error", v)).alias("e1"), F.max(v).alias("e2")
    )
    a, b = d.filter(F.col("user_id") % 2 == 0), d.filter(F.col("user_id") % 2 == 1)
    return Y.coherence(a, b, [("v1", "v2"), ("e1", "e2")]).select(r("gap"))


_VEC = "e as (select vec_id, label, embedding::double[] as v from embeddings)"


@query(
    "nearest_distance_f1",
    f"""with {_VEC}, s as (select * from e where label < 4), tg as (select *, label < 7 as member from e where label >= 4),
    d as (select t.vec_id, t.member, min(list_distance(t.v, s.v)) as dist from tg t, s group by 1, 2),
    p as (select member, dist <= (select median(dist) from d) as pred from d),
    c as (select count(*) filter (member and pred) as tp, count(*) filter (not member and pred) as fp, count(*) filter (member and not pred) as fn from p)
    select tp, fp, fn, round(2.0 * tp / (2 * tp + fp + fn), 6) as f1 from c""",
)
def _(t):
    e = t("embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    s = e.filter("label < 4")
    targets = e.filter("label >= 4").withColumn("member", F.col("label") < 7)
    near = Y.nearest(targets, s, "vec_id", "v")
    return Y.membership_f1(targets.join(near, "vec_id"), "member", "distance").select("tp", "fp", "fn", r("f1"))


@query(
    "nearest_neighbour_attribute",
    f"""with {_VEC}, s as (select * from e where vec_id % 2 = 0), tg as (select * from e where vec_id % 2 = 1),
    n as (select t.vec_id, t.label, arg_min(s.label, (list_distance(t.v, s.v), s.vec_id)) as guess from tg t, s group by 1, 2),
    c as (select (label > 4) as y, (guess > 4) as g from n)
    select count(*) filter (y and g) as tp, count(*) filter (not y and g) as fp, count(*) filter (y and not g) as fn, count(*) filter (not y and not g) as tn from c""",
)
def _(t):
    e = t("embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    s = e.filter(F.col("vec_id") % 2 == 0)
    targets = e.filter(F.col("vec_id") % 2 == 1)
    near = Y.nearest(targets, s, "vec_id", "v", neighbour="near_id")
    j = targets.join(near, "vec_id").join(s.select(F.col("vec_id").alias("near_id"), F.col("label").alias("guess")), "near_id")
    y, g = F.col("label") > 4, F.col("guess") > 4
    n = lambda c: F.count(F.when(c, 1))
    return j.agg(n(y & g).alias("tp"), n(~y & g).alias("fp"), n(y & ~g).alias("fn"), n(~y & ~g).alias("tn"))


@query(
    "marginal_impute",
    f"""with v as (select l_orderkey * 100000000 + l_partkey * 1000 + l_suppkey * 10 + l_linenumber as id, l_quantity, case when l_partkey % 4 <> 0 then l_discount end as x from lineitem),
    u as (select id, min(x) as x from v group by 1),
    o as (select x, row_number() over (order by {_hash("'imp'", 'id')}, id) as k from u where x is not null),
    m as (select id, floor({_hash("'0x'", 'id')} * (select count(*) from o))::bigint + 1 as k from u where x is null)
    select u.id, coalesce(u.x, o.x) as x from u left join m on u.id = m.id left join o on m.k = o.k""",
)
def _(t):
    ident = F.col("l_orderkey") * 100000000 + F.col("l_partkey") * 1000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")
    x = F.when(F.col("l_partkey") % 4 != 0, F.col("l_discount"))
    d = t("lineitem").select(ident.alias("id"), x.alias("x")).groupBy("id").agg(F.min("x").alias("x"))
    return S.marginal_impute(d, ["x"], "id", 0)
