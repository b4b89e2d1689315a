"""Organ failure, severity scores and sepsis tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardspan.functions.codes import prefix_flag
from wardspan.functions.compat import all_present, date_diff_boundaries, epoch_s, epoch_us, greatest_strict
from wardspan.functions.scoring import cases, logistic, meld, score_bands, total
from wardspan.operators import joins as J
from wardspan.operators.scan import rolling_range, rolling_rows, row_numbers, time_bucket
from wardspan.operators.windows import hour_bucket
from wardspan.plans.concepts.registry import Catalog, concept


def keyed(c: Catalog) -> DataFrame:
    return c("icustays").select("subject_id", "hadm_id", "stay_id")


# --- kidney ---------------------------------------------------------------------------


@concept("kdigo_creatinine")
def _(c: Catalog):
    v = F.col("valuenum")
    le = c("labevents").filter((F.col("itemid") == 50912) & (v <= 150)).select("subject_id", "charttime", "valuenum")
    ie = c("icustays").select("subject_id", "hadm_id", "stay_id", "intime", "outtime")
    span = ie.withColumn("__lo", F.expr("intime - interval 7 days")).drop("intime")
    hit = J.point_in_interval(le, span, ["subject_id"], "charttime", "__lo", "outtime", (True, True), width_s=7 * 86400)
    cr = hit.groupBy("hadm_id", "stay_id", "charttime").agg(F.avg("valuenum").alias("creat"))
    day = 86_400_000_000
    low = F.min("creat")
    frames = {"creat_low_past_48hr": (low, -2 * day, -1), "creat_low_past_7day": (low, -7 * day, -1)}
    cr = rolling_range(cr, ["stay_id"], epoch_us("charttime"), 0, 0, frames)
    # a stay without any value keeps one empty row
    none = ie.select("hadm_id", "stay_id").join(cr.select("stay_id").distinct(), "stay_id", "left_anti")
    return cr.unionByName(none, allowMissingColumns=True)


@concept("kdigo_stages")
def _(c: Catalog):
    cr, low7, low48 = F.col("creat"), F.col("creat_low_past_7day"), F.col("creat_low_past_48hr")
    crt = c("kdigo_creatinine").select(
        "stay_id", "charttime", "creat_low_past_7day", "creat_low_past_48hr", "creat",
        cases(
            (cr >= low7 * 3.0, 3), ((cr >= 4) & ((cr >= low48 + 0.3) | (cr >= 1.5 * low7)), 3), (cr >= low7 * 2.0, 2),
            (cr >= low48 + 0.3, 1), (cr >= low7 * 1.5, 1),
        ).alias("aki_stage_creat"),
    )
    uo = c("kdigo_uo").join(c("icustays").select("stay_id", "intime"), "stay_id")
    r6, r12, r24 = (F.col(f"uo_rt_{h}hr") for h in (6, 12, 24))
    t6, t12, t24 = (F.col(f"uo_tm_{h}hr") for h in (6, 12, 24))
    stage_uo = F.when(
        r6.isNotNull(),
        cases(
            (F.col("charttime") <= F.expr("intime + interval 6 hours"), 0), ((t24 >= 24) & (r24 < 0.3), 3),
            ((t12 >= 12) & (r12 == 0), 3), ((t12 >= 12) & (r12 < 0.5), 2), ((t6 >= 6) & (r6 < 0.5), 1),
        ),
    )
    uot = uo.select("stay_id", "charttime", "uo_rt_6hr", "uo_rt_12hr", "uo_rt_24hr", stage_uo.alias("aki_stage_uo"))
    crrt = c("crrt").filter(F.col("crrt_mode").isNotNull()).select("stay_id", "charttime", F.lit(3).alias("aki_stage_crrt"))
    key = ["stay_id", "charttime"]
    known = lambda d: d.filter(F.col("charttime").isNotNull())
    # the union of the three timelines with their columns side by side
    tm = reduce(lambda a, b: J.full_merge(a, b, key), [known(crt), known(uot), known(crrt)])
    # stays without any time, and empty creatinine rows, keep one row with no time
    empty = keyed(c).select("stay_id").join(tm.select("stay_id").distinct(), "stay_id", "left_anti")
    blank = crt.filter(F.col("charttime").isNull()).select("stay_id").join(tm.select("stay_id").distinct(), "stay_id", "left_semi")
    tm = tm.unionByName(empty.unionByName(blank).distinct(), allowMissingColumns=True)
    tm = tm.join(c("icustays").select("subject_id", "hadm_id", "stay_id", "intime"), "stay_id")
    zero = F.lit(0)
    stage = greatest_strict(*[F.coalesce(f"aki_stage_{x}", zero) for x in ("creat", "uo", "crrt")])
    tm = tm.withColumn("aki_stage", stage)
    at = epoch_s("charttime") - epoch_s("intime")
    timed = rolling_range(
        tm.filter(F.col("charttime").isNotNull()), ["subject_id"], at, -21600, 0, {"aki_stage_smoothed": F.max("aki_stage")}
    )
    untimed = tm.filter(F.col("charttime").isNull())
    # rows without a time are peers of each other: each sees the highest of them
    peak = untimed.groupBy("subject_id").agg(F.max("aki_stage").alias("aki_stage_smoothed"))
    out = timed.unionByName(untimed.join(peak, "subject_id"))
    return out.select(
        "subject_id", "hadm_id", "stay_id", "charttime", "creat_low_past_7day", "creat_low_past_48hr", "creat", "aki_stage_creat",
        "uo_rt_6hr", "uo_rt_12hr", "uo_rt_24hr", "aki_stage_uo", "aki_stage_crrt", "aki_stage", "aki_stage_smoothed",
    )


@concept("meld")
def _(c: Catalog):
    d = keyed(c).join(
        c("first_day_lab").select("stay_id", "creatinine_max", "bilirubin_total_max", "inr_max", "sodium_min"), "stay_id", "left"
    ).join(c("first_day_rrt").select("stay_id", F.col("dialysis_present").alias("rrt")), "stay_id", "left")
    first, full = meld(F.col("creatinine_max"), F.col("bilirubin_total_max"), F.col("inr_max"), F.col("sodium_min"), F.col("rrt"))
    return d.select(
        "subject_id", "hadm_id", "stay_id", first.alias("meld_initial"), full.alias("meld"), "rrt", "creatinine_max",
        "bilirubin_total_max", "inr_max", "sodium_min",
    )


# --- shared pieces of the scores ----------------------------------------------------------


def gas_in_stay(c: Catalog) -> DataFrame:
    """Blood gases of the admission taken during each stay."""
    ie = c("icustays").select("hadm_id", "stay_id", "intime", "outtime")
    bg = c("bg").drop("subject_id")
    out = J.point_in_interval(bg, ie, ["hadm_id"], "charttime", "intime", "outtime", (True, False), width_s=7 * 86400)
    return out.drop("intime", "outtime")


def with_invasive(c: Catalog, points: DataFrame, closed=(True, True)) -> DataFrame:
    """Adds whether the point lies in an episode of invasive ventilation of its stay."""
    vent = c("ventilation").filter(F.col("ventilation_status") == "InvasiveVent")
    vent = vent.select("stay_id", F.col("starttime").alias("__vs"), F.col("endtime").alias("__ve"))
    keys = points.select("stay_id", "charttime").distinct()
    hit = J.point_in_interval(keys, vent, ["stay_id"], "charttime", "__vs", "__ve", closed, "left_semi")
    out = points.join(hit.withColumn("__v", F.lit(1)), ["stay_id", "charttime"], "left")
    return out.withColumn("vent", F.coalesce("__v", F.lit(0))).drop("__v")


def vent_first_day(c: Catalog) -> DataFrame:
    """1 where invasive ventilation touches the first 24 hours of the stay."""
    vent = c("ventilation").filter(F.col("ventilation_status") == "InvasiveVent").select("stay_id", "starttime", "endtime")
    ie = c("icustays").select("stay_id", "intime").withColumn("__hi", F.expr("intime + interval 1 day"))
    hit = J.overlaps(ie, vent, ["stay_id"], ("intime", "__hi"), ("starttime", "endtime"), closed=True, width_s=30 * 86400)
    hit = hit.select("stay_id").distinct().withColumn("vent", F.lit(1))
    return ie.select("stay_id").join(hit, "stay_id", "left").withColumn("vent", F.coalesce("vent", F.lit(0)))


# Organ bands shared by both forms of the organ score
PLATELET = [(20, 4), (50, 3), (100, 2), (150, 1), (None, 0)]
BILIRUBIN = [(12.0, 4), (6.0, 3), (2.0, 2), (1.2, 1), (None, 0)]


def organ_scores(pf_vent: Column, pf_none: Column, platelet, bili, mbp, gcs, creat, urine, rates: dict[str, Column], hourly: bool):
    """Six organ scores. The hourly form also grades a ventilated ratio in the two lowest bands."""
    rows = [(pf_vent < 100, 4), (pf_vent < 200, 3), (pf_none < 300, 2)]
    rows += [(pf_vent < 300, 2)] if hourly else []
    rows += [(pf_none < 400, 1)]
    rows += [(pf_vent < 400, 1)] if hourly else []
    dop, epi, nor, dob = (rates[k] for k in ("dopamine", "epinephrine", "norepinephrine", "dobutamine"))
    some = F.coalesce(mbp, dop, dob, epi, nor)
    cardio = [
        ((dop > 15) | (epi > 0.1) | (nor > 0.1), 4), ((dop > 5) | (epi <= 0.1) | (nor <= 0.1), 3), ((dop > 0) | (dob > 0), 2), (mbp < 70, 1),
    ]
    renal = [
        (creat >= 5.0, 4), (urine < 200, 4), (creat >= 3.5, 3), (urine < 500, 3), (creat >= 2.0, 2), (creat >= 1.2, 1),
    ]
    return {
        "respiration": cases(*rows, (F.coalesce(pf_vent, pf_none).isNull(), None)),
        "coagulation": score_bands(platelet, PLATELET, "<"),
        "liver": score_bands(bili, BILIRUBIN, ">="),
        "cardiovascular": cases(*cardio, (some.isNull(), None)),
        "cns": F.when(gcs < 6, 4).when(gcs.between(6, 9), 3).when(gcs.between(10, 12), 2).when(gcs.between(13, 14), 1).when(gcs.isNotNull(), 0),
        "renal": cases(*renal, (F.coalesce(urine, creat).isNull(), None)),
    }


ORGANS = ["respiration", "coagulation", "liver", "cardiovascular", "cns", "renal"]
PRESSORS = {"norepinephrine": 221906, "epinephrine": 221289, "dopamine": 221662, "dobutamine": 221653}


def pressor_rows(c: Catalog) -> DataFrame:
    from wardspan.plans.concepts.base import infusions

    agent = F.lit(None).cast("string")
    for n, i in PRESSORS.items():
        agent = F.when(F.col("itemid") == i, n).otherwise(agent)
    return infusions(c, list(PRESSORS.values())).select("stay_id", "starttime", "endtime", "vaso_rate", agent.alias("agent"))


def pressor_maxima() -> list[Column]:
    return [F.max(F.when(F.col("agent") == n, F.col("vaso_rate"))).alias(f"rate_{n}") for n in PRESSORS]


def pressor_cols() -> dict[str, Column]:
    return {n: F.col(f"rate_{n}") for n in PRESSORS}


@concept("first_day_sofa")
def _(c: Catalog):
    ie = c("icustays").select("stay_id", "intime")
    vaso = J.window_agg(
        ie, pressor_rows(c).select("stay_id", "starttime", "vaso_rate", "agent"), ["stay_id"], "intime", "starttime", "6 hours",
        "1 day", pressor_maxima(),
    ).drop("intime")
    span = c("icustays").select("subject_id", "stay_id", F.expr("intime - interval 6 hours").alias("__lo"), F.expr("intime + interval 1 day").alias("__hi"))
    art = c("bg").filter(F.col("specimen") == "ART.").select("subject_id", "charttime", "pao2fio2ratio")
    art = J.point_in_interval(art, span, ["subject_id"], "charttime", "__lo", "__hi", (True, True))
    pf = with_invasive(c, art.select("stay_id", "charttime", "pao2fio2ratio")).groupBy("stay_id").agg(
        F.min(F.when(F.col("vent") == 0, F.col("pao2fio2ratio"))).alias("pf_none"),
        F.min(F.when(F.col("vent") == 1, F.col("pao2fio2ratio"))).alias("pf_vent"),
    )
    d = keyed(c).join(vaso, "stay_id", "left").join(pf, "stay_id", "left")
    d = d.join(c("first_day_vitalsign").select("stay_id", "mbp_min"), "stay_id", "left")
    d = d.join(c("first_day_lab").select("stay_id", "creatinine_max", "bilirubin_total_max", "platelets_min"), "stay_id", "left")
    d = d.join(c("first_day_urine_output").select("stay_id", "urineoutput"), "stay_id", "left")
    d = d.join(c("first_day_gcs").select("stay_id", "gcs_min"), "stay_id", "left")
    parts = organ_scores(
        F.col("pf_vent"), F.col("pf_none"), F.col("platelets_min"), F.col("bilirubin_total_max"), F.col("mbp_min"), F.col("gcs_min"),
        F.col("creatinine_max"), F.col("urineoutput"), pressor_cols(), False,
    )
    d = d.withColumns(parts)
    return d.select("subject_id", "hadm_id", "stay_id", total(*ORGANS).alias("sofa"), *ORGANS)


@concept("sofa")
def _(c: Catalog):
    slots = c("icustay_hourly").select("stay_id", "hr", "endtime")
    # slot h ends h hours after the first full hour, which is the end time of slot 0
    base = slots.filter(F.col("hr") == 0).select("stay_id", F.col("endtime").alias("__base"))
    base = base.join(c("icustays").select("stay_id", "hadm_id", "subject_id"), "stay_id")
    last = slots.groupBy("stay_id").agg(F.max("hr").alias("__last"))
    base = base.join(last, "stay_id")

    def placed(df: DataFrame, on: str, value: str, name: str) -> DataFrame:
        d = df.filter(F.col("charttime").isNotNull() & F.col(value).isNotNull()).select(on, "charttime", F.col(value).cast("double").alias(name))
        return d.join(base.select("stay_id", on, "__base").distinct() if on != "stay_id" else base.select("stay_id", "__base"), on).select(
            "stay_id", F.ceil((epoch_us("charttime") - epoch_us("__base")) / F.lit(3.6e9)).cast("long").alias("hr"), name
        )

    uo = c("urine_output_rate")
    tm = F.col("uo_tm_24hr").cast("double")
    uo = uo.withColumn("uo_24hr", F.when((tm >= 22) & (tm <= 30), F.col("urineoutput_24hr") / tm * 24))
    art = c("bg").filter(F.col("specimen") == "ART.").select("subject_id", "charttime", "pao2fio2ratio")
    art = art.join(base.select("subject_id", "stay_id"), "subject_id")
    art = with_invasive(c, art.select("stay_id", "charttime", "pao2fio2ratio"))
    art = art.withColumns(
        {"pf_none": F.when(F.col("vent") == 0, F.col("pao2fio2ratio")), "pf_vent": F.when(F.col("vent") == 1, F.col("pao2fio2ratio"))}
    )
    # infusions cover the slots whose end lies in (start, end]
    vaso = pressor_rows(c).join(base.select("stay_id", "__base", "__last"), "stay_id")
    first = F.floor((epoch_us("starttime") - epoch_us("__base")) / F.lit(3.6e9)).cast("long") + 1
    final = F.floor((epoch_us("endtime") - epoch_us("__base")) / F.lit(3.6e9)).cast("long")
    vaso = vaso.withColumns({"__f": F.greatest(first, F.lit(-24)), "__l": F.least(final, F.col("__last"))})
    vaso = vaso.filter(F.col("__f") <= F.col("__l")).withColumn("hr", F.explode(F.sequence("__f", "__l")))
    vaso = vaso.select("stay_id", "hr", *[F.when(F.col("agent") == n, F.col("vaso_rate")).alias(f"rate_{n}") for n in PRESSORS])
    sources = [
        placed(c("vitalsign"), "stay_id", "mbp", "mbp"), placed(c("gcs"), "stay_id", "gcs", "gcs"),
        placed(c("enzyme"), "hadm_id", "bilirubin_total", "bili"), placed(c("chemistry"), "hadm_id", "creatinine", "creat"),
        placed(c("complete_blood_count"), "hadm_id", "platelet", "plt"), placed(art, "stay_id", "pf_none", "pf_none"),
        placed(art, "stay_id", "pf_vent", "pf_vent"), placed(uo, "stay_id", "uo_24hr", "uo"), vaso,
    ]
    # one stacked frame and one aggregate instead of an eight-way join on (stay, hour)
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)
    low = ["mbp", "gcs", "plt", "pf_none", "pf_vent"]
    high = ["bili", "creat", "uo", *[f"rate_{n}" for n in PRESSORS]]
    per = stacked.groupBy("stay_id", "hr").agg(*[F.min(x).alias(x) for x in low], *[F.max(x).alias(x) for x in high])
    d = slots.join(per, ["stay_id", "hr"], "left")
    parts = organ_scores(
        F.col("pf_vent"), F.col("pf_none"), F.col("plt"), F.col("bili"), F.col("mbp"), F.col("gcs"), F.col("creat"), F.col("uo"),
        pressor_cols(), True,
    )
    d = d.withColumns(parts)
    d = rolling_rows(d, ["stay_id"], ["hr"], hour_bucket("hr"), -23, 0, {f"{o}_24hours": F.max(o) for o in ORGANS})
    d = d.withColumns({f"{o}_24hours": F.coalesce(f"{o}_24hours", F.lit(0)) for o in ORGANS})
    d = d.withColumn("sofa_24hours", total(*[f"{o}_24hours" for o in ORGANS]))
    return d.filter(F.col("hr") >= 0).select(
        "stay_id", "hr", F.expr("endtime - interval 1 hour").alias("starttime"), "endtime", F.col("pf_none").alias("pao2fio2ratio_novent"),
        F.col("pf_vent").alias("pao2fio2ratio_vent"), *[f"rate_{n}" for n in ("epinephrine", "norepinephrine", "dopamine", "dobutamine")],
        F.col("mbp").alias("meanbp_min"), F.col("gcs").alias("gcs_min"), F.col("uo").alias("uo_24hr"), F.col("bili").alias("bilirubin_max"),
        F.col("creat").alias("creatinine_max"), F.col("plt").alias("platelet_min"), *ORGANS, *[f"{o}_24hours" for o in ORGANS], "sofa_24hours",
    )


@concept("sirs")
def _(c: Catalog):
    d = keyed(c).join(c("first_day_bg_art").select("stay_id", "pco2_min"), "stay_id", "left")
    d = d.join(c("first_day_vitalsign").select("stay_id", "temperature_min", "temperature_max", "heart_rate_max", "resp_rate_max"), "stay_id", "left")
    d = d.join(c("first_day_lab").select("stay_id", "wbc_min", "wbc_max", "bands_max"), "stay_id", "left")
    x = F.col
    parts = {
        "temp_score": cases((x("temperature_min") < 36.0, 1), (x("temperature_max") > 38.0, 1), (x("temperature_min").isNull(), None)),
        "heart_rate_score": cases((x("heart_rate_max") > 90.0, 1), (x("heart_rate_max").isNull(), None)),
        "resp_score": cases((x("resp_rate_max") > 20.0, 1), (x("pco2_min") < 32.0, 1), (F.coalesce("resp_rate_max", "pco2_min").isNull(), None)),
        "wbc_score": cases(
            (x("wbc_min") < 4.0, 1), (x("wbc_max") > 12.0, 1), (x("bands_max") > 10, 1), (F.coalesce("wbc_min", "bands_max").isNull(), None)
        ),
    }
    d = d.withColumns(parts)
    return d.select("subject_id", "hadm_id", "stay_id", total(*parts).alias("sirs"), *parts)


@concept("lods")
def _(c: Catalog):
    ie = c("icustays").select("stay_id", "intime").withColumn("__hi", F.expr("intime + interval 1 day"))
    mask = F.lower("value")
    ce = c("chartevents").filter((F.col("itemid") == 226732) & (mask.like("%cpap%") | mask.like("%bipap mask%"))).select("stay_id", "charttime")
    cp = J.point_in_interval(ce, ie, ["stay_id"], "charttime", "intime", "__hi", (True, True)).groupBy("stay_id").agg(
        F.expr("min(charttime) - interval 1 hour").alias("__cs"), F.expr("max(charttime) + interval 4 hours").alias("__ce")
    )
    g = with_invasive(c, gas_in_stay(c).select("stay_id", "charttime", "pao2fio2ratio")).join(cp, "stay_id", "left")
    on_mask = F.coalesce(F.col("charttime").between(F.col("__cs"), F.col("__ce")), F.lit(False))
    pf = g.filter((F.col("vent") == 1) | on_mask).groupBy("stay_id").agg(F.min("pao2fio2ratio").alias("pf"))
    d = keyed(c).join(pf, "stay_id", "left").join(c("first_day_gcs").select("stay_id", "gcs_min"), "stay_id", "left")
    d = d.join(c("first_day_vitalsign").select("stay_id", "heart_rate_max", "heart_rate_min", "sbp_max", "sbp_min"), "stay_id", "left")
    d = d.join(c("first_day_urine_output").select("stay_id", "urineoutput"), "stay_id", "left")
    labs = ["bun_max", "wbc_max", "wbc_min", "bilirubin_total_max", "creatinine_max", "pt_min", "pt_max", "platelets_min"]
    d = d.join(c("first_day_lab").select("stay_id", *labs), "stay_id", "left")
    x = F.col
    urine = x("urineoutput")
    parts = {
        "neurologic": cases(
            (x("gcs_min").isNull() | (x("gcs_min") < 3), None), (x("gcs_min") <= 5, 5), (x("gcs_min") <= 8, 3), (x("gcs_min") <= 13, 1)
        ),
        "cardiovascular": cases(
            (x("heart_rate_max").isNull() & x("sbp_min").isNull(), None), (x("heart_rate_min") < 30, 5), (x("sbp_min") < 40, 5),
            (x("sbp_min") < 70, 3), (x("sbp_max") >= 270, 3), (x("heart_rate_max") >= 140, 1), (x("sbp_max") >= 240, 1), (x("sbp_min") < 90, 1),
        ),
        "renal": cases(
            (~all_present("bun_max", "urineoutput", "creatinine_max"), None), (urine < 500.0, 5), (x("bun_max") >= 56.0, 5),
            (x("creatinine_max") >= 1.60, 3), (urine < 750.0, 3), (x("bun_max") >= 28.0, 3), (urine >= 10000.0, 3),
            (x("creatinine_max") >= 1.20, 1), (x("bun_max") >= 17.0, 1), (x("bun_max") >= 7.50, 1),
        ),
        "pulmonary": cases((x("pf").isNull(), 0), (x("pf") >= 150, 1), (x("pf") < 150, 3), otherwise=None),
        "hematologic": cases(
            (x("wbc_max").isNull() & x("platelets_min").isNull(), None), (x("wbc_min") < 1.0, 3), (x("wbc_min") < 2.5, 1),
            (x("platelets_min") < 50.0, 1), (x("wbc_max") >= 50.0, 1),
        ),
        "hepatic": cases(
            (x("pt_max").isNull() & x("bilirubin_total_max").isNull(), None), (x("bilirubin_total_max") >= 2.0, 1), (x("pt_max") > 15, 1), (x("pt_min") < 3, 1)
        ),
    }
    d = d.withColumns(parts)
    return d.select("subject_id", "hadm_id", "stay_id", total(*parts).alias("lods"), *parts)


def surgical_services(c: Catalog) -> DataFrame:
    s = c("services").select("hadm_id", "transfertime", "curr_service")
    return s.withColumn("surg", F.lower("curr_service").like("%surg%"))


@concept("oasis")
def _(c: Catalog):
    ie = c("icustays").select("subject_id", "hadm_id", "stay_id", "intime", "outtime")
    s = surgical_services(c).join(ie.select("hadm_id", "stay_id", "intime"), "hadm_id")
    s = s.filter(F.col("transfertime") < F.expr("intime + interval 1 day"))
    s = s.groupBy("stay_id").agg(F.max((F.col("surg") | (F.col("curr_service") == "ORTHO")).cast("int")).alias("surgical"))
    adm = c("admissions").select("hadm_id", "admittime", "admission_type")
    d = ie.join(adm, "hadm_id").join(c("age").select("hadm_id", "age"), "hadm_id", "left").join(s, "stay_id", "left")
    d = d.withColumn("surgical", F.coalesce("surgical", F.lit(0)))
    d = d.join(c("first_day_gcs").select("stay_id", F.col("gcs_min").alias("gcs")), "stay_id", "left")
    vit = [f"{v}_{m}" for v in ("heart_rate", "mbp", "resp_rate", "temperature") for m in ("min", "max")]
    d = d.join(c("first_day_vitalsign").select("stay_id", *vit), "stay_id", "left")
    d = d.join(c("first_day_urine_output").select("stay_id", "urineoutput"), "stay_id", "left")
    d = d.join(vent_first_day(c).withColumnRenamed("vent", "mechvent"), "stay_id", "left")
    x = F.col
    elective = F.when((x("admission_type") == "ELECTIVE") & (x("surgical") == 1), 1).when(x("admission_type").isNotNull(), 0)
    d = d.withColumns({"preiculos": date_diff_boundaries("minute", "admittime", "intime"), "electivesurgery": elective})
    hi, lo = x("heart_rate_max"), x("heart_rate_min")
    mhi, mlo = x("mbp_max"), x("mbp_min")
    rhi, rlo = x("resp_rate_max"), x("resp_rate_min")
    # temperatures are exact to two decimals, so the bounds are met in the same decimals
    thi, tlo = x("temperature_max"), x("temperature_min")
    dec = lambda v: F.lit(v).cast("decimal(10,2)")
    uo = x("urineoutput")
    # each value: ordered (condition, points, value shown); the middle of both extremes otherwise
    picks = {
        "heart_rate": (hi.isNull(), [(hi > 125, 6, hi), (lo < 33, 4, lo), (hi.between(107, 125), 3, hi), (hi.between(89, 106), 1, hi)], (lo + hi) / 2),
        "mbp": (mlo.isNull(), [(mlo < 20.65, 4, mlo), (mlo < 51, 3, mlo), (mhi > 143.44, 3, mhi), ((mlo >= 51) & (mlo < 61.33), 2, mlo)], (mlo + mhi) / 2),
        "resp_rate": (
            rlo.isNull(), [(rlo < 6, 10, rlo), (rhi > 44, 9, rhi), (rhi > 30, 6, rhi), (rhi > 22, 1, rhi), (rlo < 13, 1, rlo)], (rlo + rhi) / 2
        ),
        "temp": (
            thi.isNull(),
            [
                (thi > dec("39.88"), 6, thi), (tlo.between(dec("33.22"), dec("35.93")), 4, tlo), (thi.between(dec("33.22"), dec("35.93")), 4, thi),
                (tlo < dec("33.22"), 3, tlo), ((tlo > dec("35.93")) & (tlo <= dec("36.39")), 2, tlo), (thi.between(dec("36.89"), dec("39.88")), 2, thi),
            ],
            (tlo.cast("double") + thi.cast("double")) / 2,
        ),
    }
    scores, shown = {}, {}
    for name, (missing, rows, middle) in picks.items():
        scores[f"{name}_score"] = cases((missing, None), *[(cond, pts) for cond, pts, _ in rows])
        v = F.when(missing, F.lit(None).cast("double"))
        for cond, _, val in rows:
            v = v.when(cond, val.cast("double"))
        shown[name] = v.otherwise(middle.cast("double"))
    age, pre, gcs = x("age"), x("preiculos"), x("gcs")
    scores |= {
        "age_score": cases((age.isNull(), None), (age < 24, 0), (age <= 53, 3), (age <= 77, 6), (age <= 89, 9), (age >= 90, 7)),
        "preiculos_score": score_bands(pre, [(10.2, 5), (297, 3), (1440, 0), (18708, 2), (None, 1)], "<"),
        "gcs_score": cases((gcs.isNull(), None), (gcs <= 7, 10), (gcs < 14, 4), (gcs == 14, 3)),
        "urineoutput_score": cases(
            (uo.isNull(), None), (uo < 671.09, 10), (uo > 6896.80, 8), (uo.between(671.09, 1426.99), 5), (uo.between(1427.00, 2544.14), 1)
        ),
        "mechvent_score": cases((x("mechvent").isNull(), None), (x("mechvent") == 1, 9)),
        "electivesurgery_score": cases((x("electivesurgery").isNull(), None), (x("electivesurgery") == 1, 0), otherwise=6),
    }
    d = d.withColumns(scores).withColumn("oasis", total(*scores))
    return d.select(
        "subject_id", "hadm_id", "stay_id", "oasis", logistic("oasis", -6.1746, 0.1275).alias("oasis_prob"), "age", "age_score", "preiculos",
        "preiculos_score", "gcs", "gcs_score", shown["heart_rate"].alias("heartrate"), "heart_rate_score", shown["mbp"].alias("meanbp"), "mbp_score",
        shown["resp_rate"].alias("resprate"), "resp_rate_score", shown["temp"].alias("temp"), "temp_score", "urineoutput", "urineoutput_score",
        "mechvent", "mechvent_score", "electivesurgery", "electivesurgery_score",
    )


# Malignancy and immune codes of the simplified acute score (version 9, version 10)
SAPS_CODES = {
    "aids": ("042-044", "B20-B22 B24"),
    "hem": (
        "20000-20238 20240-20248 20250-20302 20310-20312 20302-20382 20400-20522 20580-20702 20720-20892 2386 2733", "C81-C96",
    ),
    "mets": ("1960-1991 20970-20975 20979 78951", "C77-C79 C800"),
}


@concept("sapsii")
def _(c: Catalog):
    co = c("icustays").select("subject_id", "hadm_id", "stay_id", F.col("intime").alias("starttime"))
    co = co.withColumn("endtime", F.expr("starttime + interval 24 hours"))
    x = F.col

    def first_day(events: DataFrame, on: str, aggs: list[Column]) -> DataFrame:
        span = co.select(on, "stay_id", x("starttime").alias("__s"), x("endtime").alias("__e")) if on != "stay_id" else co.select(
            "stay_id", x("starttime").alias("__s"), x("endtime").alias("__e")
        )
        ev = events.drop(*[k for k in ("stay_id", "subject_id", "hadm_id") if k != on])
        hit = J.point_in_interval(ev, span, [on], "charttime", "__s", "__e", (False, True))
        return hit.groupBy("stay_id").agg(*aggs)

    mm = lambda cols: [f(v).alias(f"{n}_{m}") for n, v in cols.items() for m, f in (("min", F.min), ("max", F.max))]
    mask = F.lower("value").rlike("cpap mask|bipap")
    ce = c("chartevents").filter((x("itemid") == 226732) & mask).select("stay_id", "charttime")
    span = co.select("stay_id", x("starttime").alias("__s"), x("endtime").alias("__e"), "subject_id")
    cp = J.point_in_interval(ce, span, ["stay_id"], "charttime", "__s", "__e", (False, True)).groupBy("subject_id", "stay_id", "__s", "__e").agg(
        F.expr("min(charttime) - interval 1 hour").alias("__a"), F.expr("max(charttime) + interval 4 hours").alias("__b")
    )
    cp = cp.select("subject_id", F.greatest("__a", "__s").alias("__cs"), F.least("__b", "__e").alias("__ce"))
    bg = c("bg").filter(x("specimen") == "ART.").select("subject_id", "charttime", "pao2fio2ratio")
    bg = J.point_in_interval(bg, span, ["subject_id"], "charttime", "__s", "__e", (False, True)).select("subject_id", "stay_id", "charttime", "pao2fio2ratio")
    bg = with_invasive(c, bg, (False, True))
    keys = bg.select("subject_id", "charttime").distinct()
    on_mask = J.point_in_interval(keys, cp, ["subject_id"], "charttime", "__cs", "__ce", (False, True), "left_semi").withColumn("__m", F.lit(1))
    bg = bg.join(on_mask, ["subject_id", "charttime"], "left")
    pf = bg.filter((x("vent") == 1) | x("__m").isNotNull()).groupBy("stay_id").agg(F.min("pao2fio2ratio").alias("pf"))
    sv = surgical_services(c)
    first_service = sv.groupBy("hadm_id").agg(F.min_by(x("surg").cast("int"), F.struct("transfertime", "curr_service")).alias("surgical"))
    dx = c("diagnoses_icd").groupBy("hadm_id").agg(
        *[F.max(prefix_flag(x("icd_code"), x("icd_version"), n, t)).alias(k) for k, (n, t) in SAPS_CODES.items()]
    )
    d = co.join(c("admissions").select("hadm_id", "admission_type"), "hadm_id").join(c("age").select("hadm_id", "age"), "hadm_id", "left")
    d = d.join(pf, "stay_id", "left").join(first_service, "hadm_id", "left").join(dx, "hadm_id", "left")
    d = d.join(first_day(c("gcs"), "stay_id", [F.min("gcs").alias("mingcs")]), "stay_id", "left")
    d = d.join(first_day(c("vitalsign"), "subject_id", mm({"hr": "heart_rate", "sbp": "sbp", "temp": "temperature"})), "stay_id", "left")
    d = d.join(first_day(c("urine_output"), "stay_id", [F.sum("urineoutput").alias("uo")]), "stay_id", "left")
    d = d.join(first_day(c("chemistry"), "subject_id", mm({k: k for k in ("bun", "potassium", "sodium", "bicarbonate")})), "stay_id", "left")
    d = d.join(first_day(c("complete_blood_count"), "subject_id", mm({"wbc": "wbc"})), "stay_id", "left")
    d = d.join(first_day(c("enzyme"), "subject_id", mm({"bilirubin": "bilirubin_total"})), "stay_id", "left")
    kind = F.when((x("admission_type") == "ELECTIVE") & (x("surgical") == 1), 0).when((x("admission_type") != "ELECTIVE") & (x("surgical") == 1), 8).otherwise(6)
    has = lambda v: (x(v).isNull(), None)
    inside = lambda n, lo, hi: (x(f"{n}_max") >= lo) & (x(f"{n}_max") < hi) & (x(f"{n}_min") >= lo) & (x(f"{n}_min") < hi)
    parts = {
        "age_score": score_bands("age", [(40, 0), (60, 7), (70, 12), (75, 15), (80, 16), (None, 18)], "<"),
        "hr_score": cases(has("hr_max"), (x("hr_min") < 40, 11), (x("hr_max") >= 160, 7), (x("hr_max") >= 120, 4), (x("hr_min") < 70, 2), (inside("hr", 70, 120), 0), otherwise=None),
        "sysbp_score": cases(has("sbp_min"), (x("sbp_min") < 70, 13), (x("sbp_min") < 100, 5), (x("sbp_max") >= 200, 2), (inside("sbp", 100, 200), 0), otherwise=None),
        "temp_score": cases(has("temp_max"), (x("temp_max") >= 39.0, 3), (x("temp_min") < 39.0, 0), otherwise=None),
        "pao2fio2_score": score_bands("pf", [(100, 11), (200, 9), (None, 6)], "<"),
        "uo_score": score_bands("uo", [(500.0, 11), (1000.0, 4), (None, 0)], "<"),
        "bun_score": score_bands("bun_max", [(28.0, 0), (84.0, 6), (None, 10)], "<"),
        "wbc_score": cases(has("wbc_max"), (x("wbc_min") < 1.0, 12), (x("wbc_max") >= 20.0, 3), (inside("wbc", 1.0, 20.0), 0), otherwise=None),
        "potassium_score": cases(has("potassium_max"), (x("potassium_min") < 3.0, 3), (x("potassium_max") >= 5.0, 3), (inside("potassium", 3.0, 5.0), 0), otherwise=None),
        "sodium_score": cases(has("sodium_max"), (x("sodium_min") < 125, 5), (x("sodium_max") >= 145, 1), (inside("sodium", 125, 145), 0), otherwise=None),
        "bicarbonate_score": cases(has("bicarbonate_max"), (x("bicarbonate_min") < 15.0, 6), (x("bicarbonate_min") < 20.0, 3), otherwise=0),
        "bilirubin_score": score_bands("bilirubin_max", [(4.0, 0), (6.0, 4), (None, 9)], "<"),
        "gcs_score": cases(
            (x("mingcs").isNull() | (x("mingcs") < 3), None), (x("mingcs") < 6, 26), (x("mingcs") < 9, 13), (x("mingcs") < 11, 7), (x("mingcs") < 14, 5),
            (x("mingcs") <= 15, 0), otherwise=None,
        ),
        "comorbidity_score": cases((x("aids") == 1, 17), (x("hem") == 1, 10), (x("mets") == 1, 9)),
        "admissiontype_score": kind,
    }
    d = d.withColumns(parts).withColumn("sapsii", total(*parts))
    return d.select(
        "subject_id", "hadm_id", "stay_id", "starttime", "endtime", "sapsii", logistic("sapsii", -7.7631, 0.0737, 0.9971).alias("sapsii_prob"), *parts
    )


# Bands of the physiology score, (upper bound exclusive, points); reference point last
APS_BANDS = {
    "hr": ("heart_rate", [(40, 8), (50, 5), (100, 0), (110, 1), (120, 5), (140, 7), (155, 13), (None, 17)], 75),
    "mbp": ("mbp", [(40, 23), (60, 15), (70, 7), (80, 6), (100, 0), (120, 4), (130, 7), (140, 9), (None, 10)], 90),
    "temp": ("temperature", [("33.0", 20), ("33.5", 16), ("34.0", 13), ("35.0", 8), ("36.0", 2), ("40.0", 0), (None, 4)], 38),
    "resp_rate": ("resp_rate", [(6, 17), (12, 8), (14, 7), (25, 0), (35, 6), (40, 9), (50, 11), (None, 18)], 19),
    "hematocrit": ("hematocrit", [(41.0, 3), (50.0, 0), (None, 3)], 45.5),
    "wbc": ("wbc", [(1.0, 19), (3.0, 5), (20.0, 0), (25.0, 1), (None, 5)], 11.5),
    "creatinine": ("creatinine", [(0.5, 3), (1.5, 0), (1.95, 4), (None, 7)], 1),
    "bun": ("bun", [(17.0, 0), (20.0, 2), (40.0, 7), (80.0, 11), (None, 12)], None),
    "sodium": ("sodium", [(120, 3), (135, 2), (155, 0), (None, 4)], 145.5),
    "albumin": ("albumin", [(2.0, 11), (2.5, 6), (4.5, 0), (None, 4)], 3.5),
    "bilirubin": ("bilirubin_total", [(2.0, 0), (3.0, 5), (5.0, 6), (8.0, 8), (None, 16)], None),
    "glucose": ("glucose", [(40, 8), (60, 9), (200, 0), (350, 3), (None, 5)], 130),
}
URINE_BANDS = [(400, 15), (600, 8), (900, 7), (1500, 5), (2000, 4), (4000, 0), (None, 1)]
PAO2_BANDS = [(50, 15), (70, 5), (80, 2), (None, 0)]
AADO2_BANDS = [(100, 0), (250, 7), (350, 9), (500, 11), (None, 14)]
# acidity bands: upper pH bound, then (upper carbon-dioxide bound, points)
ACID_BANDS = [
    (7.20, [(50, 12), (None, 4)]), (7.30, [(30, 9), (40, 6), (50, 3), (None, 2)]), (7.35, [(30, 9), (45, 0), (None, 1)]),
    (7.45, [(30, 5), (45, 0), (None, 1)]), (7.50, [(30, 5), (35, 0), (45, 2), (None, 12)]), (7.60, [(40, 3), (None, 12)]),
    (None, [(25, 0), (40, 3), (None, 12)]),
]


def acid_base(ph: Column, co2: Column) -> Column:
    out = F.when(ph.isNull() | co2.isNull(), F.lit(None).cast("int"))
    for bound, bands in ACID_BANDS:
        inner = score_bands(co2, bands, "<")
        if bound is None:
            return out.otherwise(inner)
        out = out.when(ph < bound, inner)
    return out


def coma_points(eyes: Column, verbal: Column, motor: Column, unable: Column) -> Column:
    low, mid, good = motor.isin(1, 2), motor.isin(3, 4), motor.isin(5, 6)
    v1, v23 = verbal == 1, verbal.isin(2, 3)
    shut = cases((v1 & low, 48), (v1 & mid, 33), (v1 & good, 16), (v23 & low, 29), (v23 & mid, 24), otherwise=None)
    opened = cases(
        (v1 & low, 29), (v1 & mid, 24), (v1 & good, 15), (v23 & low, 29), (v23 & mid, 24), (v23 & (motor == 5), 13), (v23 & (motor == 6), 10),
        ((verbal == 4) & motor.between(1, 4), 13), ((verbal == 4) & (motor == 5), 8), ((verbal == 4) & (motor == 6), 3),
        ((verbal == 5) & motor.between(1, 5), 3), ((verbal == 5) & (motor == 6), 0), otherwise=None,
    )
    return F.when(unable == 1, 0).when(eyes == 1, shut).when(eyes > 1, opened)


@concept("apsiii")
def _(c: Catalog):
    x = F.col
    art = gas_in_stay(c).filter(x("specimen") == "ART.")
    art = with_invasive(c, art)
    share = F.coalesce("fio2", "fio2_chartevents")
    gas = art.groupBy("stay_id").agg(
        F.max(F.when((x("vent") == 0) & (F.coalesce(share, F.lit(21.0)) < 50), x("po2"))).alias("pao2"),
        F.max(F.when((x("vent") == 1) & (share >= 50), x("aado2"))).alias("aado2"),
        F.max(acid_base(x("ph"), x("pco2"))).alias("acidbase_score"),
    )
    d = keyed(c).join(c("admissions").select("hadm_id"), "hadm_id").join(gas, "stay_id", "left")
    vit = [f"{v}_{m}" for v in ("heart_rate", "mbp", "temperature", "resp_rate") for m in ("min", "max")]
    v = c("first_day_vitalsign").select("stay_id", *vit, x("glucose_min").alias("vg_min"), x("glucose_max").alias("vg_max"))
    labs = ["hematocrit", "wbc", "creatinine", "bun", "sodium", "albumin", "bilirubin_total", "glucose"]
    lab = c("first_day_lab").select("stay_id", *[f"{n}_{m}" for n in labs for m in ("min", "max")])
    d = d.join(v, "stay_id", "left").join(lab, "stay_id", "left")
    d = d.join(c("first_day_urine_output").select("stay_id", "urineoutput"), "stay_id", "left")
    d = d.join(c("first_day_gcs").drop("subject_id"), "stay_id", "left").join(vent_first_day(c), "stay_id", "left")
    late = prefix_flag(x("icd_code"), x("icd_version"), "5854 5855 5856", "N184 N185 N186")
    d = d.join(c("diagnoses_icd").groupBy("hadm_id").agg(F.max(late).alias("ckd")), "hadm_id", "left")
    arf = (x("creatinine_max") >= 1.5) & (x("urineoutput") < 410) & (x("ckd") == 0)
    d = d.withColumns(
        {
            "arf": F.coalesce(arf, F.lit(False)), "glucose_max": F.greatest("glucose_max", "vg_max"),
            "glucose_min": F.least("glucose_min", "vg_min"),
        }
    )

    def banded(name: str, src: Column) -> Column:
        bands = APS_BANDS[name][1]
        if name == "temp":
            bands = [(F.lit(b).cast("decimal(10,2)") if b else None, s) for b, s in bands]
        out = score_bands(src, bands, "<")
        if name == "resp_rate":
            out = F.when((x("vent") == 1) & (src < 14), 0).otherwise(out)
        if name == "creatinine":
            out = F.when(x("arf") & (src < 1.5), 0).when(x("arf") & (src >= 1.5), 10).otherwise(out)
        return out

    scores = {}
    for name, (src, _, ref) in APS_BANDS.items():
        hi, lo = x(f"{src}_max"), x(f"{src}_min")
        top, low = banded(name, hi), banded(name, lo)
        if ref is None:
            scores[f"{name}_score"] = F.when(hi.isNotNull(), top)
            continue
        far_hi, far_lo = F.abs(hi - ref), F.abs(lo - ref)
        pick = F.when(far_hi > far_lo, top).when(far_hi < far_lo, low).otherwise(F.greatest(top, low))
        if name == "creatinine":
            pick = F.when(x("arf"), top).otherwise(pick)
        scores[f"{name}_score"] = F.when(hi.isNotNull(), pick)
    scores |= {
        "uo_score": score_bands("urineoutput", URINE_BANDS, "<"),
        "gcs_score": coma_points(x("gcs_eyes"), x("gcs_verbal"), x("gcs_motor"), x("gcs_unable")),
        "pao2_aado2_score": F.when(x("pao2").isNotNull(), score_bands("pao2", PAO2_BANDS, "<")).otherwise(score_bands("aado2", AADO2_BANDS, "<")),
    }
    order = ["hr", "mbp", "temp", "resp_rate", "pao2_aado2", "hematocrit", "wbc", "creatinine", "uo", "bun", "sodium", "albumin", "bilirubin", "glucose", "acidbase", "gcs"]
    cols = [f"{n}_score" for n in order]
    d = d.withColumns(scores).withColumn("apsiii", total(*cols))
    return d.select("subject_id", "hadm_id", "stay_id", "apsiii", logistic("apsiii", -4.4360, 0.04726).alias("apsiii_prob"), *cols)


# --- sepsis ------------------------------------------------------------------------------------


@concept("suspicion_of_infection")
def _(c: Catalog):
    x = F.col
    ab = c("antibiotic").select("subject_id", "hadm_id", "stay_id", "antibiotic", "starttime", "stoptime", "route")
    ab = row_numbers(ab, ["subject_id"], ["starttime", "stoptime", "antibiotic", "hadm_id", "stay_id", "route"], F.coalesce(time_bucket("starttime", 30 * 86400), F.lit(-(2**40))), "ab_id")
    ab = ab.withColumnRenamed("starttime", "antibiotic_time")
    org = x("org_name")
    positive = org.isNotNull() & ~x("org_itemid").isin(90856, 90760) & (org != "") & (org != "CANCELLED")
    me = c("microbiologyevents").groupBy("micro_specimen_id").agg(
        F.max("subject_id").alias("subject_id"), F.max(F.date_trunc("day", "chartdate").cast("timestamp_ntz")).alias("chartdate"),
        F.max("charttime").alias("mtime"), F.max("spec_type_desc").alias("specimen"),
        F.max(F.coalesce(positive, F.lit(False)).cast("int")).alias("positive"),
    )
    # first match: earliest day, timed before untimed, positive before negative, smallest specimen
    me = me.withColumn("rank_id", F.struct((-x("positive")).alias("n"), x("micro_specimen_id").alias("m")))
    me = me.withColumn("payload", F.struct("rank_id", "chartdate", "mtime", "specimen", "positive"))
    out = J.asof_either_payload(
        ab, me, ["subject_id"], "antibiotic_time", "mtime", "chartdate", "payload", before=(72, 3), after=(24, 1), names=("prior", "later")
    )
    when = lambda p: F.coalesce(x(f"{p}.mtime"), x(f"{p}.chartdate"))
    none = x("prior.specimen").isNull() & x("later.specimen").isNull()
    return out.select(
        "subject_id", "stay_id", "hadm_id", "ab_id", "antibiotic", "antibiotic_time",
        F.when(none, 0).otherwise(1).alias("suspected_infection"),
        F.when(~none, F.coalesce(when("prior"), x("antibiotic_time"))).alias("suspected_infection_time"),
        F.coalesce(when("prior"), when("later")).alias("culture_time"), F.coalesce("prior.specimen", "later.specimen").alias("specimen"),
        F.coalesce("prior.positive", "later.positive").alias("positive_culture"),
    )


@concept("sepsis3")
def _(c: Catalog):
    x = F.col
    s = c("sofa").filter(x("sofa_24hours") >= 2).select(
        "stay_id", x("endtime").alias("sofa_time"), x("sofa_24hours").alias("sofa_score"), *[x(f"{o}_24hours").alias(o) for o in ORGANS]
    )
    soi = c("suspicion_of_infection").filter(x("stay_id").isNotNull() & x("suspected_infection_time").isNotNull())
    soi = soi.select("subject_id", "stay_id", "antibiotic_time", "culture_time", "suspected_infection_time", "suspected_infection")
    # only the earliest suspicion with a qualifying score matters, so the first score in each window is enough
    soi = soi.withColumn("__from", F.expr("suspected_infection_time - interval 48 hours"))
    cols = ["sofa_time", "sofa_score", *ORGANS]
    hit = J.asof_latest(soi, s, ["stay_id"], "__from", "sofa_time", cols, 72 * 3600, direction="forward")
    hit = hit.filter(x("sofa_time").isNotNull())
    rest = ["antibiotic_time", "culture_time", "suspected_infection_time", *cols, "suspected_infection"]
    first = F.min_by(F.struct("subject_id", *rest), F.struct("suspected_infection_time", "antibiotic_time", "culture_time", "sofa_time")).alias("s")
    out = hit.groupBy("stay_id").agg(first).select("stay_id", "s.*")
    return out.select(
        "subject_id", "stay_id", "antibiotic_time", "culture_time", "suspected_infection_time", "sofa_time", "sofa_score", *ORGANS,
        ((x("sofa_score") >= 2) & (x("suspected_infection") == 1)).alias("sepsis3"),
    )

