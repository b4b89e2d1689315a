"""Demographic, measurement and medication tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardspan.functions import compat
from wardspan.functions.codes import contains_any, prefix_flag
from wardspan.functions.compat import date_diff_boundaries, epoch_s, round_dec
from wardspan.functions.scoring import gas_ratios, mdrd_creatinine
from wardspan.operators import intervals as I
from wardspan.operators import joins as J
from wardspan.operators import windows as W
from wardspan.operators.pivot import item, pivot_items, rank_pivot
from wardspan.operators.scan import prefix_scan, rolling_range, time_bucket
from wardspan.plans.concepts.registry import Catalog, concept
from wardspan.plans.series import hourly_slots


def _specimen_keys() -> list[Column]:
    return [F.max(c).alias(c) for c in ("subject_id", "hadm_id", "charttime")]


def f64(df):
    """Charted numbers are single precision; all arithmetic is done in double."""
    return df.withColumn("valuenum", F.col("valuenum").cast("double"))


# --- demographics -----------------------------------------------------------------


@concept("icustay_times")
def _(c: Catalog):
    hr = c("chartevents").filter(F.col("itemid") == 220045).groupBy("stay_id").agg(
        F.min("charttime").alias("intime_hr"), F.max("charttime").alias("outtime_hr")
    )
    return c("icustays").select("subject_id", "hadm_id", "stay_id").join(hr, "stay_id", "left")


@concept("icustay_hourly")
def _(c: Catalog):
    return hourly_slots(c("icustay_times"), "stay_id", "intime_hr", "outtime_hr", -24).select("stay_id", "hr", "endtime")


@concept("age")
def _(c: Catalog):
    j = c("admissions").select("subject_id", "hadm_id", "admittime").join(
        c("patients").select("subject_id", "anchor_age", "anchor_year"), "subject_id"
    )
    years = F.year("admittime") - F.col("anchor_year")
    return j.withColumn("age", (F.col("anchor_age") + years).cast("long"))


@concept("icustay_detail")
def _(c: Catalog):
    adm = c("admissions").select(
        "subject_id", "hadm_id", "admittime", "dischtime", "race", "hospital_expire_flag"
    )
    year = 365 * 86400
    # ranks run over the joined rows; distinct times within the key decide them
    ie = c("icustays").select("hadm_id", "stay_id", F.col("intime").alias("icu_intime"), F.col("outtime").alias("icu_outtime"))
    with_stay = J.semi(adm, ie, ["hadm_id"])
    adm = adm.join(
        W.dense_ranks(with_stay, ["subject_id"], "admittime", time_bucket("admittime", year), "hospstay_seq").select("hadm_id", "hospstay_seq"),
        "hadm_id",
    )
    ie = W.dense_ranks(ie, ["hadm_id"], "icu_intime", time_bucket("icu_intime", year), "icustay_seq")
    j = ie.join(adm, "hadm_id").join(
        c("patients").select("subject_id", "gender", "dod", "anchor_age", "anchor_year"), "subject_id"
    )
    return j.select(
        "subject_id", "hadm_id", "stay_id", "gender", "dod", "admittime", "dischtime",
        date_diff_boundaries("day", "admittime", "dischtime").alias("los_hospital"),
        (F.col("anchor_age") + F.year("admittime") - F.col("anchor_year")).cast("long").alias("admission_age"),
        "race", "hospital_expire_flag", "hospstay_seq", (F.col("hospstay_seq") == 1).alias("first_hosp_stay"),
        "icu_intime", "icu_outtime",
        round_dec(date_diff_boundaries("hour", "icu_intime", "icu_outtime") / 24.0, 2).alias("los_icu"),
        "icustay_seq", (F.col("icustay_seq") == 1).alias("first_icu_stay"),
    )


@concept("weight_durations")
def _(c: Catalog):
    v = F.col("valuenum").cast("double")
    w = c("chartevents").filter(F.col("itemid").isin(226512, 224639) & (v > 0) & (v < 1500))
    w = w.select(
        "stay_id", "charttime", F.when(F.col("itemid") == 226512, "admit").otherwise("daily").alias("weight_type"),
        round_dec(v, 3).alias("weight"),
    )
    w = prefix_scan(
        w, ["stay_id", "weight_type"], ["charttime", "weight"], time_bucket("charttime"), {"rn": ("sum", F.lit(1))}
    )
    w = w.join(c("icustays").select("stay_id", "intime", "outtime"), "stay_id")
    first_admit = (F.col("weight_type") == "admit") & (F.col("rn") == 1)
    w = w.withColumn("starttime", F.when(first_admit, F.expr("intime - interval 2 hours")).otherwise(F.col("charttime")))
    spans = c("icustays").select("stay_id", "intime", "outtime")
    return I.tile_with_backfill(
        w.select("stay_id", "starttime", "weight", "weight_type"), spans, ["stay_id"], "starttime", "endtime",
        "intime", "outtime", "2 hours", ["weight", "weight_type"], ["starttime", "weight_type", "weight"],
    )


# --- laboratory pivots: one row per specimen -----------------------------------------

# Item codes and the upper limits a value must not exceed
CHEMISTRY = {
    "albumin": (50862, 10), "globulin": (50930, 10), "total_protein": (50976, 20), "aniongap": (50868, 10000),
    "bicarbonate": (50882, 10000), "bun": (51006, 300), "calcium": (50893, 10000), "chloride": (50902, 10000),
    "creatinine": (50912, 150), "glucose": (50931, 10000), "sodium": (50983, 200), "potassium": (50971, 30),
}
CARDIAC = {"troponin_t": 51003, "ck_mb": 50911, "ntprobnp": 50963}
COAGULATION = {"d_dimer": 51196, "fibrinogen": 51214, "thrombin": 51297, "inr": 51237, "pt": 51274, "ptt": 51275}
BLOOD_COUNT = {
    "hematocrit": 51221, "hemoglobin": 51222, "mch": 51248, "mchc": 51249, "mcv": 51250, "platelet": 51265,
    "rbc": 51279, "rdw": 51277, "rdwsd": 52159, "wbc": 51301,
}
ENZYME = {
    "alt": 50861, "alp": 50863, "ast": 50878, "amylase": 50867, "bilirubin_total": 50885, "bilirubin_direct": 50883,
    "bilirubin_indirect": 50884, "ck_cpk": 50910, "ck_mb": 50911, "ggt": 50927, "ld_ldh": 50954,
}
INFLAMMATION = {"crp": 50889}
LAB_PIVOTS = {
    "cardiac_marker": (CARDIAC, False), "coagulation": (COAGULATION, False), "complete_blood_count": (BLOOD_COUNT, True),
    "enzyme": (ENZYME, True), "inflammation": (INFLAMMATION, True),
}


def _lab_pivot(name: str, codes: dict[str, int], positive: bool):
    @concept(name)
    def build(c: Catalog):
        rows = c("labevents").filter(F.col("valuenum").isNotNull())
        if positive:
            rows = rows.filter(F.col("valuenum") > 0)
        return pivot_items(rows, ["specimen_id"], {n: item(i) for n, i in codes.items()}, also=_specimen_keys())


for _name, (_codes, _positive) in LAB_PIVOTS.items():
    _lab_pivot(_name, _codes, _positive)


@concept("chemistry")
def _(c: Catalog):
    # an anion gap may be zero or below, every other value must be positive
    rows = c("labevents").filter((F.col("valuenum") > 0) | ((F.col("itemid") == 50868) & F.col("valuenum").isNotNull()))
    spec = {n: item(i, hi=cap, hi_closed=True) for n, (i, cap) in CHEMISTRY.items()}
    return pivot_items(rows, ["specimen_id"], spec, also=_specimen_keys())


# cell counts: absolute codes, codes given per 1000, and percentage codes
DIFF_ABSOLUTE = {
    "basophils": ((52069,), ()), "eosinophils": ((52073,), (51199,)), "lymphocytes": ((51133,), (52769,)),
    "monocytes": ((52074,), (51253,)), "neutrophils": ((52075,), ()),
}
DIFF_PERCENT = {
    "basophils": (51146,), "eosinophils": (51200,), "lymphocytes": (51244, 51245), "monocytes": (51254,), "neutrophils": (51256,),
}
DIFF_OTHER = {"atypical_lymphocytes": 51143, "bands": 51144, "immature_granulocytes": 52135, "metamyelocytes": 51251, "nrbc": 51257}
WBC_CODES = (51300, 51301, 51755)
GRANULOCYTES = 51218


@concept("blood_differential")
def _(c: Catalog):
    code, v = F.col("itemid"), F.col("valuenum")
    used = [*WBC_CODES, GRANULOCYTES, *DIFF_OTHER.values()]
    for whole, milli in DIFF_ABSOLUTE.values():
        used += [*whole, *milli]
    for pct in DIFF_PERCENT.values():
        used += pct
    rows = c("labevents").filter(code.isin(*used) & (v >= 0))
    aggs = [F.max(F.when(code.isin(*WBC_CODES), v)).alias("wbc")]
    for n, (whole, milli) in DIFF_ABSOLUTE.items():
        pick = F.when(code.isin(*whole), v)
        aggs.append(F.max(pick.when(code.isin(*milli), v / 1000.0) if milli else pick).alias(f"{n}_abs"))
    aggs += [F.max(F.when(code.isin(*p), v)).alias(n) for n, p in DIFF_PERCENT.items()]
    aggs += [F.max(F.when(code == i, v)).alias(n) for n, i in DIFF_OTHER.items()]
    every_pct = [i for p in DIFF_PERCENT.values() for i in p]
    aggs.append(F.sum(F.when(code.isin(*every_pct), v)).alias("__pct"))
    g = rows.groupBy("specimen_id").agg(*_specimen_keys(), *aggs)
    impute = (F.col("wbc") > 0) & (F.col("__pct") > 0)
    full = {
        f"{n}_abs": round_dec(
            F.when(F.col(f"{n}_abs").isNull() & F.col(n).isNotNull() & impute, F.col(n) * F.col("wbc") / 100).otherwise(F.col(f"{n}_abs")), 4
        )
        for n in DIFF_ABSOLUTE
    }
    return g.withColumns(full).drop("__pct")


# --- blood gas --------------------------------------------------------------------------

GAS_PLAIN = {
    "aado2": 50801, "baseexcess": 50802, "bicarbonate": 50803, "totalco2": 50804, "carboxyhemoglobin": 50805, "chloride": 50806,
    "calcium": 50808, "hemoglobin": 50811, "methemoglobin": 50814, "pco2": 50818, "ph": 50820, "po2": 50821, "potassium": 50822,
    "sodium": 50824, "temperature": 50825,
}
GAS_CAPPED = {"glucose": (50809, 10000), "hematocrit": (50810, 100), "lactate": (50813, 10000), "so2": (50817, 100)}


@concept("bg")
def _(c: Catalog):
    spec = {n: item(i) for n, i in GAS_PLAIN.items()}
    spec |= {n: item(i, hi=cap, hi_closed=True) for n, (i, cap) in GAS_CAPPED.items()}
    spec["specimen"] = item(52033, text=True)
    v = F.col("valuenum")
    share = F.when((v > 20) & (v <= 100), v).when((v > 0.2) & (v <= 1.0), v * 100.0)
    fio2 = F.max(F.when(F.col("itemid") == 50816, share)).alias("fio2")
    # any gas code makes a specimen, also one without an output column
    codes = [*GAS_PLAIN.values(), *[i for i, _ in GAS_CAPPED.values()], 52033, 50807, 50815, 50816, 50819, 50823]
    spec["__any"] = item(*codes)
    g = pivot_items(c("labevents"), ["specimen_id"], spec, also=[*_specimen_keys(), fio2]).drop("__any")
    g = g.filter(F.col("po2").isNotNull())
    ce = f64(c("chartevents")).select("subject_id", "charttime", "itemid", "valuenum")
    frac = F.when((v > 0.2) & (v <= 1), v * 100).when((v >= 20) & (v <= 100), v)
    f = ce.filter((F.col("itemid") == 223835) & (v > 0) & (v <= 100)).groupBy("subject_id", F.col("charttime").alias("ft"))
    f = f.agg(F.max(frac).alias("fio2_chartevents")).filter(F.col("fio2_chartevents") > 0)
    # the saturation match of the source keeps one row per specimen and adds no column, so it is left out
    g = J.asof_latest(g, f, ["subject_id"], "charttime", "ft", ["fio2_chartevents"], 4 * 3600)
    gradient, ratio = gas_ratios(F.col("po2"), F.col("pco2"), F.coalesce("fio2", "fio2_chartevents"))
    g = g.withColumns({"aado2_calc": gradient, "pao2fio2ratio": ratio})
    return g.select(
        "subject_id", "hadm_id", "charttime", "specimen", "so2", "po2", "pco2", "fio2_chartevents", "fio2", "aado2", "aado2_calc",
        "pao2fio2ratio", "ph", "baseexcess", "bicarbonate", "totalco2", "hematocrit", "hemoglobin", "carboxyhemoglobin",
        "methemoglobin", "chloride", "calcium", "temperature", "potassium", "sodium", "lactate", "glucose",
    )


@concept("creatinine_baseline")
def _(c: Catalog):
    p = c("age").select("subject_id", "hadm_id", "age").filter(F.col("age") >= 18)
    p = p.join(c("patients").select("subject_id", "gender"), "subject_id", "left")
    lab = c("chemistry").groupBy("hadm_id").agg(F.min("creatinine").alias("scr_min"))
    d = c("diagnoses_icd")
    ckd = d.filter(prefix_flag(F.col("icd_code"), F.col("icd_version"), "585", "N18") == 1).select("hadm_id").distinct()
    out = p.join(lab, "hadm_id", "left").join(ckd.withColumn("ckd", F.lit(1)), "hadm_id", "left")
    out = out.withColumn("ckd", F.coalesce("ckd", F.lit(0)))
    out = out.withColumn("mdrd_est", mdrd_creatinine(F.col("age"), F.coalesce(F.col("gender") == "F", F.lit(False))))
    base = F.when((F.col("scr_min") <= 1.1) | (F.col("ckd") == 1), F.col("scr_min")).otherwise(F.col("mdrd_est"))
    return out.select("hadm_id", "gender", "age", "scr_min", "ckd", "mdrd_est", base.alias("scr_baseline"))


# --- charted measurements ---------------------------------------------------------------


@concept("vitalsign")
def _(c: Catalog):
    avg = {"agg": "avg"}
    spec = {
        "heart_rate": item(220045, lo=0, hi=300, **avg),
        "sbp": item(220179, 220050, 225309, lo=0, hi=400, **avg),
        "dbp": item(220180, 220051, 225310, lo=0, hi=300, **avg),
        "mbp": item(220052, 220181, 225312, lo=0, hi=300, **avg),
        "sbp_ni": item(220179, lo=0, hi=400, **avg),
        "dbp_ni": item(220180, lo=0, hi=300, **avg),
        "mbp_ni": item(220181, lo=0, hi=300, **avg),
        "resp_rate": item(220210, 224690, lo=0, hi=70, **avg),
        "temperature_site": item(224642, text=True),
        "spo2": item(220277, lo=0, hi=100, hi_closed=True, **avg),
        "glucose": item(225664, 220621, 226537, lo=0, **avg),
        "__temp": item(223761, 223762),
    }
    code, v = F.col("itemid"), F.col("valuenum")
    celsius = F.when((code == 223761) & (v > 70) & (v < 120), (v - 32) / 1.8).when((code == 223762) & (v > 10) & (v < 50), v)
    temp = round_dec(F.avg(celsius), 2).alias("temperature")
    rows = f64(c("chartevents")).filter(F.col("stay_id").isNotNull())
    return pivot_items(rows, ["subject_id", "stay_id", "charttime"], spec, also=[temp]).drop("__temp")


@concept("gcs")
def _(c: Catalog):
    ce = f64(c("chartevents"))
    code, v = F.col("itemid"), F.col("valuenum")
    tube = (code == 223900) & (F.col("value") == "No Response-ETT")
    b = ce.filter(code.isin(223900, 223901, 220739)).groupBy("subject_id", "stay_id", "charttime").agg(
        F.max(F.when(code == 223901, v)).alias("motor"),
        F.max(F.when(tube, F.lit(0.0)).when(code == 223900, v)).alias("verbal"),
        F.max(F.when(code == 220739, v)).alias("eyes"),
        F.max(F.coalesce(tube, F.lit(False)).cast("int")).alias("gcs_unable"),
    )
    parts = ["motor", "verbal", "eyes"]
    b = W.carried(b, ["stay_id"], "charttime", parts, 6 * 3600)
    now, was = {p: F.col(p) for p in parts}, {p: F.col(f"{p}_prev") for p in parts}
    best = {"motor": 6.0, "verbal": 5.0, "eyes": 4.0}
    fresh = compat.sum_all([F.coalesce(now[p], F.lit(best[p])) for p in parts])
    carry = compat.sum_all([F.coalesce(now[p], was[p], F.lit(best[p])) for p in parts])
    score = (
        F.when((now["verbal"] == 0) | (now["verbal"].isNull() & (was["verbal"] == 0)), 15.0)
        .when(was["verbal"] == 0, fresh)
        .otherwise(carry)
    )
    return b.select(
        "subject_id", "stay_id", "charttime", score.alias("gcs"), F.coalesce(now["motor"], was["motor"]).alias("gcs_motor"),
        F.coalesce(now["verbal"], was["verbal"]).alias("gcs_verbal"), F.coalesce(now["eyes"], was["eyes"]).alias("gcs_eyes"), "gcs_unable",
    )


@concept("height")
def _(c: Catalog):
    ce = f64(c("chartevents")).filter(F.col("valuenum").isNotNull()).select("subject_id", "stay_id", "charttime", "itemid", "valuenum")
    cm = ce.filter(F.col("itemid") == 226730).withColumn("height", round_dec("valuenum", 2)).drop("itemid", "valuenum")
    inch = ce.filter(F.col("itemid") == 226707).withColumn("height", round_dec(F.col("valuenum") * 2.54, 2)).drop("itemid", "valuenum")
    out = J.full_merge(cm, inch, ["subject_id", "charttime"])
    return out.filter((F.col("height") > 120) & (F.col("height") < 230)).select("subject_id", "stay_id", "charttime", "height")


@concept("icp")
def _(c: Catalog):
    rows = f64(c("chartevents"))
    return pivot_items(rows, ["subject_id", "stay_id", "charttime"], {"icp": item(220765, 227989, lo=0, hi=100)})


@concept("oxygen_delivery")
def _(c: Catalog):
    ce = f64(c("chartevents")).select("subject_id", "stay_id", "charttime", "storetime", "itemid", "value", "valuenum")
    flow = ce.filter(F.col("itemid").isin(223834, 227582, 227287) & F.col("value").isNotNull())
    flow = flow.withColumn("itemid", F.when(F.col("itemid") == 227582, 223834).otherwise(F.col("itemid")))
    # latest stored row per item, largest number among equals
    newest = F.max_by(F.struct("stay_id", "valuenum"), F.struct("storetime", "valuenum")).alias("s")
    flow = flow.groupBy("subject_id", "charttime", "itemid").agg(newest)
    per = flow.groupBy("subject_id", "charttime").agg(
        F.max("s.stay_id").alias("stay_id"),
        F.max(F.when(F.col("itemid") == 223834, F.col("s.valuenum"))).alias("o2_flow"),
        F.max(F.when(F.col("itemid") == 227287, F.col("s.valuenum"))).alias("o2_flow_additional"),
    )
    dev = ce.filter(F.col("itemid") == 226732)
    dev = rank_pivot(
        dev, ["subject_id", "charttime"], [F.col("storetime").desc_nulls_last(), F.col("value").desc_nulls_last()], "value", 4,
        "o2_delivery_device_",
    )
    # a device without any flow row gives no row: the join keeps the flow side only
    return per.join(dev, ["subject_id", "charttime"], "left")


@concept("rhythm")
def _(c: Catalog):
    text = {"agg": "max", "text": True}
    spec = {
        "ectopy_type": item(224650, **text), "ectopy_frequency": item(224651, **text),
        "ectopy_type_secondary": item(226479, **text), "ectopy_frequency_secondary": item(226480, **text), "__hr": item(220048, **text),
    }
    names = F.sort_array(F.collect_set(F.when(F.col("itemid") == 220048, F.col("value"))))
    listed = F.when(F.size(names) > 0, F.array_join(names, "; ")).alias("heart_rhythm")
    rows = c("chartevents").filter(F.col("stay_id").isNotNull())
    return pivot_items(rows, ["subject_id", "charttime"], spec, also=[listed]).drop("__hr")


# Item codes
URINE_ITEMS = (226559, 226560, 226561, 226584, 226563, 226564, 226565, 226567, 226557, 226558, 227488, 227489)
IRRIGANT_IN = 227488


@concept("urine_output")
def _(c: Catalog):
    v = F.col("value").cast("double")
    signed = F.when((F.col("itemid") == IRRIGANT_IN) & (v > 0), -v).otherwise(v)
    rows = c("outputevents").filter(F.col("itemid").isin(*URINE_ITEMS))
    return rows.groupBy("stay_id", "charttime").agg(F.sum(signed).alias("urineoutput"))


@concept("kdigo_uo")
def _(c: Catalog):
    uo = c("urine_output").join(c("icustays").select("stay_id", "intime"), "stay_id")
    uo = prefix_scan(uo, ["stay_id"], ["charttime"], time_bucket("charttime"), {"__p": ("prev", "charttime")})
    hours = F.coalesce((epoch_s("charttime") - epoch_s("__p")) / F.lit(3600.0), F.lit(1.0))
    uo = uo.withColumn("__h", hours)
    frames = {}
    for h in (6, 12, 24):
        frames[f"urineoutput_{h}hr"] = (F.sum("urineoutput"), -h * 3600, 0)
        frames[f"__t{h}"] = (F.sum("__h"), -h * 3600, 0)
    uo = rolling_range(uo, ["stay_id"], epoch_s("charttime"), 0, 0, frames)
    uo = uo.withColumns({f"uo_tm_{h}hr": round_dec(f"__t{h}", 6) for h in (6, 12, 24)})
    wd = c("weight_durations").select("stay_id", "starttime", "endtime", "weight")
    out = J.point_in_interval(uo, wd, ["stay_id"], "charttime", "starttime", "endtime", (True, False), "left")

    def rate(h: int, ok: Column) -> Column:
        tm = F.col(f"uo_tm_{h}hr")
        ml = F.try_divide(F.try_divide(F.col(f"urineoutput_{h}hr"), F.col("weight").cast("double")), tm.cast("double"))
        return F.when(ok, round_dec(ml, 4))

    t6 = F.col("uo_tm_6hr")
    return out.select(
        "stay_id", "charttime", "weight", "urineoutput_6hr", "urineoutput_12hr", "urineoutput_24hr",
        rate(6, (t6 >= 6) & (t6 < 12)).alias("uo_rt_6hr"), rate(12, F.col("uo_tm_12hr") >= 12).alias("uo_rt_12hr"),
        rate(24, F.col("uo_tm_24hr") >= 24).alias("uo_rt_24hr"), "uo_tm_6hr", "uo_tm_12hr", "uo_tm_24hr",
    )


@concept("urine_output_rate")
def _(c: Catalog):
    ie = c("icustays").select("stay_id", "intime", "outtime")
    hr = c("chartevents").filter(F.col("itemid") == 220045).select("stay_id", "charttime").join(ie, "stay_id")
    near = (F.col("charttime") > F.expr("intime - interval 1 month")) & (F.col("charttime") < F.expr("outtime + interval 1 month"))
    tm = hr.filter(near).groupBy("stay_id").agg(F.min("charttime").alias("intime_hr"))
    uo = c("urine_output").join(tm, "stay_id")
    uo = prefix_scan(uo, ["stay_id"], ["charttime"], time_bucket("charttime"), {"__p": ("prev", "charttime")})
    uo = uo.withColumn("__m", date_diff_boundaries("minute", F.coalesce("__p", "intime_hr"), "charttime"))
    uo = J.boundary_hour_sums(
        uo.select("stay_id", "charttime", "urineoutput", "__m"), ["stay_id"], "charttime",
        {"urineoutput": "urineoutput", "__tm": "__m"}, {"6hr": 5, "12hr": 11}, {"24hr": 23},
    )
    for h in (6, 12, 24):
        uo = uo.withColumn(f"__h{h}", round_dec(F.col(f"__tm_{h}hr") / F.lit(60.0), 6))
    wd = c("weight_durations").filter(F.col("weight") > 0).select("stay_id", "starttime", "endtime", "weight")
    out = J.point_in_interval(uo, wd, ["stay_id"], "charttime", "starttime", "endtime", (False, True), "left")

    def rate(h: int) -> Column:
        ml = F.try_divide(
            F.try_divide(F.col(f"urineoutput_{h}hr"), F.col("weight").cast("double")), F.col(f"__h{h}").cast("double")
        )
        return F.when(F.col(f"__h{h}") >= h, round_dec(ml, 4)).alias(f"uo_mlkghr_{h}hr")

    return out.select(
        "stay_id", "charttime", "weight", F.col("urineoutput").alias("uo"), "urineoutput_6hr", "urineoutput_12hr", "urineoutput_24hr",
        rate(6), rate(12), rate(24), *[F.round(f"__h{h}", 2).alias(f"uo_tm_{h}hr") for h in (6, 12, 24)],
    )


# Item codes
VENT_NUMBERS = {
    "respiratory_rate_set": (224688,), "respiratory_rate_total": (224690,), "respiratory_rate_spontaneous": (224689,),
    "minute_volume": (224687,), "tidal_volume_set": (224684,), "tidal_volume_observed": (224685,),
    "tidal_volume_spontaneous": (224686,), "plateau_pressure": (224696,), "flow_rate": (224691,),
}
VENT_TEXTS = {"ventilator_mode": 223849, "ventilator_mode_hamilton": 229314, "ventilator_type": 223848}


@concept("ventilator_setting")
def _(c: Catalog):
    v = F.col("valuenum")
    spec = {n: item(*i) for n, i in VENT_NUMBERS.items()}
    spec |= {n: item(i, text=True) for n, i in VENT_TEXTS.items()}
    spec["peep"] = item(220339, 224700, lo=0, hi=100, lo_closed=True, hi_closed=True)
    spec["__fio2"] = item(223835)
    share = F.when((v >= 0.20) & (v <= 1), v * 100).when((v >= 20) & (v <= 100), v)
    fio2 = F.max(F.when(F.col("itemid") == 223835, share)).alias("fio2")
    rows = f64(c("chartevents")).filter(F.col("value").isNotNull() & F.col("stay_id").isNotNull())
    return pivot_items(
        rows, ["subject_id", "charttime"], spec, also=[F.max("stay_id").alias("stay_id"), fio2]
    ).drop("__fio2")


# --- medication ------------------------------------------------------------------------------

# Item codes
AGENT_CODES = {
    "dopamine": 221662, "epinephrine": 221289, "norepinephrine": 221906, "phenylephrine": 221749, "vasopressin": 222315,
    "dobutamine": 221653, "milrinone": 221986,
}


def agent_rate() -> Column:
    """Infusion rate in the agent's common unit."""
    code, unit, rate = F.col("itemid"), F.col("rateuom"), F.col("rate").cast("double")
    weight = F.col("patientweight").cast("double")
    nor = F.when((unit == "mg/kg/min") & ~F.coalesce(weight == 1, F.lit(False)), rate * 1000.0).otherwise(rate)
    phe = F.when(unit == "mcg/min", F.try_divide(rate, weight)).otherwise(rate)
    vas = F.when(unit == "units/min", rate * 60.0).otherwise(rate)
    return F.when(code == 221906, nor).when(code == 221749, phe).when(code == 222315, vas).otherwise(rate)


def infusions(c: Catalog, codes: list[int]):
    return c("inputevents").filter(F.col("itemid").isin(*codes)).withColumn("vaso_rate", agent_rate())


def _agent(name: str, code: int):
    @concept(name)
    def build(c: Catalog):
        return infusions(c, [code]).select(
            "stay_id", "linkorderid", "vaso_rate", F.col("amount").cast("double").alias("vaso_amount"), "starttime", "endtime"
        )


for _name, _code in AGENT_CODES.items():
    _agent(_name, _code)


@concept("neuroblock")
def _(c: Catalog):
    rows = c("inputevents").filter(F.col("itemid").isin(222062, 221555) & F.col("rate").isNotNull())
    return rows.select(
        "stay_id", "orderid", F.col("rate").cast("double").alias("drug_rate"), F.col("amount").cast("double").alias("drug_amount"),
        "starttime", "endtime",
    )


# Drug-name fragments, lower case
ACEI = (
    "benazepril", "captopril", "enalapril", "fosinopril", "lisinopril", "moexipril", "perindopril", "quinapril", "ramipril",
    "trandolapril",
)
ARB = (
    "azilsartan", "edarbi", "candesartan", "atacand", "irbesartan", "avapro", "losartan", "cozaar", "olmesartan", "benicar",
    "telmisartan", "micardis", "valsartan", "diovan", "sacubitril", "entresto",
)
NSAID = (
    "aspirin", "bromfenac", "celecoxib", "diclofenac", "diflunisal", "etodolac", "fenoprofen", "flurbiprofen", "ibuprofen",
    "indomethacin", "ketoprofen", "mefenamic acid", "meloxicam", "nabumetone", "naproxen", "nepafenac", "oxaprozin", "piroxicam",
    "sulindac", "tolmetin",
)
ANTIBIOTIC = (
    "adoxa", "ala-tet", "alodox", "amikacin", "amikin", "amoxicill", "amphotericin", "anidulafungin", "ancef", "clavulanate",
    "ampicillin", "augmentin", "avelox", "avidoxy", "azactam", "azithromycin", "aztreonam", "axetil", "bactocill", "bactrim",
    "bactroban", "bethkis", "biaxin", "bicillin l-a", "cayston", "cefazolin", "cedax", "cefoxitin", "ceftazidime", "cefaclor",
    "cefadroxil", "cefdinir", "cefditoren", "cefepime", "cefotan", "cefotetan", "cefotaxime", "ceftaroline", "cefpodoxime", "cefpirome",
    "cefprozil", "ceftibuten", "ceftin", "ceftriaxone", "cefuroxime", "cephalexin", "cephalothin", "cephapririn", "chloramphenicol",
    "cipro", "ciprofloxacin", "claforan", "clarithromycin", "cleocin", "clindamycin", "cubicin", "dicloxacillin", "dirithromycin",
    "doryx", "doxycy", "duricef", "dynacin", "ery-tab", "eryped", "eryc", "erythrocin", "erythromycin", "factive", "flagyl", "fortaz",
    "furadantin", "garamycin", "gentamicin", "kanamycin", "keflex", "kefzol", "ketek", "levaquin", "levofloxacin", "lincocin",
    "linezolid", "macrobid", "macrodantin", "maxipime", "mefoxin", "metronidazole", "meropenem", "methicillin", "minocin",
    "minocycline", "monodox", "monurol", "morgidox", "moxatag", "moxifloxacin", "mupirocin", "myrac", "nafcillin", "neomycin",
    "nicazel doxy 30", "nitrofurantoin", "norfloxacin", "noroxin", "ocudox", "ofloxacin", "omnicef", "oracea", "oraxyl", "oxacillin",
    "panixine", "pc pen vk", "pce dispertab", "pediazole", "penicillin", "periostat", "pfizerpen", "piperacillin", "tazobactam",
    "primsol", "proquin", "raniclor", "rifadin", "rifampin", "rocephin", "smz-tmp", "septra", "solodyn", "spectracef", "streptomycin",
    "sulfadiazine", "sulfamethoxazole", "trimethoprim", "sulfatrim", "sulfisoxazole", "suprax", "synercid", "tazicef", "tetracycline",
    "timentin", "tobramycin", "unasyn", "vancocin", "vancomycin", "vantin", "vibativ", "vibra-tabs", "vibramycin", "zinacef",
    "zithromax", "zosyn", "zyvox",
)
LOCAL_ROUTES = ("OU", "OS", "OD", "AU", "AS", "AD", "TP")
NOT_SYSTEMIC = ["cream", "desensitization", "ophth oint", "gel"]


def _drug_class(name: str, words: list[str]):
    @concept(name)
    def build(c: Catalog):
        rx = c("prescriptions").select("subject_id", "hadm_id", "drug", "starttime", "stoptime")
        # each distinct name is classified once; the list is far smaller than the orders
        names = rx.select("drug").distinct().filter(contains_any(F.col("drug"), words))
        return rx.join(names, "drug", "left_semi").withColumnRenamed("drug", name)


for _name, _words in (("acei", ACEI), ("arb", ARB), ("nsaid", NSAID)):
    _drug_class(_name, _words)


@concept("antibiotic")
def _(c: Catalog):
    rx = c("prescriptions")
    route, drug = F.col("route"), F.col("drug")
    kinds = rx.filter(
        (F.col("drug_type") != "BASE") & ~route.isin(*LOCAL_ROUTES) & ~contains_any(route, ["ear", "eye"])
        & ~contains_any(drug, NOT_SYSTEMIC)
    )
    kinds = kinds.select("drug", "route").distinct().filter(contains_any(drug, ANTIBIOTIC))
    ab = rx.select("subject_id", "hadm_id", "drug", "route", "starttime", "stoptime").join(kinds, ["drug", "route"], "left_semi")
    ie = c("icustays").select("hadm_id", "stay_id", "intime", "outtime")
    out = J.point_in_interval(ab, ie, ["hadm_id"], "starttime", "intime", "outtime", (True, False), "left", 30 * 86400)
    return out.select("subject_id", "hadm_id", "stay_id", drug.alias("antibiotic"), "route", "starttime", "stoptime")


@concept("vasoactive_agent")
def _(c: Catalog):
    tag = F.lit(None).cast("string")
    for n, i in AGENT_CODES.items():
        tag = F.when(F.col("itemid") == i, n).otherwise(tag)
    rows = infusions(c, list(AGENT_CODES.values())).withColumn("agent", tag)
    return I.segments(rows, ["stay_id"], "starttime", "endtime", "vaso_rate", "agent", list(AGENT_CODES))


@concept("norepinephrine_equivalent_dose")
def _(c: Catalog):
    # What one unit of each agent is worth
    worth = {
        "norepinephrine": lambda x: x, "epinephrine": lambda x: x, "phenylephrine": lambda x: x / 10,
        "dopamine": lambda x: x / 100, "vasopressin": lambda x: x * 2.5 / 60,
    }
    terms = [F.coalesce(f(F.col(n)), F.lit(0.0)) for n, f in worth.items()]
    some = F.coalesce(*worth).isNotNull()
    dose = round_dec(compat.sum_all(terms), 4).alias("norepinephrine_equivalent_dose")
    return c("vasoactive_agent").filter(some).select("stay_id", "starttime", "endtime", dose)

