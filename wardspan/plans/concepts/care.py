"""Treatment, comorbidity and first-day tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardspan.functions.codes import mapped, prefix_flag
from wardspan.functions.compat import greatest_strict, round_dec, sum_all
from wardspan.functions.scoring import score_bands
from wardspan.operators import intervals as I
from wardspan.operators import joins as J
from wardspan.operators.pivot import item, pivot_items
from wardspan.plans.concepts.base import BLOOD_COUNT, CHEMISTRY, COAGULATION, DIFF_ABSOLUTE, ENZYME, f64
from wardspan.plans.concepts.registry import Catalog, concept

# --- treatment ------------------------------------------------------------------------

# Texts of the code-status item and of the code-status orders
CHARTED_STATUS = {
    "fullcode": ["Full code"], "cmo": ["Comfort measures only"], "dni": ["DNI (do not intubate)", "DNR / DNI"],
    "dnr": ["DNR (do not resuscitate)", "DNR / DNI"],
}
ORDERED_STATUS = {
    "fullcode": ["Resuscitate (Full code)", "Full code (attempt resuscitation)"], "cmo": [],
    "dni": ["Do not resuscitate (DNR/DNI)"],
    "dnr": ["DNAR (DO NOT attempt resuscitation for cardiac arrest) ", "Do not resuscitate (DNR/DNI)"],
}


def _any_of(text: Column, names: list[str]) -> Column:
    return F.coalesce(text.isin(*names), F.lit(False)).cast("int") if names else F.lit(0)


@concept("code_status")
def _(c: Catalog):
    charted = c("chartevents").filter(F.col("itemid") == 223758).select(
        "subject_id", "hadm_id", "stay_id", "charttime", *[_any_of(F.col("value"), v).alias(k) for k, v in CHARTED_STATUS.items()]
    )
    poe = c("poe").filter((F.col("order_type") == "General Care") & (F.col("order_subtype") == "Code status"))
    poe = poe.select("poe_id", "subject_id", "hadm_id", "ordertime").join(c("poe_detail").select("poe_id", "field_value"), "poe_id")
    ie = c("icustays").select("hadm_id", "stay_id", "intime", "outtime")
    poe = J.point_in_interval(poe, ie, ["hadm_id"], "ordertime", "intime", "outtime", (True, True), "left", 30 * 86400)
    ordered = poe.select(
        "subject_id", "hadm_id", "stay_id", F.col("ordertime").alias("charttime"),
        *[_any_of(F.col("field_value"), v).alias(k) for k, v in ORDERED_STATUS.items()],
    )
    return charted.unionByName(ordered)


# Renal-replacement settings, number and text items
CRRT_NUMBERS = {
    "access_pressure": 224149, "blood_flow": 224144, "citrate": 228004, "current_goal": 225183, "dialysate_rate": 224154,
    "effluent_pressure": 224151, "filter_pressure": 224150, "heparin_dose": 224145, "hourly_patient_fluid_removal": 224191,
    "prefilter_replacement_rate": 228005, "postfilter_replacement_rate": 228006, "replacement_rate": 224153,
    "return_pressure": 224152, "ultrafiltrate_output": 226457,
}
CRRT_TEXTS = {"crrt_mode": 227290, "dialysate_fluid": 225977, "heparin_concentration": 225958, "replacement_fluid": 225976}
CRRT_STATE = 224146


@concept("crrt")
def _(c: Catalog):
    spec = {n: item(i) for n, i in CRRT_NUMBERS.items()} | {n: item(i, text=True) for n, i in CRRT_TEXTS.items()}
    spec["__state"] = item(CRRT_STATE, text=True)
    v, state = F.col("value"), F.col("itemid") == CRRT_STATE
    flag = lambda yes, no=(): F.max(
        F.when(state & v.isin(*yes), 1).when(state & v.isin(*no), 0) if no else F.when(state & v.isin(*yes), 1)
    )
    also = [
        flag(["Active", "Initiated", "Reinitiated", "New Filter"], ["Recirculating", "Discontinued"]).alias("system_active"),
        flag(["Clots Present"], ["No Clot Present"]).alias("clots"),
        flag(["Clots Increasing", "Clot Increasing"]).alias("clots_increasing"), flag(["Clotted"]).alias("clotted"),
    ]
    rows = f64(c("chartevents")).filter(v.isNotNull())
    return pivot_items(rows, ["stay_id", "charttime"], spec, also=also).drop("__state")


# Line items and the spellings that are brought together
LINE_ITEMS = (
    227719, 225752, 224269, 224267, 224270, 224272, 226124, 228169, 225202, 228286, 225204, 224263, 224560, 224264, 225203, 224273,
    225789, 225761, 228201, 228202, 224268, 225199, 225315, 225205,
)
LINE_TYPES = {
    "Arterial": ["Arterial Line", "A-Line"], "Continuous Cardiac Output PA": ["CCO PA Line", "CCO PAC"],
    "Dialysis": ["Dialysis Catheter", "Dialysis Line"], "Hickman": ["Hickman", "Tunneled (Hickman) Line"],
    "IABP": ["IABP", "IABP line"], "Multi Lumen": ["Multi Lumen", "Multi-lumen"], "PA": ["PA Catheter", "PA line"],
    "PICC": ["PICC Line", "PICC line"], "Pre-Sep": ["Pre-Sep Catheter", "Presep Catheter"], "Trauma": ["Trauma Line", "Trauma line"],
    "Triple Introducer": ["Triple Introducer", "TripleIntroducer"], "Portacath": ["Portacath", "Indwelling Port (PortaCath)"],
}
LINE_SITES = {
    "Left Antecube": ["Left Antecub", "Left Antecube"],
    "Left Axilla": ["Left Axilla", "Left Axilla."],
    "Left Brachial": ["Left Brachial", "Left Brachial."],
    "Left Femoral": ["Left Femoral", "Left Femoral."],
    "Right Antecube": ["Right Antecub", "Right Antecube"],
    "Right Axilla": ["Right Axilla", "Right Axilla."],
    "Right Brachial": ["Right Brachial", "Right Brachial."],
    "Right Femoral": ["Right Femoral", "Right Femoral."],
}


def _spellings(groups: dict[str, list[str]]) -> dict[str, str]:
    return {s: name for name, ss in groups.items() for s in ss}


@concept("invasive_line")
def _(c: Catalog):
    mv = c("procedureevents").filter(F.col("itemid").isin(*LINE_ITEMS))
    mv = mv.join(c("d_items").select("itemid", "label"), "itemid")
    out = mv.select(
        "stay_id", mapped(F.col("label"), _spellings(LINE_TYPES)).alias("line_type"),
        mapped(F.col("location"), _spellings(LINE_SITES)).alias("line_site"), "starttime", "endtime",
    )
    return out.orderBy(*[F.col(k).asc_nulls_first() for k in ("stay_id", "starttime", "line_type", "line_site")])


# Dialysis items
RRT_PRESENT = (
    226118, 227357, 225725, 226499, 224154, 225810, 225959, 227639, 225183, 227438, 224191, 225806, 225807, 228004, 228005, 228006,
    224144, 224145, 224149, 224150, 224151, 224152, 224153, 224404, 224406, 226457, 224135, 224139, 224146, 225323, 225740, 225776,
    225951, 225952, 225953, 225954, 225956, 225958, 225961, 225963, 225965, 225976, 225977, 227124, 227290, 227638, 227640, 227753,
)
RRT_ACTIVE = (226499, 224154, 225183, 227438, 224191, 225806, 225807, 228004, 228005, 228006, 224144, 224145, 224153, 226457)
PERITONEAL = (225810, 225806, 225807, 227639, 225959, 225951, 225952, 225961, 225953, 225963, 225965, 227638, 227640)
RRT_PROCEDURES = {
    225441: "IHD", 225802: "CRRT", 225803: "CVVHD", 225805: "Peritoneal", 225809: "CVVHDF", 225955: "SCUF", 224270: None, 225436: None,
}
RRT_CATHETERS = (224270, 225436)
CITRATE_INPUTS = (227536, 227525)


@concept("rrt")
def _(c: Catalog):
    code, v = F.col("itemid"), F.col("value")
    active = ((code == 225965) & (v == "In use")) | code.isin(*RRT_ACTIVE)
    kind = F.when(code == 227290, v).when(code.isin(*PERITONEAL), "Peritoneal").when(code == 226499, "IHD")
    ce = c("chartevents").filter(code.isin(*RRT_PRESENT) & v.isNotNull()).select(
        "stay_id", "charttime", F.lit(1).alias("dialysis_present"), F.coalesce(active, F.lit(False)).cast("int").alias("dialysis_active"),
        kind.alias("dialysis_type"),
    )
    one = F.lit(1)
    inputs = c("inputevents").filter(code.isin(*CITRATE_INPUTS) & (F.col("amount") > 0)).select(
        "stay_id", "starttime", "endtime", one.alias("p"), one.alias("a"), F.lit("CRRT").alias("k")
    )
    ptype = F.lit(None).cast("string")
    for i, name in RRT_PROCEDURES.items():
        ptype = F.when(code == i, F.lit(name)).otherwise(ptype)
    procs = c("procedureevents").filter(code.isin(*RRT_PROCEDURES) & v.isNotNull()).select(
        "stay_id", "starttime", "endtime", one.alias("p"), (~code.isin(*RRT_CATHETERS)).cast("int").alias("a"), ptype.alias("k")
    )
    mv = inputs.unionByName(procs).distinct()
    points = ce.unionByName(
        mv.select(
            "stay_id", F.col("starttime").alias("charttime"), F.col("p").alias("dialysis_present"),
            F.col("a").alias("dialysis_active"), F.col("k").alias("dialysis_type"),
        )
    ).distinct()
    out = J.point_in_interval(points, mv, ["stay_id"], "charttime", "starttime", "endtime", (True, True), "left")
    return out.select(
        "stay_id", "charttime", F.coalesce("p", "dialysis_present").alias("dialysis_present"),
        F.coalesce("a", "dialysis_active").alias("dialysis_active"), F.coalesce("k", "dialysis_type").alias("dialysis_type"),
    )


# Ventilator modes and oxygen devices per support level
INVASIVE_MODES = [
    "(S) CMV", "APRV", "APRV/Biphasic+ApnPress", "APRV/Biphasic+ApnVol", "APV (cmv)", "Ambient", "Apnea Ventilation", "CMV",
    "CMV/ASSIST", "CMV/ASSIST/AutoFlow", "CMV/AutoFlow", "CPAP/PPS", "CPAP/PSV", "CPAP/PSV+Apn TCPL", "CPAP/PSV+ApnPres",
    "CPAP/PSV+ApnVol", "MMV", "MMV/AutoFlow", "MMV/PSV", "MMV/PSV/AutoFlow", "P-CMV", "PCV+", "PCV+/PSV", "PCV+Assist", "PRES/AC",
    "PRVC/AC", "PRVC/SIMV", "PSV/SBT", "SIMV", "SIMV/AutoFlow", "SIMV/PRES", "SIMV/PSV", "SIMV/PSV/AutoFlow", "SIMV/VOL",
    "SYNCHRON MASTER", "SYNCHRON SLAVE", "VOL/AC",
]
INVASIVE_HAMILTON = ["APRV", "APV (cmv)", "Ambient", "(S) CMV", "P-CMV", "SIMV", "APV (simv)", "P-SIMV", "VS", "ASV"]
NONINVASIVE_HAMILTON = ["DuoPaP", "NIV", "NIV-ST"]
MASKS = ["Bipap mask ", "CPAP mask "]
SUPPLEMENTAL = [
    "Non-rebreather", "Face tent", "Aerosol-cool", "Venti mask ", "Medium conc mask ", "Ultrasonic neb", "Vapomist", "Oxymizer",
    "High flow neb", "Nasal cannula",
]


def ventilation_status() -> Column:
    d = [F.col(f"o2_delivery_device_{i}") for i in range(1, 5)]
    mode, hamilton = F.col("ventilator_mode"), F.col("ventilator_mode_hamilton")
    mask = reduce(lambda a, b: a | b, [F.coalesce(x.isin(*MASKS), F.lit(False)) for x in d])
    return (
        F.when(d[0].isin("Tracheostomy tube", "Trach mask "), "Tracheostomy")
        .when((d[0] == "Endotracheal tube") | mode.isin(*INVASIVE_MODES) | hamilton.isin(*INVASIVE_HAMILTON), "InvasiveVent")
        .when(mask | hamilton.isin(*NONINVASIVE_HAMILTON), "NonInvasiveVent")
        .when(d[0] == "High flow nasal cannula", "HFNC")
        .when(d[0].isin(*SUPPLEMENTAL), "SupplementalOxygen")
        .when(d[0] == "None", "None")
    )


@concept("ventilation")
def _(c: Catalog):
    vs = c("ventilator_setting").select("stay_id", "charttime", "ventilator_mode", "ventilator_mode_hamilton")
    od = c("oxygen_delivery").select("stay_id", "charttime", *[f"o2_delivery_device_{i}" for i in range(1, 5)])
    # timeline of both tables with their rows side by side
    both = J.full_merge(vs, od, ["stay_id", "charttime"]).withColumn("ventilation_status", ventilation_status())
    rows = both.select("stay_id", "charttime", "ventilation_status")
    return I.islands(rows, ["stay_id"], "charttime", "ventilation_status", 14, "hour")


# --- comorbidity ---------------------------------------------------------------------------

# Code prefixes and prefix ranges per condition (version 9, version 10)
CHARLSON = {
    "myocardial_infarct": ("410 412", "I21 I22 I252"),
    "congestive_heart_failure": (
        "428 39891 40201 40211 40291 40401 40403 40411 40413 40491 40493 4254-4259",
        "I43 I50 I099 I110 I130 I132 I255 I420 I425 I426 I427 I428 I429 P290",
    ),
    "peripheral_vascular_disease": (
        "440 441 0930 4373 4471 5571 5579 V434 4431-4439", "I70 I71 I731 I738 I739 I771 I790 I792 K551 K558 K559 Z958 Z959",
    ),
    "cerebrovascular_disease": ("430-438 36234", "G45 G46 I60-I69 H340"),
    "dementia": ("290 2941 3312", "F00 F01 F02 F03 G30 F051 G311"),
    "chronic_pulmonary_disease": ("490-505 4168 4169 5064 5081 5088", "J40-J47 J60-J67 I278 I279 J684 J701 J703"),
    "rheumatic_disease": (
        "725 4465 7100 7101 7102 7103 7104 7140 7141 7142 7148", "M05 M06 M32 M33 M34 M315 M351 M353 M360",
    ),
    "peptic_ulcer_disease": ("531 532 533 534", "K25 K26 K27 K28"),
    "mild_liver_disease": (
        "570 571 0706 0709 5733 5734 5738 5739 V427 07022 07023 07032 07033 07044 07054",
        "B18 K73 K74 K700 K701 K702 K703 K709 K713 K714 K715 K717 K760 K762 K763 K764 K768 K769 Z944",
    ),
    "diabetes_without_cc": (
        "2500 2501 2502 2503 2508 2509",
        "E100 E101 E106 E108 E109 E110 E111 E116 E118 E119 E120 E121 E126 E128 E129 E130 E131 E136 E138 E139 E140 E141 E146 E148 E149",
    ),
    "diabetes_with_cc": (
        "2504 2505 2506 2507", "E102 E103 E104 E105 E107 E112 E113 E114 E115 E117 E122 E123 E124 E125 E127 E132 E133 E134 E135 E137 E142 E143 E144 E145 E147",
    ),
    "paraplegia": (
        "342 343 3341 3440 3441 3442 3443 3444 3445 3446 3449",
        "G81 G82 G041 G114 G801 G802 G830 G831 G832 G833 G834 G839",
    ),
    "renal_disease": (
        "582 585 586 V56 5880 V420 V451 5830-5837 40301 40311 40391 40402 40403 40412 40413 40492 40493",
        "N18 N19 I120 I131 N032 N033 N034 N035 N036 N037 N052 N053 N054 N055 N056 N057 N250 Z490 Z491 Z492 Z940 Z992",
    ),
    "malignant_cancer": (
        "140-172 1740-1958 200-208 2386",
        "C43 C88 C00-C26 C30-C34 C37-C41 C45-C58 C60-C76 C81-C85 C90-C97",
    ),
    "severe_liver_disease": (
        "4560 4561 4562 5722-5728", "I850 I859 I864 I982 K704 K711 K721 K729 K765 K766 K767",
    ),
    "metastatic_solid_tumor": ("196 197 198 199", "C77 C78 C79 C80"),
    "aids": ("042 043 044", "B20 B21 B22 B24"),
}
AGE_POINTS = [(50, 0), (60, 1), (70, 2), (80, 3), (None, 4)]


def charlson_flags(d: DataFrame) -> DataFrame:
    code, ver = F.col("icd_code"), F.col("icd_version")
    return d.groupBy("hadm_id").agg(*[F.max(prefix_flag(code, ver, n, t)).alias(k) for k, (n, t) in CHARLSON.items()])


@concept("charlson")
def _(c: Catalog):
    adm = c("admissions").select("subject_id", "hadm_id")
    out = adm.join(charlson_flags(c("diagnoses_icd")), "hadm_id", "left").fillna(0, list(CHARLSON))
    age = c("age").select("hadm_id", score_bands("age", AGE_POINTS, "<").alias("age_score"))
    out = out.join(age, "hadm_id", "left")
    k = {n: F.col(n) for n in CHARLSON}
    single = sum_all([F.col("age_score"), *[k[n] for n in list(CHARLSON)[:8]]])
    index = (
        single
        + greatest_strict(k["mild_liver_disease"], 3 * k["severe_liver_disease"])
        + greatest_strict(2 * k["diabetes_with_cc"], k["diabetes_without_cc"])
        + greatest_strict(2 * k["malignant_cancer"], 6 * k["metastatic_solid_tumor"])
        + 2 * k["paraplegia"] + 2 * k["renal_disease"] + 6 * k["aids"]
    )
    return out.select("subject_id", "hadm_id", "age_score", *CHARLSON, index.alias("charlson_comorbidity_index"))


# --- first day -------------------------------------------------------------------------------


def minmax(cols: dict[str, str]) -> list[Column]:
    out = []
    for name, src in cols.items():
        out += [F.min(src).alias(f"{name}_min"), F.max(src).alias(f"{name}_max")]
    return out


def day_one(c: Catalog, events: DataFrame, on: str, aggs: list[Column], before: str | None = "6 hours") -> DataFrame:
    """Aggregates over the events of the first 24 hours (and a lead-in) of each stay."""
    ie = c("icustays").select("subject_id", "stay_id", "intime")
    if on == "stay_id":
        return J.window_agg(ie, events, ["stay_id"], "intime", "charttime", before, "1 day", aggs).drop("intime")
    # several stays of a subject may share events; each stay is its own anchor
    spans = ie.withColumns(
        {
            "__lo": F.expr(f"intime - interval {before}") if before else F.col("intime"),
            "__hi": F.expr("intime + interval 1 day"),
        }
    ).select(on, "stay_id", "__lo", "__hi")
    hit = J.point_in_interval(events, spans, [on], "charttime", "__lo", "__hi", (True, True))
    return ie.drop("intime").join(hit.groupBy("stay_id").agg(*aggs), "stay_id", "left")


BG_FIELDS = [
    "lactate", "ph", "so2", "po2", "pco2", "aado2", "aado2_calc", "pao2fio2ratio", "baseexcess", "bicarbonate", "totalco2",
    "hematocrit", "hemoglobin", "carboxyhemoglobin", "methemoglobin", "temperature", "chloride", "calcium", "glucose",
    "potassium", "sodium",
]


@concept("first_day_bg")
def _(c: Catalog):
    return day_one(c, c("bg").drop("hadm_id"), "subject_id", minmax({f: f for f in BG_FIELDS}))


@concept("first_day_bg_art")
def _(c: Catalog):
    art = c("bg").filter(F.col("specimen") == "ART.").drop("hadm_id")
    return day_one(c, art, "subject_id", minmax({f: f for f in BG_FIELDS}))


@concept("first_day_gcs")
def _(c: Catalog):
    g = c("gcs").drop("subject_id")
    cols = ["gcs", "gcs_motor", "gcs_verbal", "gcs_eyes", "gcs_unable"]
    # lowest score, the latest one among equals; a missing score is never the lowest
    worst = F.max_by(F.struct(*cols), F.struct(-F.col("gcs"), F.col("charttime"))).alias("s")
    out = day_one(c, g, "stay_id", [worst])
    return out.select("subject_id", "stay_id", F.col("s.gcs").alias("gcs_min"), *[F.col(f"s.{x}").alias(x) for x in cols[1:]])


@concept("first_day_height")
def _(c: Catalog):
    return day_one(c, c("height").drop("subject_id"), "stay_id", [round_dec(F.avg("height"), 2).alias("height")])


@concept("first_day_lab")
def _(c: Catalog):
    groups = {
        "complete_blood_count": {"hematocrit": "hematocrit", "hemoglobin": "hemoglobin", "platelets": "platelet", "wbc": "wbc"},
        "chemistry": {n: n for n in CHEMISTRY},
        "blood_differential": {f"abs_{n}": f"{n}_abs" for n in DIFF_ABSOLUTE}
        | {"atyps": "atypical_lymphocytes", "bands": "bands", "imm_granulocytes": "immature_granulocytes", "metas": "metamyelocytes", "nrbc": "nrbc"},
        "coagulation": {n: n for n in COAGULATION},
        "enzyme": {n: n for n in ENZYME},
    }
    # all groups are stacked and met with the stays once, instead of five joins and four merges
    parts = []
    for table, cols in groups.items():
        parts.append(c(table).select("subject_id", "charttime", *[F.col(s).cast("double").alias(n) for n, s in cols.items()]))
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return day_one(c, both, "subject_id", minmax({n: n for cols in groups.values() for n in cols}))


@concept("first_day_rrt")
def _(c: Catalog):
    kinds = F.sort_array(F.collect_set("dialysis_type"))
    aggs = [
        F.max("dialysis_present").alias("dialysis_present"), F.max("dialysis_active").alias("dialysis_active"),
        F.when(F.size(kinds) > 0, F.array_join(kinds, ", ")).alias("dialysis_type"),
    ]
    return day_one(c, c("rrt"), "stay_id", aggs)


@concept("first_day_urine_output")
def _(c: Catalog):
    return day_one(c, c("urine_output"), "stay_id", [F.sum("urineoutput").alias("urineoutput")], None)


@concept("first_day_vitalsign")
def _(c: Catalog):
    cols = ["heart_rate", "sbp", "dbp", "mbp", "resp_rate", "temperature", "spo2", "glucose"]
    aggs = minmax({x: x for x in cols}) + [F.avg(x).alias(f"{x}_mean") for x in cols]
    return day_one(c, c("vitalsign").drop("subject_id"), "stay_id", aggs)


@concept("first_day_weight")
def _(c: Catalog):
    ie = c("icustays").select("subject_id", "stay_id", "intime")
    w = c("weight_durations").join(ie.select("stay_id", "intime"), "stay_id")
    w = w.filter(F.col("starttime") <= F.expr("intime + interval 1 day")).withColumn("weight", F.col("weight").cast("double"))
    g = w.groupBy("stay_id").agg(
        F.avg(F.when(F.col("weight_type") == "admit", F.col("weight"))).alias("weight_admit"), F.avg("weight").alias("weight"),
        F.min("weight").alias("weight_min"), F.max("weight").alias("weight_max"),
    )
    return ie.drop("intime").join(g, "stay_id", "left")

