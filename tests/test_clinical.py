"""Derived tables, scores and labels on small ICU-shaped frames."""

from datetime import datetime as D
from datetime import timedelta as H

import pytest
from pyspark.sql import functions as F

from wardspan.functions import compat, scoring
from wardspan.functions.codes import chapter, prefix_flag
from wardspan.operators.windows import ffill_flagged, interpolate, path_string
from wardspan.plans import alerts as AL
from wardspan.plans import labels as L
from wardspan.plans import scoring as SC
from wardspan.plans.concepts import CONCEPTS, Catalog

T0 = D(2150, 3, 1)
CE = "subject_id long, hadm_id long, stay_id long, charttime timestamp_ntz, storetime timestamp_ntz, itemid int, value string, valuenum double"


def at(h):
    return T0 + H(hours=h)


def chart(spark, rows):
    return spark.createDataFrame([(1, 10, 100, at(h), at(h) + H(minutes=i), code, txt, num) for i, (h, code, txt, num) in enumerate(rows)], CE)


def stays(spark):
    return spark.createDataFrame([(1, 10, 100, T0, at(60))], "subject_id long, hadm_id long, stay_id long, intime timestamp_ntz, outtime timestamp_ntz")


def test_gcs_carry_rules(spark):
    rows = [
        (0, 223900, "No Response-ETT", 1.0), (0, 223901, "x", 3.0), (0, 220739, "x", 2.0),  # tube: 15
        (2, 223901, "x", 4.0),  # verbal missing after a tube within 6 h: 15
        (9, 223901, "x", 5.0),  # more than 6 h later: nothing is carried
        (10, 220739, "x", 3.0),  # motor carried from hour 9
    ]
    c = Catalog(spark, {"chartevents": chart(spark, rows), "icustays": stays(spark)})
    got = [(r["gcs"], r["gcs_motor"]) for r in c("gcs").orderBy("charttime").collect()]
    assert got == [(15.0, 3.0), (15.0, 4.0), (5 + 5 + 4, 5.0), (5 + 5 + 3, 5.0)]


def test_device_without_flow_vanishes(spark):
    rows = [(0, 226732, "Nasal cannula", None), (1, 223834, "2", 2.0), (1, 226732, "Face tent", None), (1, 226732, "Other", None)]
    c = Catalog(spark, {"chartevents": chart(spark, rows)})
    out = c("oxygen_delivery").collect()
    assert len(out) == 1 and out[0]["o2_flow"] == 2.0
    assert {out[0]["o2_delivery_device_1"], out[0]["o2_delivery_device_2"]} == {"Face tent", "Other"}


def test_urine_rates_include_peers_and_weight(spark):
    oe = spark.createDataFrame([(100, at(h), 226559, 60.0) for h in range(1, 9)], "stay_id long, charttime timestamp_ntz, itemid int, value double")
    wt = chart(spark, [(0, 226512, "80", 80.0)])
    c = Catalog(spark, {"outputevents": oe, "chartevents": wt, "icustays": stays(spark)})
    out = {r["charttime"]: r for r in c("kdigo_uo").collect()}
    assert out[at(7)]["urineoutput_6hr"] == 60.0 * 7 and float(out[at(7)]["uo_tm_6hr"]) == 7.0
    assert float(out[at(7)]["uo_rt_6hr"]) == pytest.approx(round(420 / 80 / 7, 4))
    assert out[at(2)]["uo_rt_6hr"] is None


def test_oxygen_share_is_as_of_four_hours(spark):
    le = "subject_id long, hadm_id long, specimen_id long, itemid int, charttime timestamp_ntz, value string, valuenum double"
    labs = [(1, 10, 1, 50821, at(10), "80", 80.0), (1, 10, 1, 50818, at(10), "40", 40.0), (1, 10, 2, 50821, at(30), "90", 90.0), (1, 10, 3, 50820, at(31), "7", 7.4)]
    ce = chart(spark, [(6, 223835, "50", 50.0), (25, 223835, "0.4", 0.4)])
    c = Catalog(spark, {"labevents": spark.createDataFrame(labs, le), "chartevents": ce})
    out = sorted((r["po2"], r["fio2_chartevents"], r["pao2fio2ratio"]) for r in c("bg").select("po2", "fio2_chartevents", "pao2fio2ratio").collect())
    assert out == [(80.0, 50.0, 160.0), (90.0, None, None)]


def test_sixty_five_tables():
    assert len(CONCEPTS) == 65


def test_early_warning_cases(spark):
    cols = "i int, rr double, spo2 double, sbp double, hr double, temp_c double, gcs_total double, fio2 double"
    rows = [(1, 16.0, 98.0, 120.0, 70.0, 37.0, 15.0, 21.0), (2, 30.0, None, 120.0, 70.0, 37.0, 9.0, 40.0), (3, None, None, None, None, None, None, None)]
    out = {r["i"]: r for r in scoring.early_warning(spark.createDataFrame(rows, cols)).collect()}
    assert (out[1]["score"], out[1]["components"], out[1]["red_params"]) == (0, 7, "")
    assert (out[2]["score"], out[2]["components"], out[2]["max_component_nongcs"], out[2]["red_params"]) == (8, 6, 3, "gcs_total,rr")
    assert (out[3]["score"], out[3]["components"], out[3]["max_component"]) == (0, 0, 0)


def test_coma_drop_escalates_only_off_sedation(spark):
    g = spark.createDataFrame(
        [(1, h, v, s) for h, v, s in [(0, 7.0, False), (1, 7.0, False), (2, 3.0, False), (3, 3.0, True)]], "stay_id int, hour long, gcs_total double, sedated boolean"
    )
    from wardspan.operators.windows import trailing_drop

    out = trailing_drop(g, ["stay_id"], "hour", "gcs_total", 4, 2, F.col("sedated"), "dropped").orderBy("hour").collect()
    assert [r["dropped"] for r in out] == [False, False, True, False]


def test_cut_points_never_coincide(spark):
    d = spark.createDataFrame([("a", 5)] * 10, "g string, score int")
    r = SC.cut_points(d, ["g"]).first()
    assert (r["icu_medium"], r["icu_high"]) == (5, 6)


def test_small_groups_get_no_cut_point_of_their_own(spark):
    rows = [(g, s, s % 7) for g, n in (("big", 25), ("small", 3)) for s in range(n) for _ in range(2)]
    d = spark.createDataFrame([(g, f"{g}{s}", v) for g, s, v in rows], "grp string, stay string, score int")
    out = {r["grp"]: r["own_threshold"] for r in SC.group_cut_points(d, "stay", "grp", n_boot=10).collect()}
    assert out == {"big": True, "small": False}


def test_forward_fill_flags(spark):
    g = spark.createDataFrame([(1, 0, 5.0), (1, 3, None), (1, 4, 7.0), (2, 9, None)], "s int, hour long, x double")
    out = [(r["x"], r["x_was_imputed"], r["x_hours_since_last_obs"]) for r in ffill_flagged(g, ["s"], "hour", ["x"]).orderBy("s", "hour").collect()]
    assert out == [(5.0, False, 0), (5.0, True, 3), (7.0, False, 0), (None, False, None)]


def test_boundary_difference_is_not_elapsed_time(spark):
    d = spark.createDataFrame([(D(2020, 12, 31, 0, 59), D(2021, 1, 1, 1, 1))], "a timestamp_ntz, b timestamp_ntz")
    r = d.select(*[compat.date_diff_boundaries(u, "a", "b").alias(u) for u in ("year", "day", "hour")]).first()
    assert (r["year"], r["day"], r["hour"]) == (1, 1, 25)


def test_strict_greatest(spark):
    r = spark.createDataFrame([(1, None)], "a int, b int").select(compat.greatest_strict("a", "b").alias("s"), F.greatest("a", "b").alias("l")).first()
    assert r["s"] is None and r["l"] == 1


def test_code_chapters(spark):
    rows = [("I21", 10, "Circulatory"), ("4280", 9, "Circulatory"), ("V45", 9, "Factors/Encounter"), ("E88", 9, "External causes"), ("x?", 9, "Unknown"), (None, 10, "Unknown"), ("001", None, "Unknown")]
    d = spark.createDataFrame(rows, "c string, v int, want string")
    assert all(r["want"] == r["got"] for r in d.withColumn("got", chapter(F.col("c"), F.col("v"))).collect())
    one = spark.createDataFrame([("43491", 9)], "c string, v int").select(prefix_flag(F.col("c"), F.col("v"), "430-438", "I60-I69").alias("f")).first()
    assert one["f"] == 1


def test_interpolation_stops_at_gaps(spark):
    d = spark.createDataFrame([(1, at(0), 0.0), (1, at(1), 10.0), (1, at(5), 20.0), (1, at(6), 30.0)], "k int, ts timestamp_ntz, v double")
    out = [(r["at"], r["v"]) for r in interpolate(d, ["k"], "ts", "v", 1800, 2 * 3600).orderBy("at").collect()]
    assert out == [(at(0), 0.0), (at(0.5), 5.0), (at(1), 10.0), (at(5.5), 25.0), (at(6), 30.0)]


def test_path_drops_repeats(spark):
    d = spark.createDataFrame([(1, at(0), "A"), (1, at(30), "A"), (1, at(60), "B"), (1, at(90), "A")], "k int, ts timestamp_ntz, u string")
    assert path_string(d, ["k"], "ts", "u").first()["path"] == "A -> B -> A"


def test_alerts_split_at_the_calendar_bucket(spark):
    raised = [(1, "t", T0 + H(hours=3, minutes=50)), (1, "t", T0 + H(hours=4, minutes=5)), (1, "t", T0 + H(hours=4, minutes=9)), (1, "t", T0 + H(hours=7))]
    d = spark.createDataFrame([(p, k, ts, "high") for p, k, ts in raised], "p int, k string, ts timestamp_ntz, sev string")
    out = sorted((r["bucket"], r["repeat_count"], r["status"]) for r in AL.dedup_alerts(d, "p", "k", "ts", "sev").collect())
    assert out == [(T0, 1, "active"), (at(4), 3, "escalated")]


def test_acknowledged_alert_does_not_absorb(spark):
    log = [(1, "t", at(1), "raise"), (1, "t", at(1.5), "acknowledge"), (1, "t", at(2), "raise")]
    d = spark.createDataFrame([(p, k, ts, e, "high") for p, k, ts, e in log], "p int, k string, ts timestamp_ntz, e string, sev string")
    out = sorted((r["raised_at"], r["status"]) for r in AL.alert_history(d, "p", "k", "ts", "e", "sev").collect())
    assert out == [(at(1), "acknowledged"), (at(2), "active")]


def test_lead_time_is_strictly_before(spark):
    a = spark.createDataFrame([(1, at(2)), (1, at(5))], "s int, raised_at timestamp_ntz")
    e = spark.createDataFrame([(1, at(5)), (2, at(1))], "s int, event_time timestamp_ntz")
    out = {r["s"]: r["lead_h"] for r in AL.lead_time(a, e, "s", "raised_at", "event_time").collect()}
    assert out == {1: 3.0, 2: None}


def test_first_event_and_censoring(spark):
    a = spark.createDataFrame([(1, at(5))], "stay_id int, event_time timestamp_ntz")
    b = spark.createDataFrame([(1, at(5)), (2, at(9))], "stay_id int, event_time timestamp_ntz")
    ev = L.first_event({"z": a, "b": b})
    assert {(r["stay_id"], r["event_type"]) for r in ev.collect()} == {(1, "b"), (2, "b")}
    grid = spark.createDataFrame([(1, h) for h in (0, 4, 5, 6)] + [(3, 0)], "stay_id int, hour long")
    anchors = spark.createDataFrame([(1, T0), (3, T0)], "stay_id int, icu_intime timestamp_ntz")
    out = sorted((r["stay_id"], r["hour"], r["label_6h"]) for r in L.at_risk_labels(grid, anchors, ev, [6]).collect())
    assert out == [(1, 0, 1), (1, 4, 1), (3, 0, 0)]


def test_return_cohort_rules(spark):
    day = lambda d: T0 + H(days=d)
    adm = [(1, 1, day(0), day(5), 0, "HOME"), (1, 2, day(20), day(22), 0, "HOSPICE"), (1, 3, day(400), day(401), 1, "DIED"), (2, 4, day(0), day(1), 0, "HOME")]
    a = spark.createDataFrame(adm, "subject_id int, hadm_id int, admittime timestamp_ntz, dischtime timestamp_ntz, hospital_expire_flag int, discharge_location string")
    p = spark.createDataFrame([(1, None, "F", 50), (2, day(10), "M", 60)], "subject_id int, dod timestamp_ntz, gender string, anchor_age int")
    naive = {r["hadm_id"]: r for r in L.return_cohort(a, p, strict=False).collect()}
    assert set(naive) == {1, 2, 4} and naive[1]["readmit_30d"] == 1 and naive[2]["n_prior_admissions"] == 1
    assert naive[2]["n_prior_admissions_365d"] == 1 and naive[4]["excluded_died_before_readmit"]
    assert [r["hadm_id"] for r in L.return_cohort(a, p).collect()] == [1]


def test_every_resource_kind_is_shaped(spark):
    from wardspan.plans import resources as R

    row = spark.sql(
        """select 1 as subject_id, 10 as hadm_id, 100 as stay_id, 'M' as gender, timestamp_ntz'2150-01-01 00:00:00' as admittime, cast(null as timestamp_ntz) as dischtime,
        'EW EMER.' as admission_type, 2 as seq_num, 'I21' as icd_code, 10 as icd_version, 'a  b' as long_title, date'2150-01-01' as chartdate, 'Sodium  Chloride' as drug, cast(null as string) as route,
        timestamp_ntz'2150-01-01 00:00:00' as starttime, 'sys' as code_system, 'c' as code, '' as display, 'ICUStay/1' as patient_ref, timestamp_ntz'2150-01-01 00:00:00' as effective_time, 1.5D as value, 'u' as unit,
        'd1' as device_id, array('imputed') as quality_flags, 'high' as tier_icu, array('why') as reason, 'Discharge' as note_type, 'text [F001]' as note_text, 'watch' as device_type,
        timestamp_ntz'2150-01-01 00:00:00' as ecg_time, 5 as study_id, 'a9' as alert_id, timestamp_ntz'2150-01-01 00:00:00' as sent, 'msg' as message"""
    )
    kinds = "Patient Encounter Condition Procedure MedicationAdministration Observation RiskAssessment DocumentReference Device DiagnosticReport Communication".split()
    import json

    out = {k: json.loads(R.to_resources(row, k).first()["resource"]) for k in kinds}
    assert all(v["resourceType"] == k for k, v in out.items())
    assert out["MedicationAdministration"]["medicationCodeableConcept"]["coding"][0] == {"system": "urn:record:drug-name", "code": "Sodium Chloride", "display": "Sodium  Chloride"}
    assert out["Encounter"]["class"] == "EMER" and out["Encounter"]["status"] == "in-progress" and "dosage" not in out["MedicationAdministration"]
    assert out["Observation"]["note"][0]["text"] == "quality_flags: imputed"
    both = R.to_resources(row, "Condition").select("hadm_id", "seq_num", "resource").unionByName(R.to_resources(row, "Procedure").select("hadm_id", "seq_num", "resource"))
    assert R.bundles(both, "hadm_id", "seq_num").first()["n"] == 2 and R.bundles(both, "hadm_id", "seq_num").count() == both.count()
