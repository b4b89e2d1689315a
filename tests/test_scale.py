"""Plans and pieces that must not depend on a whole table or group fitting in one place."""

import re
from datetime import datetime as D

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from wardspan.evaluation import analytics as A
from wardspan.operators import intervals as I
from wardspan.operators import joins as J
from wardspan.operators import sampling as S
from wardspan.operators.scan import prefix_scan
from wardspan.plans import facts as FA
from wardspan.plans import features as FT
from wardspan.plans import scoring as SC
from wardspan.plans.concepts import Catalog
from wardspan.queries import icu
from wardspan.queries.registry import Tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lag_copies_are_not_broadcast(spark):
    rows = [(k, h, float((h * (k + 3)) % 7)) for k in range(3) for h in range(30)]
    out = A.autocorr(spark.createDataFrame(rows, "k int, h long, v double"), "k", "h", "v", 4, 24, 3)
    got = {r["lag"]: (r["acf"], r["n_entities"]) for r in out.collect()}
    for lag in range(5):
        per = [pd.Series([v for j, _, v in rows if j == k]) for k in range(3)]
        want = sum(x.corr(x.shift(lag)) for x in per) / 3
        assert got[lag][1] == 3 and abs(got[lag][0] - want) < 1e-9
    copies = re.search(r"\w+ \[k#\d+, h#\d+L\], \[k#\d+, h#\d+L\]", plan(out))
    assert copies and copies[0].startswith("SortMergeJoin")


def test_copies_of_spans_are_not_broadcast(spark):
    points = spark.createDataFrame([(1, D(2024, 1, 2, 1), 7)], "k int, ts timestamp_ntz, i int")
    spans = spark.createDataFrame([(1, D(2024, 1, 1), D(2024, 1, 3), 8)], "k int, s timestamp_ntz, e timestamp_ntz, j int")
    other = spans.toDF("k", "s2", "e2", "j2")
    for df in (
        J.point_in_interval(points, spans, ["k"], "ts", "s", "e"), J.overlaps(spans, other, ["k"], ("s", "e"), ("s2", "e2")),
        J.interval_within(spans, other, ["k"], ("s", "e"), ("s2", "e2")),
    ):
        assert "BroadcastHashJoin" not in plan(df) and "SortMergeJoin" in plan(df)
        assert df.count() == 1


def test_units_of_one_slice_are_added_up_in_blocks(spark, monkeypatch):
    rows = [("a", u, u % 3) for u in range(60)] + [("b", u, 1) for u in range(3)] + [(None, 1, 1), ("a", None, 2)]
    df = spark.createDataFrame(rows, "g string, u int, v int")
    whole = sorted(tuple(r) for r in S.drawn_weights(df, ["g"], "u", "v", 20, 3).collect())
    sizes = []
    kept = S.stored

    def seen(d, label):
        out = kept(d, label)
        if label == "unit-blocks":
            sizes.extend(tuple(r) for r in out.collect())
        return out

    monkeypatch.setattr(S, "_FOLD_UNITS", 8)
    monkeypatch.setattr(S, "stored", seen)
    assert sorted(tuple(r) for r in S.drawn_weights(df, ["g"], "u", "v", 20, 3).collect()) == whole
    assert sizes == [("a", 8)]
    assert len(whole) == len({r[:3] for r in whole})


def test_item_filter_reaches_the_items(spark, tmp_path):
    spark.sql("select id as c_custkey from range(8)").write.parquet(f"{tmp_path}/customer.parquet")
    spark.sql("select id as o_orderkey, id % 8 as o_custkey from range(20)").write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql(
        "select id % 20 as l_orderkey, id as l_partkey, id % 5 as l_suppkey, cast(id % 4 as int) as l_linenumber, cast(id % 50 as double) as l_quantity, "
        "id * 1.5D as l_extendedprice, 0.05D as l_discount from range(200)").write.parquet(f"{tmp_path}/lineitem.parquet")
    kept = []
    raw = icu.spark_raw(Tables(spark, str(tmp_path)), lambda df: kept.append(df) or df)
    assert len(kept) == 1 and kept[0].count() == 200
    for name, code in (("chartevents", 226732), ("labevents", 51003)):
        one = raw[name].filter(f"itemid = {code}")
        optimized = one._jdf.queryExecution().optimizedPlan().toString()
        # the items are cut to one code while planning, so no filter on it is left for the rows
        assert f"= {code})" not in optimized and "LocalRelation" in optimized
        everything = [tuple(r) for r in raw[name].collect() if r["itemid"] == code]
        assert everything and sorted(map(str, everything)) == sorted(str(tuple(r)) for r in one.collect())


def test_event_values_are_made_without_decimals(spark, tmp_path):
    spark.sql("select id as c_custkey from range(8)").write.parquet(f"{tmp_path}/customer.parquet")
    spark.sql("select id as o_orderkey, id % 8 as o_custkey from range(20)").write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql(
        "select id % 20 as l_orderkey, id as l_partkey, id % 5 as l_suppkey, cast(id % 4 as int) as l_linenumber, cast(id % 50 as double) as l_quantity, "
        "id * 1.5D as l_extendedprice, 0.05D as l_discount from range(200)").write.parquet(f"{tmp_path}/lineitem.parquet")
    raw = icu.spark_raw(Tables(spark, str(tmp_path)), lambda df: spark.createDataFrame(df.collect(), df.schema))
    for name, value in (("chartevents", "valuenum"), ("labevents", "valuenum"), ("inputevents", "amount")):
        assert "decimal" not in raw[name].select(value)._jdf.queryExecution().optimizedPlan().toString()
        tenths = [r[0] for r in raw[name].select(value).collect() if r[0] is not None]
        assert tenths and all(v == round(v, 2) for v in tenths)


def test_scored_hours_are_made_once(spark, monkeypatch):
    labels = []
    kept = SC.stored
    monkeypatch.setattr(SC, "stored", lambda df, label: labels.append(label) or kept(df, label))
    at = D(2024, 1, 1)
    c = Catalog(spark, {
        "icustays": spark.createDataFrame([(s, at) for s in range(3)], "stay_id int, intime timestamp_ntz"),
        "inputevents": spark.createDataFrame([(1, 222168, at, D(2024, 1, 1, 2))], "stay_id int, itemid int, starttime timestamp_ntz, endtime timestamp_ntz"),
    })
    rows = [(s, h, 80.0 + 25 * s, 15.0 - 3 * (h == 2)) for s in range(3) for h in range(4)]
    grid = spark.createDataFrame(rows, "stay_id int, hour int, hr double, gcs_total double")
    grid = grid.withColumns({x: F.lit(v) for x, v in (("rr", 16.0), ("spo2", 97.0), ("sbp", 120.0), ("map", 80.0), ("temp_c", 37.0), ("fio2", 0.21), ("glucose", 100.0))})
    g, th = SC.news2(c, grid, spark.createDataFrame([(0, "a"), (1, "a")], "stay_id int, dx_chapter string"))
    assert labels == ["scored-hours", "thresholds"]
    assert g.count() == 12 and [r["dx_group"] for r in th.collect()] == [SC.POOLED]
    # neither result makes the scores again
    assert "Window" not in plan(g)


def test_values_of_one_time_are_counted_before_they_are_copied(spark):
    at = lambda h: D(2024, 1, 1, h)
    stays = spark.createDataFrame([(7, 1, at(0)), (7, 2, at(2)), (8, 3, at(0))], "hadm_id int, stay_id int, icu_intime timestamp_ntz")
    labs = spark.createDataFrame([(7, at(1))] * 5 + [(7, at(3))] * 2 + [(7, None), (None, at(1))], "hadm_id int, charttime timestamp_ntz")
    grid = spark.createDataFrame([(s, h) for s in (1, 2, 3) for h in range(6)], "stay_id int, hour int")
    out = FT.add_lab_intensity(grid, labs, stays)
    got = {(r["stay_id"], r["hour"]): (r["lab_orders_4h"], r["lab_orders_24h"], r["lab_order_rate_ratio"]) for r in out.collect()}
    assert got[1, 0] == (0, 0, 0.0) and got[1, 1][:2] == (5, 5) and got[1, 5][:2] == (2, 7)
    assert got[2, 0][:2] == (5, 5) and got[2, 1][:2] == (7, 7) and got[3, 5] == (0, 0, 1.0)
    assert abs(got[1, 5][2] - (7 / 24) / (8 / 6)) < 1e-12
    # the counts of the specimens are made below the stacked copies
    assert re.search(r"HashAggregate\(keys=\[hadm_id#\d+, charttime#\d+\]", plan(out))


def test_facts_are_made_once(spark):
    rows = spark.createDataFrame([(1, "b", "t1"), (1, "a", "t2"), (2, "c", None)], "hadm_id int, k string, text string")
    made = [FA.family(rows, n, F.col("k"), "t", F.col("k"), "k", F.col("text")) for n in (2, 1)]
    out = FA.number_facts(made)
    assert sorted((r["family"], r["text"], r["fact_id"]) for r in out.collect()) == [(1, "t1", "F002"), (1, "t2", "F001"), (2, "t1", "F004"), (2, "t2", "F003")]
    assert "Union" not in plan(out)


def test_a_scan_makes_its_input_once(spark):
    """Both sides of a scan ask for the same rows, also when a later step drops columns, so one shuffle serves both."""
    d = spark.range(200).selectExpr("id % 3 as k", "id as t", "id * 2 as v", "cast(id as string) as unused")
    d = prefix_scan(d, ["k"], ["t"], F.floor(F.col("t") / 50).cast("long"), {"s": ("sum", F.col("v")), "p": ("prev", F.col("v"))})
    for x in (d, d.select("k", "s")):
        assert len(x.collect()) == 200
        assert "ReusedExchange" in x._jdf.queryExecution().executedPlan().toString()


def test_a_scan_takes_rows_that_cannot_be_hashed(spark):
    d = spark.range(6).selectExpr("id % 2 as k", "id as t", "map('a', id) as m")
    got = prefix_scan(d, ["k"], ["t"], F.floor(F.col("t") / 2).cast("long"), {"p": ("prev", F.col("t"))}).collect()
    assert sorted((r.t, r.p, r.m["a"]) for r in got) == [(0, None, 0), (1, None, 1), (2, 0, 2), (3, 1, 3), (4, 2, 4), (5, 3, 5)]


def test_a_segment_is_shuffled_with_one_list(spark):
    rows = spark.createDataFrame([(1, 0, 4, "a", 1.0), (1, 2, 6, "b", 2.0), (1, 2, 6, "b", None), (2, 0, 3, "c", 5.0)], "k long, s long, e long, tag string, v double")
    rows = rows.selectExpr("k", "timestamp_seconds(s * 3600) as s", "timestamp_seconds(e * 3600) as e", "tag", "v")
    out = I.segments(rows, ["k"], "s", "e", "v", "tag", ["a", "b"])
    got = sorted(((r.k, r.s.hour, r.e.hour, r.a, r.b) for r in out.collect()), key=str)
    assert got == sorted([(1, 0, 2, 1.0, None), (1, 2, 4, 1.0, 2.0), (1, 2, 4, 1.0, None), (1, 4, 6, None, 2.0), (1, 4, 6, None, None)], key=str)
    # the partial and the final list
    assert out._jdf.queryExecution().sparkPlan().toString().count("collect_list") <= 2


def test_draw_counts_go_out_small(spark):
    for numbers in ([], [0], [3, 0, 255], [256, 1], [70_000, 0], [1 << 40, 2]):
        assert S.unsqueezed(S.squeezed(np.array(numbers, np.int64))).tolist() == numbers
    units = spark.range(300).select((F.col("id") % 2).alias("g"), F.col("id").alias("u"))
    whole = {r["u"]: np.frombuffer(r["times"], "<i4") for r in S.bootstrap_arrays(units, "u", ["g"], 400, 5).collect()}
    small = {r["u"]: r["times"] for r in S.bootstrap_arrays(units, "u", ["g"], 400, 5, small=True).collect()}
    assert whole.keys() == small.keys() and all((S.unsqueezed(small[u]) == whole[u]).all() for u in whole)
    # 400 counts of 32 bits are 1,600 bytes
    assert max(map(len, small.values())) < 250


def test_few_values_are_one_slice_of_any_number_of_units(spark, monkeypatch):
    slices, sliced = [], S.value_slices
    monkeypatch.setattr(S, "value_slices", lambda *a, **k: slices.append(sliced(*a, **k)) or slices[-1])
    df = spark.range(90_000).select(F.lit(1).alias("g"), (F.col("id") % 3_000).alias("u"), F.floor(F.col("id") / 3_000).alias("v"))
    got = S.drawn_weights(df, ["g"], "u", "v", 3, 1).groupBy("replicate").agg(F.sum("weight").alias("n"), F.count("*").alias("k")).collect()
    assert [tuple(r) for r in sorted(got)] == [(i, 90_000, 30) for i in (1, 2, 3)]
    assert len(slices) == 1 and slices[0].select(S.SLICE).distinct().count() == 1


def test_flags_of_scored_hours_come_from_few_columns(spark, monkeypatch):
    """The drop of the coma score reaches few columns; the others, and repeated stays, come back as they were."""
    taken, drop = [], SC.trailing_drop
    monkeypatch.setattr(SC, "trailing_drop", lambda df, *a: taken.append(set(df.columns)) or drop(df, *a))
    at = D(2024, 1, 1)
    c = Catalog(spark, {
        "icustays": spark.createDataFrame([(0, at), (1, at), (1, at), (None, at)], "stay_id int, intime timestamp_ntz"),
        "inputevents": spark.createDataFrame([(1, 222168, at, D(2024, 1, 1, 2))], "stay_id int, itemid int, starttime timestamp_ntz, endtime timestamp_ntz"),
    })
    rows = [(s, h, 80.0 + h, 15.0 - 3 * (h == 2)) for s in (0, 1, 9, None) for h in range(4)]
    grid = spark.createDataFrame(rows, "stay_id int, hour int, hr double, gcs_total double")
    grid = grid.withColumns({x: F.lit(v) for x, v in (("rr", 16.0), ("spo2", 97.0), ("sbp", 120.0), ("map", 80.0), ("temp_c", 37.0), ("fio2", 0.21), ("glucose", 100.0))})
    g, _ = SC.news2(c, grid, spark.createDataFrame([(0, "a")], "stay_id int, dx_chapter string"))
    assert taken == [{"stay_id", "hour", "gcs_total", "sedated"}]
    got = sorted((r["stay_id"], r["hour"], r["hr"], r["sedated"], r["gcs_drop"], r["dx_group"] or "") for r in g.collect())
    want = [(0, h, 80.0 + h, False, h == 2, "a") for h in range(4)]
    want += [(1, h, 80.0 + h, h < 2, h == 2, "") for h in range(4) for _ in range(2)]
    assert got == want


def test_statistics_meet_the_other_features_once(spark, monkeypatch):
    """Flags and lab counts are found without the statistics; repeated rows and defaults come back as before."""
    taken, counts = [], FT.trailing_event_counts
    monkeypatch.setattr(FT, "trailing_event_counts", lambda df, ev, *a: taken.append(set(df.columns)) or counts(df, ev, *a))
    at = lambda h: D(2024, 1, 1, h)
    grid = spark.createDataFrame([(s, h, 70.0 + h) for s in (1, 2) for h in range(4)], "stay_id int, hour long, hr double")
    scores = spark.createDataFrame([(1, 0, 5, "medium", "low")], "stay_id int, hour long, news2 int, tier_ward string, tier_icu string")
    sofa = spark.createDataFrame([(1, 1, 3)], "stay_id int, hr long, sofa_24hours int")
    lines = spark.createDataFrame([(1, "Arterial", at(1), at(2))], "stay_id int, line_type string, starttime timestamp_ntz, endtime timestamp_ntz")
    labs = spark.createDataFrame([(7, at(1)), (7, at(1))], "hadm_id int, charttime timestamp_ntz")
    stays = spark.createDataFrame(
        [(7, 1, at(0), 10, 60, "F", "MICU"), (8, 2, at(0), 11, 70, "M", "CCU"), (8, 2, at(0), 11, 70, "M", "SICU")],
        "hadm_id int, stay_id int, icu_intime timestamp_ntz, subject_id int, admission_age int, gender string, first_careunit string")
    disease = spark.createDataFrame([(1, "a", 2)], "stay_id int, dx_chapter string, charlson_comorbidity_index int")
    out = FT.feature_frame(grid, scores, sofa, lines, labs, stays, disease, ["hr"])
    assert not any("hr" in x for x in taken) and out.columns[:3] == ["stay_id", "hour", "hr"]
    got = sorted((r["stay_id"], r["hour"], r["hr"], r["news2"], r["sofa_24hours"], r["has_arterial_line"], r["lab_orders_4h"], r["dx_chapter"], r["first_careunit"]) for r in out.collect())
    want = [(1, h, 70.0 + h, 5 * (h == 0), 3 * (h == 1), int(h in (1, 2)), 2 * (h >= 1), "a", "MICU") for h in range(4)]
    want += [(2, h, 70.0 + h, 0, 0, 0, 0, "Unknown", u) for h in range(4) for u in ("CCU", "SICU")]
    assert got == want


def test_counts_of_repeated_and_missing_keys(spark):
    grid = spark.createDataFrame([(1, 0.0, "a"), (1, 0.0, "b"), (None, 2.0, "c"), (2, 1.0, "d"), (2, None, "e")], "k int, at double, x string")
    events = spark.createDataFrame([(1, 0.0), (1, -3.0), (None, 1.0), (2, 5.0)], "k int, e double")
    out = FT.trailing_event_counts(grid, events, ["k"], "at", "e", [1, 4], "n_")
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, 0.0, "a", 1, 2), (1, 0.0, "b", 1, 2), (None, 2.0, "c", 0, 1), (2, 1.0, "d", 0, 0)], key=str)
