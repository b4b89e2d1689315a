"""Interval and as-of joins on hand-made frames."""

from datetime import datetime as D
from datetime import timedelta as H

import numpy as np
from pyspark.sql import functions as F

from wardspan.operators import intervals as I
from wardspan.operators import joins as J

T0 = D(2024, 1, 1)


def at(h):
    return T0 + H(hours=h)


def points(spark, rows):
    return spark.createDataFrame([(k, at(h), i) for k, h, i in rows], "k int, ts timestamp_ntz, i int")


def spans(spark, rows):
    return spark.createDataFrame([(k, at(a), at(b), j) for k, a, b, j in rows], "k int, s timestamp_ntz, e timestamp_ntz, j int")


def pairs(df):
    return sorted((r["i"], r["j"]) for r in df.collect())


def test_interval_ends(spark):
    p, s = points(spark, [(1, 0, 1), (1, 5, 2), (1, 30, 3), (2, 5, 4)]), spans(spark, [(1, 0, 5, 10), (1, 5, 40, 11)])
    assert pairs(J.point_in_interval(p, s, ["k"], "ts", "s", "e", (True, False))) == [(1, 10), (2, 11), (3, 11)]
    assert pairs(J.point_in_interval(p, s, ["k"], "ts", "s", "e", (False, True))) == [(2, 10), (3, 11)]
    left = J.point_in_interval(p, s, ["k"], "ts", "s", "e", (True, True), "left")
    assert {(r["i"], r["j"]) for r in left.collect()} == {(1, 10), (2, 10), (2, 11), (3, 11), (4, None)}


def test_overlap_pairs_once_across_days(spark):
    a = spans(spark, [(1, 0, 100, 1)]).withColumnsRenamed({"s": "a0", "e": "a1", "j": "i"})
    b = spans(spark, [(1, 50, 90, 7), (1, 100, 120, 8)])
    assert pairs(J.overlaps(a, b, ["k"], ("a0", "a1"), ("s", "e"))) == [(1, 7)]
    assert pairs(J.overlaps(a, b, ["k"], ("a0", "a1"), ("s", "e"), closed=True)) == [(1, 7), (1, 8)]


def asof(spark, **kw):
    left = points(spark, [(1, 10, 1), (1, 50, 2), (2, 1, 3)])
    right = points(spark, [(1, 8, 100), (1, 10, 101), (1, 47, 102)]).withColumnsRenamed({"ts": "rts", "i": "r"})
    out = J.asof_latest(left, right, ["k"], "ts", "rts", ["r"], **kw)
    return {r["i"]: r["r"] for r in out.collect()}


def test_asof_bounds(spark):
    assert asof(spark) == {1: 101, 2: 102, 3: None}
    assert asof(spark, strict=True) == {1: 100, 2: 102, 3: None}
    assert asof(spark, tolerance_s=2 * 3600) == {1: 101, 2: None, 3: None}
    assert asof(spark, tolerance_s=3 * 3600) == {1: 101, 2: 102, 3: None}
    assert asof(spark, direction="forward") == {1: 101, 2: None, 3: None}
    assert asof(spark, direction="forward", strict=True) == {1: 102, 2: None, 3: None}


def test_fallback_row_is_flagged(spark):
    d = spark.createDataFrame([(1, "a"), (2, "zz")], "i int, g string")
    dim = spark.createDataFrame([("a", 3), ("__pooled__", 9)], "g string, cut int")
    out = {r["i"]: (r["cut"], r["is_fallback"]) for r in J.with_fallback(d, dim, "g", "__pooled__", ["cut"]).collect()}
    assert out == {1: (3, False), 2: (9, True)}


def test_islands_gap_status_and_single_points(spark):
    rows = [(1, 0, "A"), (1, 2, "A"), (1, 16, "A"), (1, 18, "A"), (1, 19, "B"), (1, 25, "A"), (1, 26, "A"), (2, 0, "C")]
    d = spark.createDataFrame([(k, at(h), s) for k, h, s in rows], "k int, ts timestamp_ntz, st string")
    got = sorted((r["k"], r["starttime"], r["endtime"], r["st"]) for r in I.islands(d, ["k"], "ts", "st").collect())
    # 2 -> 16 is 14 hour marks: a new episode; a lone row makes no episode, and an episode ends where the next status begins
    assert got == [(1, at(0), at(2), "A"), (1, at(16), at(19), "A"), (1, at(25), at(26), "A")]


def test_two_overlapping_infusions_give_three_segments(spark):
    d = spark.createDataFrame(
        [(1, at(0), at(10), 0.5, "x"), (1, at(4), at(14), 0.2, "y")], "k int, s timestamp_ntz, e timestamp_ntz, v double, a string"
    )
    out = I.segments(d, ["k"], "s", "e", "v", "a", ["x", "y"]).collect()
    assert sorted((r["s"], r["e"], r["x"], r["y"]) for r in out) == [
        (at(0), at(4), 0.5, None), (at(4), at(10), 0.5, 0.2), (at(10), at(14), None, 0.2),
    ]


def test_trailing_boundary_hours(spark):
    d = spark.createDataFrame([(1, T0 + H(minutes=59), 1.0), (1, T0 + H(hours=5, minutes=1), 2.0), (1, T0 + H(hours=6), 4.0)], "k int, ts timestamp_ntz, v double")
    out = J.boundary_hour_sums(d, ["k"], "ts", {"s": "v"}, {"6h": 5}, {"24h": 23}).orderBy("ts").collect()
    assert [r["s_6h"] for r in out] == [1.0, 3.0, 6.0]
    assert [r["s_24h"] for r in out] == [1.0, 3.0, 7.0]


def test_full_merge_prefers_first(spark):
    a = spark.createDataFrame([(1, 5)], "k int, v int")
    b = spark.createDataFrame([(1, 6), (2, 7)], "k int, v int")
    assert sorted((r["k"], r["v"]) for r in J.full_merge(a, b, ["k"]).collect()) == [(1, 5), (2, 7)]


def test_plan_has_no_cartesian(spark):
    p, s = points(spark, [(1, 0, 1)]), spans(spark, [(1, 0, 5, 10)])
    plan = J.point_in_interval(p, s, ["k"], "ts", "s", "e")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert F is not None


def test_boundary_sums_share_one_shuffle(spark):
    rng = np.random.default_rng(9)
    rows = [(k, D(2024, 1, 1) + H(minutes=int(m)), int(v)) for k in (1, 2) for m, v in zip(rng.integers(0, 20_000, 400), rng.integers(-5, 50, 400))]
    d = spark.createDataFrame(rows + [(None, D(2024, 1, 2), 7)], "k int, ts timestamp_ntz, v int")
    out = J.boundary_hour_sums(d, ["k"], "ts", {"s": "v"}, {"6h": 5, "12h": 11}, {"24h": 23})
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert out.columns == ["k", "ts", "v", "s_6h", "s_12h", "s_24h"]
    hour = lambda t: t.replace(minute=0)
    got = out.filter("k is not null").collect()
    assert len(got) == len(rows)
    for r in got:
        past = [(t, v) for k, t, v in rows if k == r["k"] and t <= r["ts"]]
        assert r["s_6h"] == sum(v for t, v in past if hour(r["ts"]) - hour(t) <= H(hours=5))
        assert r["s_12h"] == sum(v for t, v in past if hour(r["ts"]) - hour(t) <= H(hours=11))
        assert r["s_24h"] == sum(v for t, v in past if r["ts"] - t <= H(hours=23))
