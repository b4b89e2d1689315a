"""The bucketed scan against pandas, with one key holding a third of the rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wardspan.operators import scan as S


@pytest.fixture(scope="module")
def skewed():
    rng = np.random.default_rng(3)
    n = 600
    key = np.where(np.arange(n) % 3 == 0, 0, rng.integers(1, 12, n))
    pdf = pd.DataFrame({"k": key, "t": rng.permutation(n) * 7, "v": rng.normal(size=n).round(3)})
    pdf["w"] = pdf["v"].where(rng.random(n) > 0.4)
    return pdf.sort_values(["k", "t"]).reset_index(drop=True)


def frame(spark, pdf):
    d = spark.createDataFrame(pdf[["k", "t", "v"]])
    w = pdf["w"].where(pdf["w"].notna(), None)
    return d.join(spark.createDataFrame([(int(a), int(b), None if x is None or x != x else float(x)) for a, b, x in zip(pdf.k, pdf.t, w)], "k long, t long, w double"), ["k", "t"])


def test_prefix_scan_equals_pandas(spark, skewed):
    specs = {
        "rs": ("sum", "v"), "mx": ("max", "v"), "mn": ("min", "v"), "lw": ("last", "w"), "pv": ("prev", "w"), "nv": ("next", "v"),
        "ns": ("next_seen", "w"), "tot": ("total", "v"),
    }
    bucket = F.floor(F.col("t") / 200).cast("long")
    got = S.prefix_scan(frame(spark, skewed), ["k"], ["t"], bucket, specs).toPandas().sort_values(["k", "t"]).reset_index(drop=True)
    g = skewed.groupby("k")
    np.testing.assert_allclose(got["rs"], g["v"].cumsum())
    np.testing.assert_allclose(got["mx"], g["v"].cummax())
    np.testing.assert_allclose(got["mn"], g["v"].cummin())
    np.testing.assert_allclose(got["lw"].astype(float), g["w"].ffill(), equal_nan=True)
    np.testing.assert_allclose(got["pv"].astype(float), g["w"].shift(1), equal_nan=True)
    np.testing.assert_allclose(got["nv"].astype(float), g["v"].shift(-1), equal_nan=True)
    np.testing.assert_allclose(got["ns"].astype(float), g["w"].transform(lambda s: s.bfill().shift(-1)), equal_nan=True)
    np.testing.assert_allclose(got["tot"], g["v"].transform("sum"))


def test_row_frames_cross_blocks(spark, skewed):
    bucket = F.floor(F.col("t") / 300).cast("long")
    out = S.rolling_rows(frame(spark, skewed), ["k"], ["t"], bucket, -3, 0, {"m": F.avg("v")}, block=5)
    got = out.toPandas().sort_values(["k", "t"])["m"].to_numpy()
    want = skewed.groupby("k")["v"].rolling(4, min_periods=1).mean().to_numpy()
    np.testing.assert_allclose(got, want)


def test_row_frame_excluding_current(spark, skewed):
    bucket = F.floor(F.col("t") / 300).cast("long")
    out = S.rolling_rows(frame(spark, skewed), ["k"], ["t"], bucket, -4, -1, {"m": F.max("v")}, block=6)
    got = out.toPandas().sort_values(["k", "t"])["m"].to_numpy(dtype=float)
    want = skewed.groupby("k")["v"].transform(lambda s: s.shift(1).rolling(4, min_periods=1).max()).to_numpy()
    np.testing.assert_allclose(got, want, equal_nan=True)


def test_range_frames_cross_slices(spark, skewed):
    out = S.rolling_range(frame(spark, skewed), ["k"], F.col("t"), -100, -1, {"n": F.count(F.lit(1))}, slice_width=130)
    got = out.toPandas().sort_values(["k", "t"])["n"].to_numpy()
    want = []
    for _, g in skewed.groupby("k"):
        t = g["t"].to_numpy()
        want += [int(((t < x) & (t >= x - 100)).sum()) for x in t]
    assert list(got) == want


def test_range_frame_includes_peers(spark):
    d = spark.createDataFrame([(1, 10, 1.0), (1, 10, 2.0), (1, 11, 4.0)], "k int, t long, v double")
    out = S.rolling_range(d, ["k"], F.col("t"), -5, 0, {"s": F.sum("v")}).toPandas()
    assert sorted(out["s"]) == [3.0, 3.0, 7.0]


def test_percentiles_are_linear_and_exact(spark, skewed):
    got = S.exact_percentiles(frame(spark, skewed), ["k"], "v", {"a": 0.75, "b": 0.1}).toPandas().set_index("k").sort_index()
    want = skewed.groupby("k")["v"].quantile([0.75, 0.1]).unstack()
    np.testing.assert_allclose(got["a"], want[0.75])
    np.testing.assert_allclose(got["b"], want[0.1])


def test_value_slices_are_monotone(spark):
    vals = sorted([-1e9, -3.5, -0.2, -1e-7, 0.0, 1e-7, 0.3, 2.0, 2.01, 500.0, 1e12])
    d = S.value_slices(spark.createDataFrame([(v,) for v in vals], "v double"), [], "v", rows=2, most=8)
    got = [r[S.SLICE] for r in d.orderBy("v").collect()]
    assert got == sorted(got) and 4 <= len(set(got)) <= 8


def test_weighted_percentile_equals_repeated_rows(spark):
    d = spark.createDataFrame([(1, 2.0, 3), (1, 5.0, 1), (1, 9.0, 2)], "g int, v double, n int")
    got = S.exact_percentiles(d, ["g"], "v", {"p": 0.6}, F.col("n")).first()["p"]
    assert got == pytest.approx(np.quantile([2, 2, 2, 5, 9, 9], 0.6))


def test_null_keys_and_null_order_are_groups(spark):
    rows = [(None, None, 1), (None, 5, 1), (None, 50, 1), (1, 5, 1), (1, 50, 1), (1, None, 1)]
    d = spark.createDataFrame(rows, "k int, t int, v int")
    out = S.prefix_scan(d, ["k"], ["t"], F.floor(F.col("t") / 10).cast("long"), {"run": ("sum", "v"), "all": ("total", "v")}).collect()
    assert sorted((str(r["k"]), str(r["t"]), r["run"], r["all"]) for r in out) == [
        ("1", "5", 2, 3), ("1", "50", 3, 3), ("1", "None", 1, 3), ("None", "5", 2, 3), ("None", "50", 3, 3), ("None", "None", 1, 3)]


def test_values_out_of_the_ordinary(spark):
    nan, inf = float("nan"), float("inf")
    d = spark.createDataFrame([(1, x) for x in (nan, inf, -inf, 1e300, -1e300, 0.0, 0.5, None)], "k int, v double")
    out = S.weighted_ranks(d, ["k"], "v", {"n": F.lit(1)}).orderBy("v").collect()
    assert [r["n_upto"] for r in out] == list(range(1, 8)) and out[-1]["v"] != out[-1]["v"]
    assert S.exact_percentiles(d, ["k"], "v", {"m": 0.5}).first()["m"] == 0.5


@pytest.mark.parametrize("shape", ["even", "skewed", "one value", "far apart"])
def test_slices_are_about_equal_whatever_the_values(spark, shape):
    """At most ``most`` summary rows, and no slice with many times the mean, on any distribution of distinct values."""
    i = F.col("id")
    v = {"even": 0.5 + i / 200_000, "skewed": F.exp(i / 2_000), "one value": F.when(i < 90_000, 0.0).otherwise(i), "far apart": F.pow(F.lit(-1.0), i) * F.pow(F.lit(1.01), i % 60_000)}[shape]
    d = spark.range(100_000).select(v.cast("double").alias("v")).groupBy("v").count().drop("count")
    rows = d.count()
    n = S.value_slices(d, [], "v", rows=500, most=64).groupBy(S.SLICE).count().agg(F.count("*").alias("slices"), F.max("count").alias("largest")).first()
    assert n["slices"] <= 64 and n["largest"] <= 2 * max(500, rows / 64)


def test_slices_per_key_and_null_keys(spark):
    rows = [(k, float(x)) for k in (None, 1, 2) for x in range(100)] + [(1, None)]
    d = S.value_slices(spark.createDataFrame(rows, "k int, v double"), ["k"], "v", rows=10, most=16)
    got = d.groupBy("k").agg(F.countDistinct(S.SLICE).alias("n"), F.count("*").alias("rows")).collect()
    assert sorted((str(r["k"]), r["rows"]) for r in got) == [("1", 101), ("2", 100), ("None", 100)]
    assert all(8 <= r["n"] <= 16 for r in got)


def test_what_follows_over_a_hundred_thousand_buckets(spark):
    """One key, a bucket per row: linear in the buckets (seconds), where a frame to the end would take minutes."""
    d = spark.range(100_000).select(F.lit(1).alias("k"), "id", F.when(F.col("id") % 3 == 0, F.col("id")).alias("v"))
    out = S.prefix_scan(d, ["k"], ["id"], F.col("id"), {"nx": ("next", "id"), "ns": ("next_seen", "v")})
    wrong = out.filter(~F.col("nx").eqNullSafe(F.when(F.col("id") < 99_999, F.col("id") + 1)) | ~F.col("ns").eqNullSafe(F.when(F.col("id") < 99_999, (F.floor(F.col("id") / 3) + 1) * 3)))
    assert wrong.count() == 0


def test_no_plan_reads_to_the_end(spark):
    """No registered operator of the scan family plans a frame that begins or ends with the last row of its group."""
    d = spark.range(10).select(F.lit(1).alias("k"), "id", F.col("id").cast("double").alias("v"))
    specs = {k: (k, "v") for k in ("sum", "max", "min", "last", "prev", "next", "next_seen", "total")}
    for out in (S.prefix_scan(d, ["k"], ["id"], F.col("id") % 3, specs), S.weighted_ranks(d, ["k"], "v", {"n": F.lit(1)}), S.exact_percentiles(d, ["k"], "v", {"p": 0.5})):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "currentrow$(), unboundedfollowing$()" not in plan and ", 1, unboundedfollowing$()" not in plan
