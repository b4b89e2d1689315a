"""Metrics, resampling, neighbours and text helpers against brute force."""

import json
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardspan.evaluation import metrics as M
from wardspan.evaluation import synthetic as Y
from wardspan.functions import text as X
from wardspan.operators import quality as Q
from wardspan.operators import sampling as S


def auroc(y, s):
    p, n = s[y == 1], s[y == 0]
    return float(((p[:, None] > n[None, :]) + 0.5 * (p[:, None] == n[None, :])).mean())


@pytest.fixture(scope="module")
def scores():
    rng = np.random.default_rng(1)
    n = 400
    y = rng.integers(0, 2, n)
    s = (rng.normal(size=n) + y).round(1)
    return y, s, rng.integers(0, 40, n)


def frame(spark, scores):
    y, s, g = scores
    return spark.createDataFrame([(1, int(a), float(b), int(c)) for a, b, c in zip(y, s, g)], "k int, y int, score double, grp int")


def test_rank_metrics(spark, scores):
    y, s, _ = scores
    r = M.ranked_metrics(frame(spark, scores), ["k"]).first()
    assert r["auroc"] == pytest.approx(auroc(y, s))
    order = np.unique(s)[::-1]
    ap, before = 0.0, 0.0
    for t in order:
        tp, k = ((s >= t) & (y == 1)).sum(), (s >= t).sum()
        rec = tp / y.sum()
        ap += (rec - before) * tp / k
        before = rec
    assert r["auprc"] == pytest.approx(ap)


def test_single_class_has_no_ranking(spark):
    r = M.ranked_metrics(spark.createDataFrame([(1, 1, 0.2), (1, 1, 0.4)], "k int, y int, score double"), ["k"]).first()
    assert r["auroc"] is None and r["auprc"] is None


def test_bootstrap_draws_whole_groups(spark, scores):
    t = S.bootstrap_counts(frame(spark, scores), "grp", [], 25, 3)
    n = frame(spark, scores).select("grp").distinct().count()
    assert {r["n"] for r in t.groupBy("replicate").agg(F.sum("times").alias("n")).collect()} == {n}
    again = S.bootstrap_counts(frame(spark, scores), "grp", [], 25, 3)
    assert sorted(map(tuple, t.collect())) == sorted(map(tuple, again.collect()))


def test_interval_contains_the_point(spark, scores):
    ci = M.boot_ci(frame(spark, scores), ["k"], "grp", "auroc", 60).first()
    assert ci["lo"] < auroc(*scores[:2]) < ci["hi"]


def test_no_group_spans_folds(spark, scores):
    f = S.grouped_folds(frame(spark, scores), "y", "grp", 5, 3)
    assert f.groupBy("repeat", "grp").agg(F.countDistinct("fold").alias("n")).filter("n > 1").count() == 0
    assert f.select("fold").distinct().count() == 5


def test_budget_flags_ties(spark):
    d = spark.createDataFrame([(v,) for v in [9.0, 8.0, 8.0, 8.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0]], "s double")
    assert S.budget_flag(d, "s", 0.2).filter("flagged").count() == 4


def test_samples_do_not_depend_on_order(spark):
    a = spark.range(0, 500)
    b = a.orderBy(F.col("id").desc())
    pick = lambda d: sorted(r["id"] for r in S.seeded_sample(d, "id", 20, 5).collect())
    assert pick(a) == pick(b) and len(pick(a)) == 20


def test_nearest_is_exact(spark):
    rng = np.random.default_rng(0)
    t, p = rng.normal(size=(130, 6)), np.vstack([rng.normal(size=(90, 6)), rng.normal(size=(60, 6)) + 8])
    d = lambda m: spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, v array<double>")
    got = {r["id"]: (r["distance"], r["near"]) for r in Y.nearest(d(t), d(p), "id", "v", neighbour="near", block=16).collect()}
    dist = np.linalg.norm(t[:, None] - p[None], axis=2)
    assert len(got) == len(t)
    for i in range(len(t)):
        assert got[i][0] == pytest.approx(dist[i].min()) and got[i][1] == int(dist[i].argmin())


def test_imputed_values_come_from_the_column(spark):
    d = spark.createDataFrame([(i, float(i % 3) if i % 4 else None) for i in range(60)], "id int, x double")
    out = S.marginal_impute(d, ["x"], "id")
    assert out.filter("x is null").count() == 0 and out.filter("x not in (0.0, 1.0, 2.0)").count() == 0


def test_hash_chain_finds_the_first_break(spark):
    import hashlib

    rows, prev = [], "0" * 64
    for i in range(1, 9):
        own = hashlib.sha256(f"a{i}|b|{prev}".encode()).hexdigest()
        rows.append((1, i, f"a{i}", "b", prev, own))
        prev = own
    cols = "c int, seq long, x string, y string, prev_hash string, row_hash string"
    good = Q.verify_hash_chain(spark.createDataFrame(rows, cols), ["c"], "seq", ["x", "y"], slice_rows=3).first()
    assert good["intact"] and good["first_broken"] is None
    rows[4] = (*rows[4][:2], "tampered", *rows[4][3:])
    bad = Q.verify_hash_chain(spark.createDataFrame(rows, cols), ["c"], "seq", ["x", "y"], slice_rows=3).first()
    assert not bad["intact"] and bad["first_broken"] == 5


NUMBER = re.compile(r"(?<![A-Za-z])-?\d+(?:\.\d+)?(?![A-Za-z])")


def test_number_grounding_on_whole_texts(spark):
    texts = ["HR 88, SpO2 93 and NEWS2 of 7.4; 12a -5.5", "none", "temp 38.25 (was 36.9) 120/80"]
    src = [88.0, 93.4, 36.9, 80.0]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    out = d.select("i", X.ground_numbers(F.col("t"), F.array(*[F.lit(v) for v in src])).alias("g")).orderBy("i").collect()
    for r, t in zip(out, texts):
        want = [float(x) for x in NUMBER.findall(t)]
        assert r["g"]["n_numbers"] == len(want)
        assert r["g"]["n_grounded"] == sum(any(abs(n - s) <= 0.5 for s in src) for n in want)


def walk(v):
    if isinstance(v, bool) or v is None:
        return []
    if isinstance(v, (int, float)):
        return [float(v)]
    if isinstance(v, str):
        return [float(x) for x in NUMBER.findall(v)]
    return [x for item in (v.values() if isinstance(v, dict) else v) for x in walk(item)]


def test_grounding_in_nested_facts(spark):
    facts = [
        json.dumps({"a": [1, {"b": [[2.5, True], "x 7 of -12a"]}], "c": None, "d": {"e": {"f": 1e3}}}),
        "[]", '"only 5"', "no json {", None, json.dumps([[i] for i in range(300)]), json.dumps({"big": 123456789012345678901, "neg": -0.25}),
    ]
    texts = ["1 2.9 3.1 -1 8 1000.5 1000.51", "4", "5.5 5.5 5.6", "1", "2", "299.4 300.6 150 none", None]
    d = spark.createDataFrame(list(zip(range(7), facts, texts)), "i int, j string, t string")
    nums = X.json_numbers(d, "i", "j")
    got = {}
    for r in nums.collect():
        got.setdefault(r.i, []).append(r.number)
    for i, f in enumerate(facts):
        want = [] if f is None or i == 3 else walk(json.loads(f))
        assert sorted(got.get(i, [])) == pytest.approx(sorted(want)), i
    for r in X.ground_against(d, nums, "i", "t").collect():
        stated = [float(x) for x in NUMBER.findall(texts[r.i] or "")]
        near = sum(any(abs(n - s) <= 0.5 for s in got.get(r.i, [])) for n in stated)
        assert (r.n_numbers, r.n_grounded) == (len(stated), near), r
        assert r.grounded_rate == (near / len(stated) if stated else 1.0)
    assert X.json_numbers(d.limit(0), "i", "j").count() == 0


def test_sentences_and_citations(spark):
    body = "[F001] Stable. [F002, F003] Worse today.\n- bullet line\n\nEnd. ok"
    led = X.ledger(spark.createDataFrame([(1, body)], "n int, b string"), "n", "b").orderBy("sentence_idx").collect()
    assert [r["text"] for r in led] == ["[F001] Stable.", "[F002, F003] Worse today.", "- bullet line", "End. ok"]
    assert [r["cited"] for r in led] == [["F001"], ["F002", "F003"], [], []]


def test_scaling_constant_column(spark):
    out = Q.minmax_scale(spark.createDataFrame([(1.0, 4.0), (3.0, 4.0)], "a double, b double"), ["a", "b"]).collect()
    assert sorted((r["a"], r["b"]) for r in out) == [(0.0, 0.5), (1.0, 0.5)]


def test_log_is_finite():
    assert math.isfinite(math.log(2.2250738585072014e-308))


def _scores(spark, n=400, units=30, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(int(u), int(y), float(round(s, 2)), "ab"[int(u) % 2]) for u, y, s in zip(rng.integers(0, units, n), rng.random(n) < 0.4, rng.random(n))]
    return rows + [(99, 1, 0.5, None)], "u long, y int, s double, g string"


def test_bootstrap_arrays_are_the_counts(spark):
    d = spark.createDataFrame(*_scores(spark))
    rows = S.bootstrap_counts(d, "u", ["g"], 40, 7).collect()
    want = {(r["g"], r["u"], r["replicate"]): r["times"] for r in rows}
    got = {}
    for r in S.bootstrap_arrays(d, "u", ["g"], 40, 7).collect():
        got |= {(r["g"], r["u"], i + 1): int(k) for i, k in enumerate(np.frombuffer(r["times"], "<i4")) if k}
    assert {k: v for k, v in got.items() if k[0] is not None} == want
    # a NULL stratum is one like any other: its only unit is drawn every time
    assert [got[None, 99, r] for r in range(1, 41)] == [1] * 40
    sizes = {g: len({u for u, _, _, h in _scores(spark)[0] if h == g}) for g in "ab"}
    for g in "ab":
        assert all(sum(v for (h, _, r), v in got.items() if h == g and r == k) == sizes[g] for k in range(1, 41))


@pytest.mark.parametrize("rows", [65_536, 25])
def test_boot_metric_equals_repeated_rows(spark, rows, monkeypatch):
    """Every replicate against plain counting over the drawn rows, in one slice and in many."""
    sliced = S.value_slices
    monkeypatch.setattr(M, "value_slices", lambda df, keys, value: sliced(df, keys, value, rows=rows, most=64))
    data, schema = _scores(spark)
    d = spark.createDataFrame(data, schema).filter("g is not null")
    times = {}
    for r in S.bootstrap_counts(d, "u", ["g"], 12, 3).collect():
        times[r["g"], r["u"], r["replicate"]] = r["times"]
    for r in M.boot_metric(d, ["g"], "u", 12, 3, "y", "s", precision=True).collect():
        drawn = [(s, y, w) for u, y, s, g in data if g == r["g"] and (w := times.get((g, u, r["replicate"])))]
        pos, neg = [(s, w) for s, y, w in drawn if y], [(s, w) for s, y, w in drawn if not y]
        p, n = sum(w for _, w in pos), sum(w for _, w in neg)
        auc = sum(w * v * ((a > b) + 0.5 * (a == b)) for a, w in pos for b, v in neg) / (p * n)
        ap = sum(w * sum(x for b, x in pos if b >= a) / sum(x for b, _, x in drawn if b >= a) for a, w in pos) / p
        brier = sum(w * (s - y) ** 2 for s, y, w in drawn) / (p + n)
        assert (r["n_rows"], r["n_positives"]) == (p + n, p)
        assert r["auroc"] == pytest.approx(auc) and r["auprc"] == pytest.approx(ap) and r["brier"] == pytest.approx(brier)
