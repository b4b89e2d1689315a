"""The quality classifier: indicators and ratios against plain counts, the fit against its dual, held-out accuracy."""

import math
import random
import re
import zlib
from itertools import groupby

import numpy as np

from wardspan.llm import quality_classifier as qc

SF = "/root/testdata/sf0.01"


def grams(text):
    """The n-grams of the docstring, spelled out."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    low = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words]
    kind = lambda c: "a" if "a" <= c <= "z" or ord(c) > 127 else "A" if "A" <= c <= "Z" else "0" if "0" <= c <= "9" else c
    outline = ["".join(k for k, _ in groupby(map(kind, w))) for w in words]
    outline = ["same" if i and low[i] == low[i - 1] else (o,) for i, o in enumerate(outline)]
    return {("w", x) for x in low} | {("o", x) for x in outline} | set(zip(low, low[1:])) | {("oo", *x) for x in zip(outline, outline[1:])}


def test_indicators_are_the_ngrams():
    rng = random.Random(2)
    pieces = ["the", "The", "THE!!", "a%%%", "é", "x1", "2024", "--", "|", "of", "straße", "\x00", "word" * 1_500]
    texts = [None, "", " \n\t", *("".join(rng.choice(pieces) + rng.choice([" ", "\n", "\t ", "\x0b"]) for _ in range(rng.randint(1, 60))) for _ in range(80))]
    texts += [texts[10], texts[10] * 2]
    text, ids = qc.indicator_sets(texts, 40)
    for i, t in enumerate(texts):
        mine = ids[text == i]
        assert len(mine) == len(grams(t))
        assert (np.diff(mine) > 0).all()
        alone = qc.indicator_sets([t], 40)[1]
        assert alone.tolist() == mine.tolist()
    a, b = (set(ids[text == i].tolist()) for i in (20, 30))
    assert len(a & b) == len(grams(texts[20]) & grams(texts[30]))


def test_ratios_and_odd_labels(spark):
    s = qc.Settings(bits=14)
    docs = [(i, "good clean prose about things" if i % 3 else "BAD!! BAD!! noise noise") for i in range(240)]
    docs += [(500, None), (501, ""), (None, "no id here"), (0, "BAD!! twice")]
    labels = [(i, int(i % 3 > 0)) for i in range(240)] + [(500, 1), (501, 0), (7, None), (1, 1), (None, 1), (2, 0), (2, 1)]
    table = qc.training_table(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"), s)
    assert table.count() == 243
    known = {}
    for i, y in labels:
        if i is not None and y is not None:
            known.setdefault(i, []).append(y)
    count = np.ones((2, 1 << 14))
    for i, t in docs:
        if i in known:
            count[int(np.mean(known[i]) >= 0.5), qc.indicator_sets([t], 14)[1]] += 1
    want = np.log((count[1] / count[1].sum()) / (count[0] / count[0].sum()))
    assert np.allclose(qc.log_count_ratios(table, s), want)


def test_descent_closes_the_duality_gap():
    rng = np.random.default_rng(4)
    size, rows = 40, []
    for _ in range(200):
        ids = np.sort(rng.choice(size, rng.integers(1, 9), replace=False))
        v = rng.standard_normal(len(ids))
        rows.append((bool(rng.random() < 0.3 + 0.5 * (v.sum() > 0)), ids, v))
    s = qc.Settings(rounds=3_000, tolerance=1e-6, cost=0.5)
    w = qc.descend(rows, size, s)
    margin = np.array([(1 if y else -1) * (w[i] @ v + w[-1]) for y, i, v in rows])
    primal = 0.5 * w @ w + s.cost * np.maximum(0, 1 - margin).sum()
    for other in (w + 0.01 * rng.standard_normal(size + 1) for _ in range(200)):
        m = np.array([(1 if y else -1) * (other[i] @ v + other[-1]) for y, i, v in rows])
        assert 0.5 * other @ other + s.cost * np.maximum(0, 1 - m).sum() >= primal - 1e-4


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in qc.judged(docs, labels).collect()}
    truth = {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] is not None}
    assert len(got) == docs.count()
    for d, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    held = [(got[d]["score"], y) for d, y in truth.items() if got[d]["held_out"]]
    pos, neg = [s for s, y in held if y], [s for s, y in held if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert auc > 0.97
    assert sum((s >= 0.7) == bool(y) for s, y in held) / len(held) > 0.93
    # held-out labels are not learnt from
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 4 = 2 then 1 - quality else quality end as quality")
    again = {r["doc_id"]: r["score"] for r in qc.judged(docs, flipped).collect()}
    assert all(math.isclose(again[d], r["score"], rel_tol=1e-9) for d, r in got.items())


def test_odd_tables(spark):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    docs = spark.createDataFrame([(1, "a b", "x", 1), (2, None, None, 2), (None, "", None, 3), (2, "w " * 1_500_000, "y", 4)], "doc_id long, text string, score string, id long")
    assert qc.judged(docs.limit(0), labels).count() == 0
    none = qc.judged(docs, labels.limit(0)).collect()
    assert len(none) == 4 and all(r["score"] == 0.5 and r["predicted"] == 0 for r in none)
    one_sided = qc.judged(docs, labels.union(labels)).collect()
    assert len(one_sided) == 4 and all(0 < r["score"] < 1 for r in one_sided)
