"""Ranked search against a plain scan over all documents, and what the buckets leave closed."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from wardspan.llm import lexical_search as ls

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(docs, items, k=20):
    texts = [(d, Counter(TERM.findall(low(t)))) for d, t in docs]
    texts = [(d, c) for d, c in texts if c]
    n_docs, length = len(texts), sum(sum(c.values()) for _, c in texts)
    df = Counter(t for _, c in texts for t in c)
    out = []
    for item, text in sorted({(i, t) for i, t in items if t is not None}, key=str):
        asked, scores = TERM.findall(low(text)), []
        for d, c in texts:
            m = 75 + 25 * sum(c.values()) * n_docs // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in asked if c[t])
            if score > 0:
                scores.append((-score, d is not None, d or 0, d))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def ours(spark, docs, items, **s):
    d, i = frames(spark, docs, items)
    return sorted((tuple(r) for r in ls.ranked(d, i, ls.Settings(**s)).select("item_id", "rank", "doc_id", "score").collect()), key=str)


def corpus(rng, n):
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "é", "Straße", "ça", "x1"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    text = lambda k: "".join(w + rng.choice([" ", "\n", ", ", "-", "_", "\x00"]) for w in rng.choices(vocabulary, weights, k=k))
    return [(i, text(rng.choice([1, 5, 40, 200]))) for i in range(n)], text


def test_search_equals_scan(spark):
    rng = random.Random(3)
    docs, text = corpus(rng, 300)
    docs += docs[:7] + [(900 + i, docs[3][1]) for i in range(30)]  # repeated rows, ties
    docs += [(None, docs[3][1]), (None, "w50 W50"), (990, None), (991, ""), (992, "... --"), (993, "w1 " * 60_000)]
    items = [(i, text(12)) for i in range(25)] + [(3, "w50 W50 w51"), (5, None), (6, ""), (7, "?!"), (8, "unknown words"), (None, "w3 É"), (3, "w50 W50 w51")]
    want = brute(docs, items)
    assert ours(spark, docs, items) == want
    assert ours(spark, docs, items, bucket_rows=7, seed_rows=10, step=1, few=0.0) == want
    assert ours(spark, docs, items, bucket_terms=50, block_bytes=200, few=1.0) == want


def test_empty_tables_and_other_columns(spark):
    assert ours(spark, [], [(1, "a")]) == [] == ours(spark, [(1, "a b")], [])
    d, i = frames(spark, [(1, "alpha beta"), (2, "gamma")], [(4, "alpha")])
    odd = d.selectExpr("doc_id", "text", "'x' as norm", "1 as item", "2 as ids")
    assert [tuple(r) for r in ls.ranked(odd, i.selectExpr("*", "3 as doc_id")).collect()] == [(4, 1, 1, brute([(1, "alpha beta"), (2, "gamma")], [(4, "alpha")])[0][3])]


def test_buckets_of_short_vectors_stay_closed():
    """Long vectors first: once they fill the result, no bucket of shorter ones is opened, and the result is the same."""
    q = ls.Queries([0], [{0: 1, 1: 2}], {b"a": 0, b"b": 1})
    weights = np.array([1000, 3000], np.int64)
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.integers(700_000, 900_000, 40), rng.integers(1_000, 9_000, 400)])
    values = -np.sort(-values)
    norm = np.sqrt(weights[1] * values.astype(float) ** 2)
    lists = lambda x: pa.ListArray.from_arrays(pa.array(range(len(x) + 1), pa.int32()), pa.array(x, pa.int32()))
    table = pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int64()), pa.array(norm), lists(np.ones(len(values), int)), lists(values)], ["doc_id", "norm", "ids", "impacts"])
    s = ls.Settings(bucket_rows=20)
    searcher = ls.Searcher(q, weights, [0], s)
    going = [searcher.add(b) for b in ls.buckets(iter([table]), weights, s)]
    assert searcher.opened <= 3 and not any(going[3:])
    assert searcher.best[0].score.tolist() == (6_000 * values[:20]).tolist()


def test_bounds_keep_all_that_reach_the_threshold():
    rng = np.random.default_rng(7)
    weights = rng.integers(1, 9_000, 50)
    for _ in range(40):
        rows = 30
        lengths = rng.integers(1, 12, rows)
        ids = np.concatenate([np.sort(rng.choice(50, n, replace=False)) for n in lengths])
        values = rng.integers(1_000, 990_000, len(ids))
        owner = np.repeat(np.arange(rows), lengths)
        norm = np.sqrt(np.bincount(owner, weights[ids] * values.astype(float) ** 2))
        order = np.argsort(-norm)
        pieces = [(ids[owner == r], values[owner == r]) for r in order]
        b = ls.Bucket(np.arange(rows), np.ones(rows, bool), norm[order], lengths[order], np.concatenate([p[0] for p in pieces]), np.concatenate([p[1] for p in pieces]), weights)
        q = ls.Query({int(i): int(rng.integers(1, 4)) for i in rng.choice(50, 9, replace=False)}, weights)
        full = np.zeros(50, np.int64)
        full[q.ids] = q.weights
        exact = b.scores(np.arange(rows), full)
        threshold = int(np.sort(exact)[-5])
        got = set(b.survivors(q, max(1, threshold), ls.Settings()).tolist())
        assert set(np.flatnonzero(exact >= max(1, threshold)).tolist()) <= got
