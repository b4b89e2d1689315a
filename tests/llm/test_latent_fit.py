"""The latent space is fitted to the passages of all texts, however many there are."""

import random

import numpy as np
import pytest

from wardspan.llm import latent_decontamination as ld


@pytest.mark.parametrize("cells", [60, 1 << 22])
def test_products_are_those_of_all_passages(spark, monkeypatch, cells):
    monkeypatch.setattr(ld, "_CELLS", cells)
    monkeypatch.setattr(ld, "_PAIRS", cells)
    rng = random.Random(8)
    words = [f"w{i}" for i in range(23)]
    q = ld.Queries.of([(k, " ".join(rng.sample(words, 12))) for k in range(6)])
    size, width = len(q.vocabulary), ld.NARROW * ld.STEP
    # more texts than the former sample of 2,000 held; repeated, long, empty and missing ones among them
    texts = [" ".join(rng.choice([*words, "other", f"x{d}"]) for _ in range(rng.randrange(0, 9))) for d in range(2_400)]
    texts += [" ".join(rng.choice([*words, "other"]) for _ in range(700))] * 2 + ["", "other", None]
    a = []
    for text in texts:
        ids = ld._ids(ld.words_of(text), q.vocabulary)
        a += [np.bincount(x[x >= 0], minlength=size) for x in (ids[i : i + width] for i in range(0, len(ids), width))]
    a = np.array(a)
    pairs, times, df, n, held = ld.word_pairs(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), q)
    assert (n, held) == (len(a), int(a.any(axis=1).sum())) and held > 2_000
    assert (times == a.sum(axis=0)).all() and (df == (a > 0).sum(axis=0)).all()
    weights, basis = np.random.default_rng(1).random(size) + 0.1, np.random.default_rng(2).standard_normal((size, 4))
    assert np.allclose(ld.product(pairs, times, weights, basis), (a * weights).T @ ((a * weights) @ basis))


def test_words_that_share_passages_anywhere_are_near(spark):
    """Which words go together is seen in every text, also in the last 40 of 2,340."""
    q = ld.Queries.of([(0, "alpha beta gamma delta"), (1, "one two three four")])
    texts = [f"alpha beta x{i}" if i % 2 else f"one two x{i}" for i in range(2_300)] + [f"gamma three y{i}" for i in range(40)]
    pairs, times, df, n, held = ld.word_pairs(spark.createDataFrame([(t,) for t in texts], "text string"), q)
    together = ld.product(pairs, times, np.ones(len(df)), np.eye(len(df)))
    assert together[q.vocabulary["gamma"], q.vocabulary["three"]] == 40 and held == len(texts)
    space = ld.latent_space(pairs, times, held, q, np.ones(len(df)), ld.Settings(rank=3))
    near = lambda x, y: space[q.vocabulary[x]] @ space[q.vocabulary[y]] / np.linalg.norm(space[q.vocabulary[x]]) / np.linalg.norm(space[q.vocabulary[y]])
    assert near("alpha", "beta") > 0.9 and near("one", "two") > 0.9


def test_counts_of_many_numbers():
    rng = np.random.default_rng(3)
    sums, all_ = ld.Sums(), []
    for size in (0, 5, 1_200_000, 7, 900_000, 1_300_000):
        all_.append(rng.integers(0, 1_000 if size < 1_000_000 else 3_000_000, size))
        sums.add(all_[-1])
    sums.merge()
    codes, counts = np.unique(np.concatenate(all_), return_counts=True)
    assert (sums.codes == codes).all() and (sums.counts == counts).all()
    back = ld.unpacked(ld.packed(codes, counts))
    assert (back[0] == codes).all() and (back[1] == counts).all()
