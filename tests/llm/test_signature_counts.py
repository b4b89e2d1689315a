"""Linked sets share as many signatures as the join relies on."""

import numpy as np
import pytest

from wardspan.llm import jaccard_join as jj


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_share_enough_signatures(percent):
    rng = np.random.default_rng(percent)
    checked = 0
    for _ in range(1_500):
        n = int(rng.choice([1, 2, 5, 9, 20, 33, 70, 150, 400, 1_200]) * rng.uniform(1, 1.5)) + 1
        x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
        far = jj.most_apart(2 * len(x), percent)
        gone, new = int(rng.integers(0, far + 1)), int(rng.integers(0, far + 1))
        y = np.unique(np.concatenate([rng.permutation(x)[gone:], rng.integers(0, 2**63, new, dtype=np.uint64)]))
        both = len(np.intersect1d(x, y))
        if not len(y) or 100 * both < percent * (len(x) + len(y) - both):
            continue
        hot = np.sort(rng.permutation(x)[: int(rng.integers(0, len(x) // 3 + 1))])
        (a, need_a), (b, need_b) = (jj.signatures(t, percent, hot) for t in (x, y))
        common = np.intersect1d(a, b)
        # one of the two sides holds the pair, with at least as many common signatures as both sets need there
        assert any((k := int((common & 1 == side).sum())) >= max(need_a[side], need_b[side], 1) for side in (0, 1) if need_a[side] and need_b[side])
        checked += 1
    assert checked > 300
