"""Windows that cannot hold a passage are not aligned with it, and sums over blocks are those of their words."""

import pathlib
import random
import sys

import numpy as np
import pyarrow as pa

sys.path.insert(0, str(pathlib.Path(__file__).parent))
import brute  # noqa: E402

from wardspan.llm import latent_decontamination as ld  # noqa: E402


def masks_of(words: list[str]) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, x in enumerate(words):
        masks[x] = masks.get(x, 0) | 1 << i
    return masks


def test_no_common_subsequence_is_longer_than_the_bound():
    rng = random.Random(4)
    for _ in range(300):
        a, b = [[rng.choice("abcdefgh"[: rng.randrange(2, 9)]) for _ in range(rng.randrange(0, 30))] for _ in range(2)]
        assert brute.lcs(a, b) <= ld.possible(masks_of(a), b) <= min(len(a), len(b))


def test_block_sums():
    rng = np.random.default_rng(5)
    embed = np.vstack([rng.standard_normal((50, 7)), np.zeros((1, 7))]).astype(np.float32)
    for rows in (0, 1, 1_024, 2_500):
        cells = rng.integers(-1, 50, (rows, ld.STEP)).astype(np.int32)
        assert np.allclose(ld._block_sums(embed, cells), embed[cells].sum(axis=1), atol=1e-5)


def test_only_windows_that_may_hold_a_passage_are_aligned(spark, monkeypatch):
    """Texts that share a few heavy words with an item are candidates, but not aligned; those that hold it are found."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    items = [(k, " ".join(rng.sample(words, 40)) + ".") for k in range(5)]
    docs = [(d, " ".join(rng.sample(items[d % 5][1][:-1].split(), 18) + [f"other{rng.randrange(10**6)}" for _ in range(12)])) for d in range(40)]
    docs += [(100 + k, f"before {t} after") for k, t in items]
    q = ld.Queries.of(items)
    aligned, align = [], ld.lcs
    monkeypatch.setattr(ld, "lcs", lambda *args: aligned.append(1) or align(*args))
    found = []

    class Rows:
        dtypes = [("doc_id", "bigint"), ("text", "string")]

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs], pa.int64()), pa.array([t for _, t in docs])], ["doc_id", "text"])
            found.extend((r["doc_id"], r["item_id"]) for b in run(iter([batch])) for r in b.to_pylist())

    idf, space = np.ones(len(q.vocabulary)), np.eye(len(q.vocabulary))
    ld.search(Rows(), q, space, idf, ld.Settings(), ["doc_id"])
    assert set(found) == {(100 + k, k) for k in range(5)}
    assert len(aligned) <= 3 * len(items)
