"""One large group of near copies needs few candidate pairs, and is linked exactly."""

import pathlib
import random
import sys

sys.path.insert(0, str(pathlib.Path(__file__).parent))
import brute  # noqa: E402

from wardspan.llm import jaccard_join as jj  # noqa: E402


def near_copies(n: int) -> list[tuple[int, str]]:
    rng = random.Random(3)
    words = [f"w{rng.randrange(10_000)}" for _ in range(150)]
    rows = []
    for d in range(n):
        mine = list(words)
        for _ in range(rng.choice([1, 1, 2, 2, 3, 4, 6])):
            mine[rng.randrange(len(mine))] = rng.choice(["the", "of", f"x{rng.randrange(10_000)}"])
        rows.append((d, " ".join(mine)))
    return rows


def test_near_copies_make_few_pairs(spark, monkeypatch):
    rows, made = near_copies(250), []
    formed = jj.opened_pairs

    def counted(*args):
        pairs = jj.stored(formed(*args), "counted")
        made.append(pairs.count())
        return pairs

    monkeypatch.setattr(jj, "opened_pairs", counted)
    got = {r["doc_id"]: r["component_id"] for r in jj.grouped(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.groups(rows, 3, 90)
    assert made[0] <= len(rows)
