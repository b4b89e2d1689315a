"""Line deduplication: shared runs of 50 words or more, whatever the length of their lines."""

import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from wardspan.llm import line_dedup  # noqa: E402


def removed(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out, cut = line_dedup.deduplicated(df)
    return {r["doc_id"]: set(r[cut]) for r in out.collect()}


def in_shared_runs(texts, least):
    """Per document the lines in a run of ``least`` words or more that also stands at an earlier place, comparing all pairs."""
    size = [[len(brute.SPACED.findall(x)) for x in t.split("\n")] for t in texts]
    lines = [[(i, x) for i, x in enumerate(t.split("\n")) if size[d][i]] for d, t in enumerate(texts)]
    want = {d: set() for d in range(len(texts))}
    for d, mine in enumerate(lines):
        for e in range(d + 1):
            for diag in range(1 if e == d else 1 - len(lines[e]), len(mine)):
                run = []
                for k in range(max(diag, 0), len(mine) + 1):
                    there = k - diag
                    if k < len(mine) and there < len(lines[e]) and mine[k][1] == lines[e][there][1]:
                        run.append(mine[k][0])
                        continue
                    if sum(size[d][i] for i in run) >= least:
                        want[d] |= set(run)
                    run = []
    return want


def test_short_line_behind_a_long_one(spark):
    long, short = " ".join(f"p{i}" for i in range(90)), "a short last line"
    assert removed(spark, [f"one\n{long}\n{short}", f"two\n{long}\n{short}", f"{short}\n{long}\nthree", f"{short}\n{long}\nfour"])[1] == {1, 2}


def test_run_shared_with_a_later_document_only(spark):
    """The first place of a fingerprint is not always the one that shares the whole run."""
    head, tail = " ".join(f"h{i}" for i in range(60)), [f"tail {i} of it" for i in range(5)]
    got = removed(spark, ["\n".join(x) for x in (["a", head, "other"], ["b", head, *tail], ["c", head, *tail])])
    assert got == {0: set(), 1: {1}, 2: {1, 2, 3, 4, 5, 6}}


def test_runs_against_brute_force(spark):
    rng = random.Random(8)
    line = lambda: " ".join(f"w{rng.randrange(9)}" for _ in range(rng.choice([1, 2, 4, 8, 8, 12, 30, 80, 130])))
    passages = [[line() for _ in range(rng.randrange(2, 9))] for _ in range(12)]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            parts += [line(), ""] * rng.randrange(2) + p[a : a + rng.randrange(2, 9)]
        texts.append("\n".join(parts))
    got, want = removed(spark, texts), in_shared_runs(texts, line_dedup.Settings().window_words)
    first = {}
    for d, t in enumerate(texts):
        for i, x in enumerate(t.split("\n")):
            first.setdefault(x, (d, i))
    assert sum(map(len, want.values())) > 100
    for d, t in enumerate(texts):
        assert want[d] <= got[d], (d, want[d] - got[d])
        assert all(first[t.split("\n")[i]] < (d, i) for i in got[d])
