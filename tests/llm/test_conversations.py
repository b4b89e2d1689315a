"""Conversation repair against a brute-force version that searches all edits by cost, then by audit."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from wardspan.llm import conversation_repair as repair

SCHEMA = "conv_id long, turn long, role string, text string"
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
FULL = {"u": "user", "a": "assistant"}


def brute_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = (" " if role is None else role), (" " if text is None else text)
        k = zlib.crc32(key.encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        role = "user" if k == 4 else role
        kept += [(turn, role, text)] * (2 if k == 3 else 1)
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, v in out.items()}


def brute_edits(rows, faults):
    """The cheapest edits by uniform-cost search over (cost, audit): every string of edits is a path of its own."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if (i, state, audit) in done:
            continue
        done.add((i, state, audit))
        if i == len(rows) and state in ("", "a"):
            return cost, audit, out
        push = lambda c, letter, j, s, o: heapq.heappush(heap, (cost + c, audit + letter, j, s, o))  # noqa: E731, B023
        if audit[-3:] != "III":
            push(3, "I", i, NEXT[state], (*out, FULL[NEXT[state]] + ":"))
        if i < len(rows):
            _, role, text = rows[i]
            push(4, "D", i + 1, state, out)
            if faults[i] not in ("blank", "duplicate"):
                more = 3 * (faults[i] == "truncated")
                if role[:1] == NEXT[state] or (state == "" and role[:1] == "s"):
                    push(more, "K", i + 1, role[:1], (*out, f"{role}:{text}"))
                push(3 + more, "R", i + 1, NEXT[state], (*out, f"{FULL[NEXT[state]]}:{text}"))


def brute(rows):
    out = []
    for conv, kept in brute_damage(rows).items():
        seen, faults = set(), []
        for _, role, text in kept:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        cost, audit, done = brute_edits(kept, faults)
        digest = hashlib.sha256("\n".join(done).encode()).hexdigest()
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest))
    return sorted(out, key=str)


def ours(spark, rows, schema=SCHEMA):
    df = repair.summaries(repair.edits(repair.damaged(spark.createDataFrame(rows, schema))))
    return sorted((tuple(r)[:9] for r in df.collect()), key=str)


@pytest.fixture(params=[10_000, 3])
def batches(spark, request):
    """Whole partitions in a batch, and batches that cut conversations."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, request.param)
    yield
    spark.conf.set(key, before)


def test_repair_equals_search_over_all_edits(spark, batches):
    rng = random.Random(5)
    texts = ["One.", "Two!", "Three?", "cut", "", "  \t", None, "Same.", "Same.", "a\nb. ", "é.", "dots ..."]
    rows = []
    for conv in range(260):
        odd = conv % 3 == 0
        for turn in range(rng.randint(1, 8)):
            role = rng.choice(["user", "assistant", "system", "tool", None, "", "u", "Assistant"]) if odd else ("system" if rng.random() < 0.1 else ("user", "assistant")[turn % 2])
            at = rng.choice([turn, turn, turn * 3, None, turn - 1]) if odd else turn
            rows.append((conv, at, role, rng.choice(texts) if odd else rng.choice(texts[:6])))
    rows += [(None, 1, "user", "No id."), (None, 2, "assistant", "None."), (2**62 + 1, 0, "user", "Large id.")]
    rows += rows[5:25]  # repeated rows
    assert ours(spark, rows) == brute(rows)


def test_cases_by_hand(spark):
    dropped = next(i for i in range(10_000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    plain = next(i for i in range(10_000) if all(zlib.crc32(f"{i}:{t}".encode()) % 20 > 4 for t in range(6)))
    got = ours(spark, [(dropped, 0, "user", "Gone."), (plain, 0, "system", "S."), (plain, 1, "user", "U."), (plain, 5, "user", "V.")])
    empty = hashlib.sha256(b"").hexdigest()
    assert (dropped, 0, 0, 0, 0, 0, 0, "", empty) in got
    assert next(r for r in got if r[0] == plain)[:8] == (plain, 3, 0, 0, 0, 1, 3, "KKR")
    assert ours(spark, []) == []


def test_long_conversation_in_small_batches(spark, batches):
    """A giant conversation: state across hundreds of batches, backpointers through the second sort."""
    own = next(i for i in range(100) if zlib.crc32(f"{i}: ".encode()) % 20 > 4)
    plain = [i for i in range(40_000) if zlib.crc32(f"{own}:{i}".encode()) % 20 > 4][:2_000]
    rows = [(own, t, ("user", "assistant")[i % 2], f"Row {i}.") for i, t in enumerate(plain)]
    rows.insert(1_000, (own, None, "assistant", "First of all."))
    got = ours(spark, rows)
    (conv, *_, illegal, cost, audit, digest), = got
    # an assistant turn in front of all: one user turn before it costs 3, its deletion 4
    assert (conv, illegal, cost, audit) == (own, 0, 3, "I" + "K" * 2_001)
    body = ["user:", "assistant:First of all."] + [f"{r[2]}:{r[3]}" for r in rows if r[1] is not None]
    assert digest == hashlib.sha256("\n".join(body).encode()).hexdigest()


def test_edited_rows_and_extra_columns(spark):
    rows = [(1, 0, "user", "Hello.", "x", 5), (1, 1, "user", "Again.", "y", 6), (2, 0, "assistant", "", None, None)]
    df = spark.createDataFrame(rows, SCHEMA + ", place string, moves long")
    got = {(r["conv_id"], r["place"]): (r["edit"], r["role"], r["text"]) for r in repair.repaired(df).collect()}
    assert got == {(1, 1): ("K", "user", "Hello."), (1, 2): ("R", "assistant", "Again.")}
    assert repair.repaired(df.limit(0)).count() == 0


def test_very_long_text(spark):
    rows = [(5, 0, "user", "word " * 300_000 + "end."), (5, 1, "assistant", "short.")]
    assert ours(spark, rows) == brute(rows)
