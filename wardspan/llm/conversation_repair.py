"""Conversation structure repair: the cheapest edits that give every conversation the roles ``(s?(ua)+)?``.

Secondary-sorted streaming: rows are dealt out by conversation and sorted by turn, and everything else happens inside the
sorted partitions. A first stream runs backwards and carries the dynamic programme's state (the cheapest way to the end from
each of the four states of the grammar) across Arrow batches; what it keeps of a row is one byte, the best move in each
state. The byte goes with the row into Spark's second sort, which spills, so a giant conversation needs no more memory than a
short one. A second stream runs forwards along the moves and yields the edited rows as it goes. The duplicate mark and the
order come from windows over the same partitions; the text is shuffled once.

One conversation is one sequential task by definition (its audit and its digest depend on every row in order); what is held
per conversation is one byte a row at most. ``edits`` holds less than that: nothing but the state.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

_WHITE = " \t\n\x0b\f\r"
#: States: nothing yet, after the system turn, after a user turn, after an assistant turn. The last column of each: the
#: state after one more user or assistant turn, whichever is due.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_NEXT = (_USER, _USER, _ASSISTANT, _USER)
_DUE = ("user", "user", "assistant", "user")
#: Moves in ASCII order of their initials: of two equally cheap edits the lower one is taken.
_DELETE, _INSERT, _KEEP, _REROLE = range(4)
_LETTERS = "DIKR"


@dataclass(frozen=True)
class Costs:
    """Cost of each edit; truncated: what an undeleted truncated row adds."""

    rerole: int = 3
    delete: int = 4
    insert: int = 3
    truncated: int = 3


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows of ``conversations`` with the contract's faults: (conv_id, turn, role, text, alive).

    By crc32 of ``conv_id:turn`` modulo 20: dropped (a row with alive = false stays, so that the conversation is known),
    emptied, without its end marks, repeated, or given to the user. NULLs are read as one space; conv_id and turn stay NULL.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), (F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20).alias("fault"))
    gone = F.col("fault") == 0
    text = F.when(gone | (F.col("fault") == 1), "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(gone, "").when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    twice = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (~gone).alias("alive"), twice).drop("copy")


def _classified(rows: DataFrame) -> DataFrame:
    """``rows`` dealt out by conversation and sorted, with place (from 1) and fault (blank, duplicate, truncated, gone or '')."""
    text = F.col("text")
    last = F.substring(F.rtrim(text, F.lit(_WHITE)), -1, 1)
    turn = (F.col("turn").asc_nulls_first(),)
    # windows over (conv_id, ...) find their rows together already: one shuffle for all
    again = F.row_number().over(W.partitionBy("conv_id", "alive", "role", "text").orderBy(*turn)) > 1
    place = F.row_number().over(W.partitionBy("conv_id").orderBy("alive", *turn, "role", "text", "again"))
    fault = F.when(~F.col("alive"), "gone").when(F.length(F.rtrim(text, F.lit(_WHITE))) == 0, "blank").when(F.col("again"), "duplicate").when(~last.isin(".", "!", "?"), "truncated").otherwise("")
    return rows.repartition("conv_id").withColumn("again", again).withColumn("place", place.cast("long")).withColumn("fault", fault).drop("again", "alive")


class _Backward:
    """Cheapest cost to the end from each state, taken row by row from the last one."""

    def __init__(self, costs: Costs):
        self.costs, self.known = costs, {}
        self.begin()

    def begin(self) -> None:
        c = self.costs.insert
        self.value = (0, 2 * c, c, 0)

    def add(self, initial: str, fault: str) -> int:
        """Take one row; returns its best moves, two bits for each state."""
        key = self.value, initial, fault
        if key not in self.known:
            self.known[key] = self._solve(*key)
        self.value, moves = self.known[key]
        return moves

    def _solve(self, after: tuple, initial: str, fault: str) -> tuple[tuple, int]:
        costs, extra = self.costs, self.costs.truncated * (fault == "truncated")
        must_go = fault in ("blank", "duplicate")
        best: dict[int, tuple[int, int]] = {}
        for state in range(4):
            options = [(costs.delete + after[state], _DELETE)]
            if not must_go:
                to = {"s": _SYSTEM if state == _START else None, "u": _USER if state != _USER else None, "a": _ASSISTANT if state == _USER else None}.get(initial)
                if to is not None:
                    options.append((extra + after[to], _KEEP))
                options.append((costs.rerole + extra + after[_NEXT[state]], _REROLE))
            best[state] = min(options)
        # an insertion leads to another state before the same row; the longest useful run of them is three
        for _ in range(3):
            for state in range(4):
                best[state] = min(best[state], (costs.insert + best[_NEXT[state]][0], _INSERT))
        value = tuple(best[s][0] for s in range(4))
        # only differences decide: a bounded number of them makes the table of known steps finite
        low = min(value)
        return tuple(v - low for v in value), sum(best[s][1] << 2 * s for s in range(4))


def _backward(costs: Costs):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dp, current, begun = _Backward(costs), None, False
        for batch in batches:
            moves = np.zeros(len(batch), np.int16)
            for i, (conv, role, fault) in enumerate(zip(batch["conv_id"], batch["role"], batch["fault"], strict=True)):
                if not begun or conv != current:
                    dp.begin()
                    current, begun = conv, True
                if fault != "gone":
                    moves[i] = dp.add(role[:1], fault)
            yield batch.assign(moves=moves)

    return run


def _forward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edited rows in order; place 0 opens a conversation."""
    current, begun, state = None, False, _START
    out: list[tuple] = []

    def insert(conv) -> None:
        nonlocal state
        out.append((conv, None, "I", None, None, None, _DUE[state], ""))
        state = _NEXT[state]

    def close() -> None:
        while begun and state in (_SYSTEM, _USER):
            insert(current)

    def flush() -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=["conv_id", "place", "edit", "fault", "turn", "was", "role", "text"]).astype({"place": "Int64"})
        out.clear()
        return frame

    for batch in batches:
        for conv, turn, role, text, place, fault, moves in zip(*(batch[c] for c in ("conv_id", "turn", "role", "text", "place", "fault", "moves")), strict=True):
            if not begun or conv != current:
                close()
                current, begun, state = conv, True, _START
                out.append((conv, 0, "", None, None, None, None, None))
            if fault == "gone":
                continue
            while (move := moves >> 2 * state & 3) == _INSERT:
                insert(conv)
            new = None if move == _DELETE else role if move == _KEEP else _DUE[state]
            if move != _DELETE:
                state = _SYSTEM if new[:1] == "s" else _USER if new[:1] == "u" else _ASSISTANT
            out.append((conv, place, _LETTERS[move], fault, turn, role, new, text))
        yield flush()
    close()
    yield flush()


def edits(rows: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """The cheapest edits of conversations, one row per edit, in order inside each partition.

    ``rows``: conv_id, turn, role, text and, optionally, alive (false: only shows that the conversation exists). Columns of
    the result: conv_id, place (of the row, from 1; NULL for an insertion; 0 for one row that opens each conversation), edit
    (D, I, K, R), fault ('', blank, duplicate, truncated), turn, was (the row's role), role (NULL if deleted) and text.

    The order of a conversation's rows is turn (NULLs first), then role and text. NULL conv_ids are one conversation; NULL
    roles and texts are one space. Empty texts are blank. Texts are whole, however long. Rows that are repeated with the same
    turn come one after the other, the later ones as duplicates. An empty table gives no rows; other columns do not matter.
    """
    if "alive" not in rows.columns:
        rows = rows.withColumn("alive", F.lit(True))
    kinds = dict(rows.dtypes)
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    # ids travel as text: pandas would turn a long column with NULLs into doubles
    placed = _classified(rows.select(F.col("conv_id").cast("string"), F.col("turn").cast("long"), space("role"), space("text"), "alive")).withColumn("turn", F.col("turn").cast("string"))
    back = placed.sortWithinPartitions("conv_id", F.desc("place")).mapInPandas(_backward(costs), "conv_id string, turn string, role string, text string, place long, fault string, moves smallint")
    schema = "conv_id string, place long, edit string, fault string, turn string, was string, role string, text string"
    out = back.sortWithinPartitions("conv_id", "place").mapInPandas(_forward, schema)
    return out.withColumns({"conv_id": F.col("conv_id").cast(kinds["conv_id"]), "turn": F.col("turn").cast(kinds["turn"])})


def repaired(rows: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """(conv_id, place, edit, role, text) of the rows that the repaired conversations are made of."""
    return edits(rows, costs).where("place is null or place > 0").where("role is not null").select("conv_id", "place", "edit", "role", "text")


class _Summary:
    """What is reported of one conversation, gathered row by row."""

    def __init__(self, conv):
        self.conv, self.hash, self.any = conv, hashlib.sha256(), False
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.illegal, self.before, self.audit = 0, None, bytearray()
        self.low = self.high = None
        self.distinct = self.cost = 0

    def add(self, edit, fault, turn, was, role, text, costs: Costs) -> None:
        self.audit += edit.encode()
        self.cost += {"D": costs.delete, "I": costs.insert, "K": 0, "R": costs.rerole}[edit]
        if edit != "I":
            if fault:
                self.counts[fault] += 1
                self.cost += costs.truncated * (fault == "truncated" and edit != "D")
            if self.before is not None and self.before + was[:1] not in ("su", "ua", "au"):
                self.illegal += 1
            self.before = was[:1]
            if turn is not None and turn != self.high:
                self.distinct += 1
                self.low, self.high = (turn if self.low is None else self.low), turn
        if edit != "D":
            self.hash.update(("\n" if self.any else "").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
            self.any = True

    def row(self) -> tuple:
        gaps = self.high - self.low + 1 - self.distinct if self.distinct else 0
        return (self.conv, gaps, *self.counts.values(), self.illegal, self.cost, self.audit.decode(), self.hash.hexdigest())


def summaries(edited: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """One row per conversation of ``edits``: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    kind, columns = dict(edited.dtypes)["conv_id"], edited.columns
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: _Summary | None = None
        for batch in batches:
            done = []
            for conv, place, edit, fault, turn, was, role, text in zip(*(batch[c] for c in columns), strict=True):
                if place == 0:
                    done += [now.row()] if now else []
                    now = _Summary(conv)
                else:
                    now.add(edit, fault, None if turn is None else int(turn), was, role, text, costs)
            yield pd.DataFrame(done, columns=names)
        if now:
            yield pd.DataFrame([now.row()], columns=names)

    texts = edited.withColumns({"conv_id": F.col("conv_id").cast("string"), "turn": F.col("turn").cast("string")})
    schema = "conv_id string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return texts.mapInPandas(run, schema).withColumn("conv_id", F.col("conv_id").cast(kind))
