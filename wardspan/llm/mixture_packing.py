"""Mixture-controlled packing: deficit round-robin over source queues.

Every source is a queue of token ids. A window holds ``window`` tokens; in each, queue q is due its target share. What it is
due beyond whole tokens is its deficit and is carried into the next window, so after w windows it has been served
``floor(rate * w)`` tokens. That closed form gives each token its window without a sequential pass: documents only need
their place in their queue, which is a prefix sum over (stored part, source) totals plus the place within the part. When a
queue runs dry the others share its part in proportion to their targets, which starts a new phase. Windows follow each other
in one stream that is cut into sequences; the rest at the end is cut into powers of two, so nothing is padded.
"""

from __future__ import annotations

import functools
import math
import struct
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wardspan.llm.common import stored

END = 2
_TOKENS = "doc_id {id}, source string, part int, first long, n long, ids binary"
#: Words whose ids a worker remembers.
_REMEMBERED = 700_000
_BATCH_BYTES = 16_000_000
_BAR = "|"
#: (part, source) totals up to which they are broadcast; beyond, they are joined by a shuffle.
_BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class Settings:
    """length: tokens per sequence, a power of two. window: tokens per window. targets: share of tokens per source in every
    window as long as the source lasts (None: the shares of the corpus); sources not named share one queue that is due what
    is left of 1, or nothing until the others are used up. queues: queues at most; the smallest sources share the last."""

    tokenizer: str
    length: int = 4096
    window: int = 16 * 4096
    targets: tuple[tuple[str, float], ...] | None = None
    queues: int = 128


@functools.lru_cache(maxsize=2)
def _encoder(path: str):
    """The tokenizer; the same for single lower-case words of Latin letters, which need no normalising and no splitting; memory."""
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    tokenizer, words = Tokenizer.from_file(path), Tokenizer.from_file(path)
    words.normalizer = normalizers.Sequence([])
    words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return tokenizer, words, {"": b""}, tokenizer.encode(_BAR, add_special_tokens=False).ids[0]


def _plain(text: str) -> bool:
    """Whether lower-casing first is sure to change nothing: Latin-1 only, and no special token."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return "<|" not in text


def encode(texts: list[str], path: str) -> list[bytes]:
    """Ids of each text as unsigned little-endian 32-bit integers.

    Words between blanks are encoded on their own and remembered: the tokenizer's pattern never joins across white space.
    """
    tokenizer, words, known, bar = _encoder(path)
    if len(known) > _REMEMBERED:
        known.clear()
        known[""] = b""
    split, latin, other = [], set(), set()
    for text in texts:
        plain = _plain(text)
        chunks = (text.lower() if plain else text).replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        split.append(chunks)
        (latin if plain else other).update(chunks)
    # not difference_update, which goes through all that is known
    latin, other = latin.difference(known), other.difference(known)

    def learn(encoder, new: list[str]) -> None:
        """Many words at a time, with a bar between them."""
        lists = [new[i : i + 256] for i in range(0, len(new), 256)]
        for ws, e in zip(lists, encoder.encode_batch_fast([f" {_BAR} ".join(x) for x in lists], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            data, at = ids.tobytes(), 0
            for w, end in zip(ws, [*(4 * np.flatnonzero(ids == bar)).tolist(), len(data)], strict=True):
                known[w] = data[at:end]
                at = end + 4

    # lower-case Latin words; such words with one comma or full stop behind, which are two words of the pattern; all others
    simple, ending, rest = [], [], list(other.difference(latin))
    for w in latin:
        if w.isalpha():
            simple.append(w)
        elif w[-1] in ",." and w[:-1].isalpha():
            ending.append(w)
        else:
            rest.append(w)
    stems = {w[:-1] for w in ending}.difference(known, simple)
    learn(words, simple + list(stems))
    for w in (*rest, ",", "."):
        if _BAR in w:
            known[w] = np.array(tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes()
    learn(tokenizer, [w for w in (*rest, ",", ".") if _BAR not in w])
    comma, stop = known[","], known["."]
    for w in ending:
        known[w] = known[w[:-1]] + (comma if w[-1] == "," else stop)
    return [b"".join(map(known.__getitem__, chunks)) for chunks in split]


def tokenized(docs: DataFrame, path: str, source: str = "source") -> DataFrame:
    """Stored rows (doc_id, source, part, first, n, ids): ``first`` is the place among the part's tokens of that source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        part, seen = TaskContext.get().partitionId(), defaultdict(int)
        end = struct.pack("<I", END)
        for batch in batches:
            # few rows at a time: ids take up to four bytes per byte of text
            step = max(1, int(batch.num_rows * _BATCH_BYTES / (4 * batch.nbytes + 1)))
            for at in range(0, batch.num_rows, step):
                piece = batch.slice(at, step)
                ids = [x + end for x in encode([t or "" for t in piece.column(1).to_pylist()], path)]
                first = []
                for s, x in zip(piece.column(2).to_pylist(), ids, strict=True):
                    first.append(seen[s])
                    seen[s] += len(x) // 4
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(2), pa.array([part] * len(ids), pa.int32()), pa.array(first, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    ["doc_id", "source", "part", "first", "n", "ids"])

    kind = dict(docs.dtypes)["doc_id"]
    return stored(docs.select("doc_id", "text", F.col(source).cast("string").alias("source")).mapInArrow(run, _TOKENS.format(id=kind)), "tokens")


def phases(supply: list[int], targets: list[float] | None, window: int) -> list[tuple[int, int, list[int], list[int]]]:
    """(first window, windows, tokens served before per queue, tokens served within per queue) per phase."""
    if targets is None:
        return [(0, max(1, math.ceil(sum(supply) / window)), [0] * len(supply), list(supply))] if sum(supply) else []
    out, at, done = [], 0, [0] * len(supply)
    while any(d < t for d, t in zip(done, supply, strict=True)):
        left = [t - d for d, t in zip(done, supply, strict=True)]
        due = [p if r else 0.0 for p, r in zip(targets, left, strict=True)]
        if not sum(due):
            due = [float(r) for r in left]
        rate = [window * p / sum(due) for p in due]
        # whole windows at the full rates; the window in which a queue runs dry is a phase of its own
        n = max(1, math.floor(min(r / v for r, v in zip(left, rate, strict=True) if v > 0)))
        got = [min(r, math.ceil(v * n)) for r, v in zip(left, rate, strict=True)]
        out.append((at, n, list(done), got))
        at, done = at + n, [d + g for d, g in zip(done, got, strict=True)]
    return out


def _served(x: Column, d: Column, n: Column, k: Column) -> Column:
    """x + floor(d * k / n) without leaving the range of a long."""
    return x + _div(d, n) * k + _div(F.pmod(d, n) * k, n)


def _div(a: Column, b: Column) -> Column:
    """Whole quotient, as a long."""
    return F.call_function("div", a, b)


def packed(docs: DataFrame, s: Settings, source: str = "source") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, queue, window_id.

    Each document's ids are followed by id 2. NULL and empty texts consist of that id alone. Repeated rows are packed each
    time they occur; a NULL source is a source of its own (it shares the queue of the empty name); extra columns do not
    matter; an empty table gives no pieces.
    """
    spark = docs.sparkSession
    tokens = tokenized(docs, s.tokenizer, source)
    totals = stored(tokens.groupBy("part", F.coalesce("source", F.lit("")).alias("source")).agg(F.sum("n").alias("total")), "token-totals")
    by_source = totals.groupBy("source").agg(F.sum("total").alias("total"))
    if s.targets is None:
        rows = by_source.orderBy(F.desc("total"), "source").limit(s.queues - 1).collect()
        names, shares = [r["source"] for r in rows], None
    else:
        names = [k for k, _ in s.targets]
        rows = by_source.where(F.col("source").isin(names)).collect()
        shares = [v for _, v in s.targets] + [max(0.0, 1 - sum(v for _, v in s.targets))]
    have = {r["source"]: r["total"] for r in rows}
    whole = by_source.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("t")).first()["t"]
    supply = [have.get(k, 0) for k in names]
    supply.append(whole - sum(supply))
    plan = phases(supply, shares, s.window)
    queue = spark.createDataFrame([(k, i) for i, k in enumerate(names)] or [("", 0)], "source string, queue int")
    totals = totals.join(F.broadcast(queue), "source", "left").withColumn("queue", F.coalesce("queue", F.lit(len(names))))
    before = F.sum("total").over(W.partitionBy("queue").orderBy("part", "source")) - F.col("total")
    bases = stored(totals.select(F.col("part").alias("b_part"), F.col("source").alias("b_source"), "queue", before.alias("base")), "token-bases")
    small = bases.count() <= _BROADCAST_ROWS
    join = (F.col("part") == F.col("b_part")) & (F.coalesce("source", F.lit("")) == F.col("b_source"))
    placed = tokens.join(F.broadcast(bases) if small else bases, join).select("doc_id", "ids", F.col("n").alias("doc_tokens"), "queue", (F.col("base") + F.col("first")).alias("a"))
    steps = [(q, at, n, x[q], d[q], x, d) for at, n, x, d in plan for q in range(len(supply)) if d[q]]
    step = F.broadcast(spark.createDataFrame(steps, "p_queue int, w0 long, n long, x long, d long, xs array<long>, ds array<long>"))
    # the part of the document that falls into the phase, then into each of its windows
    meets = (F.col("queue") == F.col("p_queue")) & (F.col("a") < F.col("x") + F.col("d")) & (F.col("a") + F.col("doc_tokens") > F.col("x"))
    lo, hi = F.greatest("a", "x") - F.col("x"), F.least(F.col("a") + F.col("doc_tokens"), F.col("x") + F.col("d")) - F.col("x")
    df = placed.join(step, meets).withColumns({"lo": lo, "hi": hi})
    window = lambda y: _div((F.col(y).cast("decimal(19,0)") + (1 if y == "lo" else 0)) * F.col("n").cast("decimal(18,0)") - 1, F.col("d").cast("decimal(19,0)"))
    df = df.withColumn("w", F.explode(F.sequence(window("lo"), window("hi"))))
    served = lambda x, d, k: _served(x, d, F.col("n"), k)
    k = F.col("w")
    zero = F.lit(0).cast("long")
    from_, to = F.greatest("lo", served(zero, F.col("d"), k)), F.least("hi", served(zero, F.col("d"), k + 1))
    df = df.withColumns({"from": from_, "to": to}).where(F.col("from") < F.col("to"))
    both = F.arrays_zip("xs", "ds")
    ahead = F.aggregate(both, zero, lambda acc, e: acc + served(e["xs"], e["ds"], k))
    mates = F.aggregate(F.slice("ds", F.lit(1), F.col("queue")), zero, lambda acc, e: acc + served(zero, e, k + 1) - served(zero, e, k))
    g = ahead + mates + F.col("from") - served(zero, F.col("d"), k)
    df = df.select("doc_id", "ids", "doc_tokens", "queue", (F.col("w0") + k).alias("window_id"), (F.col("x") + F.col("from") - F.col("a")).alias("start"), (F.col("to") - F.col("from")).alias("len"), g.alias("g"))
    # sequences: whole ones by division, the rest of the stream by its binary digits
    full, rest = divmod(whole, s.length)
    tail, at = [], full * s.length
    for bit in sorted((1 << i for i in range(rest.bit_length()) if rest >> i & 1), reverse=True):
        tail.append((full + len(tail), at, bit))
        at += bit
    piece = "struct<id:bigint,at:bigint,size:bigint>"
    ends = F.array(*(F.struct(F.lit(i).cast("long").alias("id"), F.lit(a).cast("long").alias("at"), F.lit(b).cast("long").alias("size")) for i, a, b in tail)).cast(f"array<{piece}>")
    first_seq, last_seq = _div(F.col("g"), F.lit(s.length)), _div(F.col("g") + F.col("len") - 1, F.lit(s.length))
    whole_ones = F.transform(F.sequence(first_seq, F.least(last_seq, F.lit(full - 1).cast("long"))), lambda i: F.struct(i.alias("id"), (i * s.length).alias("at"), F.lit(s.length).cast("long").alias("size")))
    cuts = F.concat(F.when(first_seq < full, whole_ones).otherwise(F.array().cast(f"array<{piece}>")), F.when(last_seq >= full, ends).otherwise(F.array().cast(f"array<{piece}>")))
    df = df.withColumn("q", F.explode(cuts))
    begin = F.greatest(F.col("g"), F.col("q.at"))
    length = F.least(F.col("g") + F.col("len"), F.col("q.at") + F.col("q.size")) - begin
    df = df.withColumns({"begin": begin, "length": length}).where("length > 0")
    start = F.col("start") + F.col("begin") - F.col("g")
    return df.select(
        "doc_id", start.alias("start"), "length", F.crc32(F.substring("ids", (4 * start + 1).cast("int"), (4 * F.col("length")).cast("int"))).alias("ids_crc32"), "doc_tokens",
        F.col("q.id").alias("sequence_id"), (F.col("begin") - F.col("q.at")).alias("offset"), "queue", "window_id",
    )
