"""Benchmark decontamination by latent semantic retrieval.

Passages are TF-IDF vectors over the benchmark's words. A randomised SVD of all passages gives the latent space: one pass over the
corpus counts how often two words share a passage, and the subspace iteration multiplies with these counts, in Spark tasks. Every window of every document is compared with
every benchmark passage there; pairs above the cosine threshold are candidates, and are verified on the words: longest
common subsequence with the benchmark passage, and for weaker ones whether its answer (last sentence) is there too.

Statistics (document frequencies) cover all documents. The latent space is fitted to all passages of the benchmark and of all
texts, and the search covers every window of all texts. Large benchmarks are searched in blocks of items.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import repeat
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardspan.llm.common import discard, fresh, stored, text_hash

WORD = re.compile(r"\w+")
STEP = 16
NARROW, WIDE = 2, 4
_SEGMENT = 1 << 16
#: Cells of a block of the words x words matrix.
_CELLS = 1 << 20
#: Distinct word pairs that a task holds.
_PAIRS = 1 << 22


@dataclass(frozen=True)
class Settings:
    """rank, extra, rounds: of the SVD. cosine: least similarity of a candidate. lcs: share of a benchmark passage's words that
    the common subsequence must hold; with_answer: the same if the answer is found too. block_items: benchmark items searched
    at a time. short: items with fewer words are only looked for as a whole run of words."""

    rank: int = 224
    extra: int = 16
    rounds: int = 2
    cosine: float = 0.4
    lcs: float = 0.75
    with_answer: float = 0.6
    block_items: int = 1_000
    seed: int = 11


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def answer_of(text: str) -> list[str]:
    """Words of the last sentence that has two or more, else of the last one."""
    parts = [w for x in re.split(r"[.!?\n]+", text) if (w := words_of(x))]
    return next((p for p in reversed(parts) if len(p) > 1), parts[-1] if parts else [])


@dataclass
class Queries:
    """Benchmark passages: items cut into pieces of at most a wide window."""

    item: list
    words: list[list[str]]
    answer: list[list[str]]
    vocabulary: dict[str, int]

    @staticmethod
    def of(rows: list[tuple[object, str]]) -> Queries:
        item, words, answer = [], [], []
        for key, text in rows:
            w = words_of(text)
            pieces = -(-len(w) // (WIDE * STEP))
            for i in range(pieces):
                item.append(key)
                words.append(w[len(w) * i // pieces : len(w) * (i + 1) // pieces])
                answer.append(answer_of(text))
        return Queries(item, words, answer, {w: i for i, w in enumerate(sorted({x for p in words for x in p}))})


def _ids(words: list[str], vocabulary: dict[str, int]) -> np.ndarray:
    return np.fromiter(map(vocabulary.get, words, repeat(-1)), np.int32, len(words))


def _mapper(fn, names: list[str], types: list[pa.DataType]):
    """Arrow mapper: ``fn`` gets column lists of a few texts at a time and yields rows; ``None`` closes the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows):
            rows = list(rows)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        state: dict = {}
        for batch in batches:
            step = max(1, int(batch.num_rows * 1e6 / (batch.nbytes + 1)))
            for at in range(0, batch.num_rows, step):
                yield from out(fn(state, [c.to_pylist() for c in batch.slice(at, step).columns]))
        yield from out(fn(state, None))

    return run


class Sums:
    """Counts of numbers, many of them repeated, in bounded memory: sorted distinct numbers and how often each came."""

    def __init__(self) -> None:
        self.codes, self.counts = np.empty(0, np.int64), np.empty(0, np.int64)
        self.new: list[np.ndarray] = []
        self.waiting = 0

    def add(self, codes: np.ndarray) -> None:
        self.new.append(codes)
        self.waiting += len(codes)
        if self.waiting >= max(1 << 20, len(self.codes)):
            self.merge()

    def merge(self) -> None:
        if not self.waiting:
            return
        codes = np.sort(np.concatenate(self.new))
        self.new, self.waiting = [], 0
        first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
        codes, counts = codes[first].astype(np.int64), np.diff(first, append=len(codes))
        at = np.searchsorted(self.codes, codes)
        old = np.zeros(len(codes), bool)
        inner = at < len(self.codes)
        old[inner] = self.codes[at[inner]] == codes[inner]
        self.counts[at[old]] += counts[old]
        self.codes, self.counts = np.insert(self.codes, at[~old], codes[~old]), np.insert(self.counts, at[~old], counts[~old])


def packed(codes: np.ndarray, counts: np.ndarray) -> bytes:
    """Rising numbers below 2**32 and their counts, compressed."""
    return zlib.compress(np.diff(codes, prepend=0).astype(np.uint32).tobytes() + counts.astype(np.int64).tobytes(), 1)


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(blob)
    n = len(raw) // 12
    return np.cumsum(np.frombuffer(raw, np.uint32, n), dtype=np.int64), np.frombuffer(raw, np.int64, n, 4 * n)


def _rows_of(size: int) -> int:
    """Rows of a block of the words x words matrix."""
    return max(1, _CELLS // max(1, size))


def word_pairs(docs: DataFrame, q: Queries) -> tuple[DataFrame, np.ndarray, np.ndarray, int, int]:
    """Stored (block, sums), and per word its occurrences and document frequency, number of passages and of those with a word of the vocabulary.

    Passages are narrow, side by side, over all texts. sums: for rows of the words x words matrix the sum over all passages of the
    product of both words' occurrences, ``packed`` as row in the block * words + column.
    """
    size, width = len(q.vocabulary), NARROW * STEP
    rows = _rows_of(size)

    def blocks(sums: Sums):
        """The lower triangle is written for both of its words; a word with itself counts each pair of places twice."""
        sums.merge()
        i, j, n = sums.codes // size, sums.codes % size, sums.counts
        one, two = i > j, np.where(i == j, 2 * n, n)
        i, j, n = np.concatenate([i, j[one]]), np.concatenate([j, i[one]]), np.concatenate([two, n[one]])
        code = i * size + j
        order = np.argsort(code)
        code, n, block = code[order], n[order], i[order] // rows
        edges = np.flatnonzero(np.diff(block, prepend=-1, append=-1))
        for a, e in zip(edges[:-1], edges[1:], strict=True):
            yield int(block[a]), packed(code[a:e] - int(block[a]) * rows * size, n[a:e])

    def count(state, columns):
        if columns is None:
            if state:
                yield from blocks(state["pairs"])
                # block -2: occurrences, the places a word shares with itself; block -1: frequencies, then both numbers of passages
                yield -2, packed(np.arange(size), state["times"])
                yield -1, packed(np.arange(size + 2), np.append(state["df"], [state["n"], state["held"]]))
            return
        if not state:
            state.update(df=np.zeros(size, np.int64), times=np.zeros(size, np.int64), n=0, held=0, pairs=Sums())
        for text in columns[0]:
            words = words_of(text)
            for at in range(0, len(words), _SEGMENT):
                ids = _ids(words[at : at + _SEGMENT], q.vocabulary)
                n = -(-len(ids) // width)
                state["n"] += n
                state.setdefault("cells", []).append(np.append(ids, np.full(n * width - len(ids), -1, np.int32)).reshape(n, width))
        if sum(map(len, state.get("cells", ()))) == 0:
            return
        # words of a passage in falling order, passages with few of them first
        cells = -np.sort(-np.concatenate(state.pop("cells")), axis=1)
        many = (cells >= 0).sum(axis=1)
        order = np.argsort(many, kind="stable")
        # numbers of pairs in 32 bits where they fit
        cells, many = cells[order].astype(np.int32 if size < 46_341 else np.int64), many[order]
        first = np.searchsorted(many, 1)
        state["held"] += len(many) - int(first)
        known = cells >= 0
        state["times"] += np.bincount(cells[known], minlength=size)
        known[:, 1:] &= cells[:, 1:] != cells[:, :-1]
        state["df"] += np.bincount(cells[known], minlength=size)
        for at in range(int(first), len(cells), 2_048):
            part = cells[at : at + 2_048, : many[min(at + 2_048, len(many)) - 1]]
            a, b = np.triu_indices(part.shape[1], 1)
            later = part[:, b]
            state["pairs"].add((part[:, a] * size + later)[later >= 0])
        if len(state["pairs"].codes) > _PAIRS:
            yield from blocks(state["pairs"])
            state["pairs"] = Sums()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by block: one row per block."""
        last, total = None, None

        def out():
            at = np.flatnonzero(total)
            return pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([packed(at, total[at])], pa.binary())], ["block", "sums"])

        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if block != last:
                    if last is not None:
                        yield out()
                    last, total = block, np.zeros(max(rows * size, size + 2), np.int64)
                codes, counts = unpacked(blob.as_py())
                total[codes] += counts
        if last is not None:
            yield out()

    parts = docs.select("text").mapInArrow(_mapper(count, ["block", "sums"], [pa.int32(), pa.binary()]), "block int, sums binary")
    pairs = stored(parts.repartition("block").sortWithinPartitions("block").mapInArrow(add, "block int, sums binary"), "word-pairs")
    totals = np.zeros((2, size + 2))
    for r in pairs.where("block < 0").collect():
        codes, counts = unpacked(r["sums"])
        totals[r["block"]][codes] = counts
    return pairs, totals[0][:size], totals[1][:size], int(totals[1][size]), int(totals[1][size + 1])


def product(pairs: DataFrame, times: np.ndarray, weights: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """A' A basis, where the rows of A are the weighted passages: each task multiplies rows of the words x words matrix."""
    size, width = basis.shape
    rows = _rows_of(size)
    scaled = basis * weights[:, None]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                codes, counts = unpacked(blob.as_py())
                first = block * rows
                matrix = np.zeros((min(rows, size - first), size))
                matrix.reshape(-1)[codes] = counts
                z = (matrix @ scaled) * weights[first : first + len(matrix), None]
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([z.tobytes()], pa.binary())], ["block", "z"])

    out = (times * weights)[:, None] * scaled
    got = pairs.where("block >= 0").mapInArrow(multiply, "block int, z binary").toArrow()
    for block, z in zip(got.column("block").to_pylist(), got.column("z").to_pylist(), strict=True):
        part = np.frombuffer(z).reshape(-1, width)
        out[block * rows : block * rows + len(part)] += part
    return out


def latent_space(pairs: DataFrame, times: np.ndarray, held: int, q: Queries, idf: np.ndarray, s: Settings) -> np.ndarray:
    """Words x rank: right singular vectors of the corpus's and the benchmark's passages."""
    rng = np.random.default_rng(s.seed)
    size, width = len(idf), min(len(idf), s.rank + s.extra)
    own = [np.unique(_ids(w, q.vocabulary), return_counts=True) for w in q.words]
    # the benchmark's passages weigh as much as the corpus's together
    boost = max(1.0, held / max(1, len(own)))

    def multiplied(basis: np.ndarray) -> np.ndarray:
        z = product(pairs, times, idf, basis) if held else np.zeros_like(basis)
        for terms, k in own:
            a = k * idf[terms]
            z[terms] += boost * a[:, None] * (a @ basis[terms])[None, :]
        return z

    basis = np.linalg.qr(rng.standard_normal((size, width)))[0]
    for _ in range(s.rounds):
        basis = np.linalg.qr(multiplied(basis))[0]
    z = multiplied(basis)
    _, vectors = np.linalg.eigh((basis.T @ z + z.T @ basis) / 2)
    return (basis @ vectors[:, ::-1])[:, : min(s.rank, width)]


def lcs(masks: dict[str, int], size: int, words: list[str]) -> int:
    """Length of the longest common subsequence, bit-parallel over the pattern given by its masks."""
    full = (1 << size) - 1
    v = full
    for w in words:
        m = masks.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


def possible(masks: dict[str, int], words: list[str]) -> int:
    """Places of the pattern whose word is among ``words``, at most as many as there are such words: no common subsequence is longer."""
    held = list(filter(None, map(masks.get, words)))
    return min(len(held), reduce(or_, held, 0).bit_count())


def _block_sums(embed: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Sums of the vectors of each row of word numbers, where -1 (the last vector) is zero."""
    sums = np.empty((len(cells), embed.shape[1]), embed.dtype)
    for at in range(0, len(cells), 1_024):
        part = cells[at : at + 1_024]
        total = embed[part[:, 0]]
        for j in range(1, part.shape[1]):
            total += embed[part[:, j]]
        sums[at : at + 1_024] = total
    return sums


def _has_run(words: list[str], run: list[str]) -> bool:
    if not run:
        return True
    joined = " " + " ".join(words) + " "
    return " " + " ".join(run) + " " in joined


def search(docs: DataFrame, q: Queries, space: np.ndarray, idf: np.ndarray, s: Settings, keys: list[str]) -> DataFrame:
    """(keys, item, cosine, lcs, first, answer): verified passages, the best place per document and item."""
    embed = np.vstack([space * idf[:, None], np.zeros((1, space.shape[1]))]).astype(np.float32)  # the last row is for other words
    vectors = np.stack([embed[_ids(w, q.vocabulary)].sum(axis=0) for w in q.words])
    norms = np.linalg.norm(vectors, axis=1)
    vectors = (vectors / np.maximum(norms, 1e-9)[:, None]).astype(np.float32)
    narrow = np.array([len(w) <= NARROW * STEP for w in q.words])
    masks = []
    for w in q.words:
        m: dict[str, int] = {}
        for i, x in enumerate(w):
            m[x] = m.get(x, 0) | 1 << i
        masks.append(m)
    limit = float(s.cosine)

    def windows(texts: list[list[str]]):
        """(document, first word, sums over narrow windows, sums over wide windows) per segment."""
        kept = []
        for d, words in enumerate(texts):
            for at in range(0, max(1, len(words)), _SEGMENT):
                ids = _ids(words[at : at + _SEGMENT + WIDE * STEP], q.vocabulary)
                if (ids >= 0).any():
                    kept.append((d, at, ids))
        edges = np.cumsum([0, *(-(-len(ids) // STEP) for _, _, ids in kept)])
        cells = np.full((edges[-1], STEP), -1, np.int32)
        for (_, _, ids), first in zip(kept, edges[:-1], strict=True):
            cells.reshape(-1)[first * STEP : first * STEP + len(ids)] = ids
        sums = _block_sums(embed, cells)
        for (d, at, _), first, end in zip(kept, edges[:-1], edges[1:], strict=True):
            n = end - first
            pad = np.zeros((n + WIDE, embed.shape[1]), np.float32)
            pad[:n] = sums[first:end]
            two = pad[:-1] + pad[1:]
            yield d, at, two[: max(1, n - 1)], (two[:-2] + two[2:])[: max(1, n - 2) : 2]

    def find(state, columns):
        if columns is None:
            return
        texts = [words_of(t) for t in columns[-1]]
        segments = list(windows(texts))
        best: dict = {}
        for part, chosen, stride, size in ((2, np.flatnonzero(narrow), STEP, NARROW), (3, np.flatnonzero(~narrow), 2 * STEP, WIDE)):
            if not segments or not len(chosen):
                continue
            lengths = [len(x[part]) for x in segments]
            sums = np.concatenate([x[part] for x in segments])
            owner = np.repeat(np.arange(len(segments)), lengths)
            place = np.concatenate([np.arange(n) for n in lengths]) * stride
            norm = np.maximum(np.sqrt(np.einsum("ij,ij->i", sums, sums)), 1e-9)
            dots = sums @ vectors[chosen].T
            for w, c in zip(*np.nonzero(dots >= limit * norm[:, None]), strict=True):
                k = int(chosen[c])
                d, at = segments[owner[w]][0], segments[owner[w]][1] + int(place[w])
                n = len(q.words[k])
                low, high = max(0, at - n), at + size * STEP + n
                near = texts[d][low:high]
                if possible(masks[k], near) < s.with_answer * n:
                    continue
                common = lcs(masks[k], n, near)
                if common < s.with_answer * n:
                    continue
                there = _has_run(near, q.answer[k])
                if common >= s.lcs * n or there:
                    row = (common / n, float(dots[w, c] / norm[w]), common, low, there)
                    if row > best.get((d, q.item[k]), (0,)):
                        best[d, q.item[k]] = row
        for (d, item), (_, c, common, low, there) in best.items():
            yield (*(x[d] for x in columns[:-1]), item, c, common, low, there)

    kinds = dict(docs.dtypes)
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", item_id long, cosine double, lcs long, near long, answer boolean"
    run = _mapper(find, [*keys, "item_id", "cosine", "lcs", "near", "answer"], [*(arrow[kinds[k]] for k in keys), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.bool_()])
    return docs.select(*keys, "text").mapInArrow(run, schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings(), keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Stored rows (keys, item_id, cosine, lcs, near, answer): benchmark items found in documents.

    near: a word (from 0) of the document near which the passage begins. NULL and empty texts hold nothing; items without a
    word are not looked for; repeated rows and repeated items give a row each time; empty tables give no rows. Columns other than
    the keys, text and item_id do not matter.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    n = items.count()
    blocks = max(1, -(-n // s.block_items))
    found = None
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        q = Queries.of([(r["item_id"], r["text"]) for r in rows])
        if not q.words:
            continue
        pairs, times, df, passages, held = word_pairs(docs, q)
        idf = np.log((passages + 1) / (df + 1)) + 1e-6
        space = latent_space(pairs, times, held, q, idf, s)
        discard(pairs)
        part = search(docs, q, space, idf, s, list(keys))
        found = part if found is None else found.union(part)
    if found is None:
        kinds = dict(docs.dtypes)
        return spark.createDataFrame([], ", ".join(f"{k} {kinds[k]}" for k in keys) + ", item_id long, cosine double, lcs long, near long, answer boolean")
    return stored(found, "contaminated")


def clean(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` without any benchmark item, with their own columns."""
    h, of, bad_text = (fresh(docs.columns, x) for x in ("text_hash", "bad_id", "bad_text"))
    marked = docs.withColumn(h, text_hash(F.col("text")))
    bad = contaminated(marked.select("doc_id", h, "text"), benchmark, s, ("doc_id", h)).select(F.col("doc_id").alias(of), F.col(h).alias(bad_text)).distinct()
    return marked.join(bad, F.col("doc_id").eqNullSafe(F.col(of)) & (F.col(h) == F.col(bad_text)), "left_anti").select(*docs.columns)
