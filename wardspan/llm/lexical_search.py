"""Ranked lexical search over norm buckets: exact top documents for every query text.

1. One pass over all texts keeps, of each document, its length and the frequencies of the terms that some query has.
2. Collection counts (documents, terms, document frequencies) give every such term a weight and every document an impact
vector; its length (norm) is taken with the weights shared out evenly between the two sides of the product.
3. Every partition is sorted by norm, longest first, and cut into buckets. For a query the product with any vector of a bucket
is at most |query| * norm of the bucket's first row (Cauchy-Schwarz): once that is below the query's threshold, this bucket
and all after it are left closed for the query.
4. Inside an open bucket the query's coordinates are multiplied out, the largest first, until the bounds on the rest (norms of
what is left of both vectors, largest coordinates in the bucket) leave few rows.
5. Survivors are scored in 64-bit integers, exactly. Thresholds begin with the scores of a small sample, which can only be too
low, and rise.

No vector is left out: thresholds are k-th best scores of documents that have been seen, and equality stays in. Partitions
report at most k documents a query, so what is merged grows with partitions and queries only.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wardspan.llm.common import stored

#: Digits, letters and all bytes of non-ASCII characters stay, A-Z in lower case; everything else is a blank.
_KEPT = bytes(c if chr(c).isdigit() or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_SLACK = 1 + 1e-9


@dataclass(frozen=True)
class Settings:
    """k: documents per query. bucket_rows, bucket_terms: a bucket ends with whichever is reached first. step:
    coordinates multiplied out between two looks at the bounds; few: share of a bucket's rows at which its survivors are
    scored. seed_rows: about so many documents give the first thresholds. block_bytes: query text searched in one pass over the documents. None but k changes the result."""

    k: int = 20
    bucket_rows: int = 2_048
    bucket_terms: int = 1_000_000
    step: int = 4
    few: float = 0.05
    seed_rows: int = 4_096
    block_bytes: int = 16 << 20


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_KEPT).split()


@dataclass
class Queries:
    """ids: of the items; counts: term number -> occurrences, per item; vocabulary: term -> number."""

    ids: list
    counts: list[dict[int, int]]
    vocabulary: dict[bytes, int]

    @staticmethod
    def of(rows: list[tuple[object, str]]) -> Queries:
        counted = [Counter(terms(text)) for _, text in rows]
        vocabulary = {t: i for i, t in enumerate(sorted(set().union(*counted)))}
        return Queries([key for key, _ in rows], [{vocabulary[t]: n for t, n in c.items()} for c in counted], vocabulary)


def _pieces(batches: Iterator[pa.RecordBatch], size: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        step = max(1, int(batch.num_rows * size / (batch.nbytes + 1)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def _lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(values, kind))


def term_counts(docs: DataFrame, q: Queries) -> DataFrame:
    """Stored (doc_id, n, ids, tfs): all terms counted in n, those of the queries listed. Documents without a term are left out."""
    vocabulary, size = q.vocabulary, max(1, len(q.vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches, 8e6):
            n, keys = np.zeros(piece.num_rows, np.int64), []
            for d, text in enumerate(piece.column(1).to_pylist()):
                words = terms(text)
                n[d] = len(words)
                found = np.fromiter(map(vocabulary.get, words, repeat(-1)), np.int64, len(words))
                keys.append(found[found >= 0] + d * size)
            held, tfs = np.unique(np.concatenate(keys), return_counts=True)
            some = n > 0
            lengths = np.bincount(held // size, minlength=len(n))[some]
            yield pa.RecordBatch.from_arrays(
                [piece.column(0).filter(pa.array(some)), pa.array(n[some]), _lists(held % size, lengths, pa.int32()), _lists(tfs, lengths, pa.int32())], ["doc_id", "n", "ids", "tfs"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stored(rows.mapInArrow(run, "doc_id long, n long, ids array<int>, tfs array<int>"), "term-counts")


@dataclass
class Collection:
    """documents: with a term. length: of all texts together, in terms. weights: of the vocabulary's terms."""

    documents: int
    length: int
    weights: np.ndarray

    @staticmethod
    def of(counts: DataFrame, q: Queries) -> Collection:
        n, length = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        held = counts.select(F.explode("ids").alias("id")).groupBy("id").count().toArrow()
        df = np.zeros(len(q.vocabulary), np.int64)
        df[held.column("id").to_numpy()] = held.column("count").to_numpy()
        return Collection(n, length, np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(x) + 1))) for x in df], np.int64))


def impact_vectors(counts: DataFrame, c: Collection) -> DataFrame:
    """(doc_id, norm, ids, impacts) of the documents that have a term of weight above 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches, 8e6):
            ids, tfs = (piece.column(i).flatten().to_numpy() for i in (2, 3))
            row = np.repeat(np.arange(piece.num_rows), piece.column(2).value_lengths().to_numpy())
            # in whole numbers of any size: lengths times documents leave 64 bits at large scale
            m = np.array([75 + 25 * n * c.documents // c.length for n in piece.column(1).to_pylist()], np.int64)
            value = 1_000_000_000 * tfs.astype(np.int64) // (1_000 * tfs.astype(np.int64) + 12 * m[row])
            kept = c.weights[ids] > 0
            ids, row, value = ids[kept], row[kept], value[kept]
            norm = np.sqrt(np.bincount(row, c.weights[ids] * value.astype(float) ** 2, piece.num_rows))
            some = norm > 0
            lengths = np.bincount(row, minlength=piece.num_rows)[some]
            yield pa.RecordBatch.from_arrays(
                [piece.column(0).filter(pa.array(some)), pa.array(norm[some]), _lists(ids, lengths, pa.int32()), _lists(value, lengths, pa.int32())], ["doc_id", "norm", "ids", "impacts"])

    return counts.mapInArrow(run, "doc_id long, norm double, ids array<int>, impacts array<int>")


class Best:
    """The k best (score, doc_id) seen; equal scores by ascending id, rows without id first."""

    def __init__(self, k: int, threshold: int):
        self.k, self.threshold = k, max(1, threshold)
        self.score, self.known, self.doc = np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64)

    def add(self, score: np.ndarray, known: np.ndarray, doc: np.ndarray) -> None:
        score, known, doc = (np.concatenate(x) for x in ((self.score, score), (self.known, known), (self.doc, doc)))
        order = np.lexsort((doc, known, -score))[: self.k]
        self.score, self.known, self.doc = score[order], known[order], doc[order]
        if len(order) == self.k:
            self.threshold = max(self.threshold, int(self.score[-1]))


class Query:
    """Coordinates of an item, the largest ones first; rest[i]: norm of all from the i-th on."""

    def __init__(self, counts: dict[int, int], weights: np.ndarray):
        ids = np.array(sorted(counts), np.int64)
        times = np.array([counts[i] for i in ids.tolist()], np.int64)
        ids, times = ids[weights[ids] > 0], times[weights[ids] > 0]
        value = times * np.sqrt(weights[ids])
        order = np.argsort(-value, kind="stable")
        self.ids, self.weights = ids[order], (times * weights[ids])[order]
        self.rest = np.sqrt(np.concatenate([np.cumsum(value[order][::-1] ** 2)[::-1], [0.0]]))
        self.norm = float(self.rest[0])


class Bucket:
    """Rows of about the same norm, longest first: their vectors by row, and by term."""

    def __init__(self, doc, known, norm, lengths, ids, values, weights: np.ndarray):
        self.doc, self.known, self.norm, self.lengths, self.ids, self.values, self.weights = doc, known, norm, lengths, ids, values, weights
        self.first = np.concatenate([[0], np.cumsum(lengths)])
        order = np.argsort(ids, kind="stable")
        by_term, self.row = ids[order], np.repeat(np.arange(len(lengths)), lengths)[order]
        self.value = values[order].astype(float)
        self.start = np.searchsorted(by_term, np.arange(len(weights) + 1))
        held = np.flatnonzero(np.diff(self.start))
        self.largest = np.zeros(len(weights))
        self.largest[held] = np.maximum.reduceat(self.value, self.start[held])

    def survivors(self, q: Query, threshold: int, s: Settings) -> np.ndarray:
        """Rows whose product with the query may reach the threshold.

        What is not multiplied out yet is at most the product of the norms left, and at most the query's coordinates left
        with the largest ones of the bucket. Coordinates are taken until few rows remain.
        """
        m = int(np.searchsorted(-self.norm, -(threshold - 1) / (q.norm * _SLACK), "right"))  # Cauchy-Schwarz, row by row
        done, left = np.zeros(m), self.norm[:m] ** 2
        slack = left * 1e-14
        tops = np.concatenate([np.cumsum((q.weights * self.largest[q.ids])[::-1])[::-1], [0.0]])
        rows = np.arange(m)
        for i, t in enumerate(q.ids.tolist()):
            if i % s.step == 0:
                bound = done + np.minimum(q.rest[i] * np.sqrt(np.maximum(left, 0) + slack), tops[i])
                rows = np.flatnonzero(bound * _SLACK + 1 >= threshold)
                if len(rows) <= s.few * m:
                    return rows
            a, b = self.start[t : t + 2]
            row, value = self.row[a:b], self.value[a:b]
            if m < len(self.norm):
                b = int(np.searchsorted(row, m))
                row, value = row[:b], value[:b]
            done[row] += q.weights[i] * value
            left[row] -= self.weights[t] * value * value
        return np.flatnonzero(done * _SLACK + 1 >= threshold)

    def scores(self, rows: np.ndarray, full: np.ndarray) -> np.ndarray:
        """Exact products of the rows with a query written out over the whole vocabulary."""
        lengths = self.lengths[rows]
        begin = np.cumsum(lengths) - lengths
        at = np.repeat(self.first[rows] - begin, lengths) + np.arange(lengths.sum())
        return np.add.reduceat(full[self.ids[at]] * self.values[at], begin)


class Searcher:
    """Takes buckets in order of falling norm; opened: (query, bucket) pairs, scored: exact scores, for measurement."""

    def __init__(self, q: Queries, weights: np.ndarray, thresholds: list[int], s: Settings):
        self.queries = [Query(c, weights) for c in q.counts]
        self.settings, self.best = s, [Best(s.k, t) for t in thresholds]
        self.full, self.opened, self.scored = np.zeros(len(weights), np.int64), 0, 0

    def add(self, bucket: Bucket) -> bool:
        """False if no query opens the bucket: none will open a later one."""
        opened = 0
        for q, best in zip(self.queries, self.best, strict=True):
            if q.norm * bucket.norm[0] * _SLACK + 1 < best.threshold or not q.norm:
                continue
            opened += 1
            rows = bucket.survivors(q, best.threshold, self.settings)
            if not len(rows):
                continue
            self.full[q.ids] = q.weights
            score = bucket.scores(rows, self.full)
            self.full[q.ids] = 0
            self.scored += len(rows)
            good = score >= best.threshold
            best.add(score[good], bucket.known[rows][good], bucket.doc[rows][good])
        self.opened += opened
        return opened > 0


def buckets(batches: Iterator[pa.RecordBatch], weights: np.ndarray, s: Settings) -> Iterator[Bucket]:
    """Consecutive rows, as long as neither their number nor their terms are too many."""
    for piece in _pieces(batches, 64e6):
        lengths = piece.column(2).value_lengths().to_numpy().astype(np.int64)
        ends, at = np.cumsum(lengths), 0
        while at < len(lengths):
            before = ends[at] - lengths[at]
            to = min(at + s.bucket_rows, max(at + 1, int(np.searchsorted(ends, before + s.bucket_terms, "right"))))
            part = piece.slice(at, to - at)
            doc = part.column(0)
            yield Bucket(doc.fill_null(0).to_numpy(), doc.is_valid().to_numpy(zero_copy_only=False), part.column(1).to_numpy(), lengths[at:to],
                         part.column(2).flatten().to_numpy(), part.column(3).flatten().to_numpy().astype(np.int64), weights)
            at = to


def search(vectors: DataFrame, q: Queries, c: Collection, thresholds: list[int], s: Settings) -> DataFrame:
    """(item, doc_id, score): every partition's best documents for each item (its number), at or above its threshold."""
    weights = c.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher, going = Searcher(q, weights, thresholds, s), True
        for bucket in buckets(batches, weights, s):
            going = going and searcher.add(bucket)
        for i, best in enumerate(searcher.best):
            if len(best.doc):
                doc = pa.array(best.doc, pa.int64(), mask=~best.known)
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(doc), pa.int32()), doc, pa.array(best.score)], ["item", "doc_id", "score"])

    return vectors.sortWithinPartitions(F.desc("norm")).mapInArrow(run, "item int, doc_id long, score long")


def _first_thresholds(counts: DataFrame, q: Queries, c: Collection, s: Settings) -> list[int]:
    """k-th best scores in about ``seed_rows`` documents: never above the true ones."""
    share = max(1, c.documents // s.seed_rows)
    some = impact_vectors(counts.where(F.pmod(F.xxhash64("doc_id", "n", "ids"), F.lit(share)) == 0), c)
    found = search(some, q, c, [0] * len(q.ids), s)
    best = found.withColumn("place", F.row_number().over(W.partitionBy("item").orderBy(F.desc("score")))).where(F.col("place") == s.k)
    known = {r["item"]: r["score"] for r in best.collect()}  # one row per item of this block
    return [known.get(i, 0) for i in range(len(q.ids))]


def ranked(docs: DataFrame, items: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The best documents of each item: item_id, rank (from 1), doc_id, score.

    ``docs``: doc_id, text; ``items``: item_id, text; other columns do not matter. NULL and empty texts have no terms: such
    documents count nowhere, such items find nothing. Repeated documents are ranked each; equal scores go by doc_id, rows
    without id first. Repeated items are searched once. Texts are whole, however long. Empty tables give no rows.
    """
    spark = docs.sparkSession
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").distinct()
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // s.block_bytes))
    out = None
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        q = Queries.of([(r["item_id"], r["text"]) for r in rows])
        if not q.vocabulary:
            continue
        counts = term_counts(docs, q)
        c = Collection.of(counts, q)
        if not c.documents:
            continue
        found = search(impact_vectors(counts, c), q, c, _first_thresholds(counts, q, c, s), s)
        order = W.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_first())
        top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= s.k)
        names = spark.createDataFrame(list(enumerate(q.ids)), "item int, item_id long")
        part = top.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = part if out is None else out.union(part)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
