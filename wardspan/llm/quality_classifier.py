"""Quality classifier: naive Bayes support vectors.

A text is a set of n-gram indicators, hashed: its words and word pairs, and the same over word outlines (letter cases, digits
and signs in a row counted once; a word equal to the one before it has an outline of its own). Each indicator is scaled by the
log-count ratio of the two classes, each text to length one, and a linear hinge-loss model is fitted by dual coordinate descent.

All labelled rows take part. Counts are summed over all of them. The fit runs over blocks of rows, inside the partitions of
the stored training table, and the models are averaged by rows (their number grows with the table, their size does not). An
eighth of the labelled rows is left out of both; on it the margins are turned into probabilities by a logistic curve
fitted to a histogram.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardspan.llm.common import stored
from wardspan.llm.shingle_sets import IS_UPPER, LETTER, mix, word_bounds, word_sums

_PAIR, _NEXT, _OUTLINE, _SAME = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63))
_BYTES = np.arange(256, dtype=np.uint64)
_LOWER = ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
_CLASS = np.where(_LOWER, 97, np.where(IS_UPPER, 65, np.where((_BYTES >= 48) & (_BYTES <= 57), 48, _BYTES))).astype(np.uint8)
with np.errstate(over="ignore"):
    _SIGN = mix(_CLASS.astype(np.uint64) + _OUTLINE)
_CHUNK = 4_096
_STEPS = 256  # of the margin's histogram, per unit; margins of unit vectors are cut at 16 either side
#: Rows of a label table up to which it is broadcast; beyond, it is joined by a shuffle.
_BROADCAST_ROWS = 1_000_000


@dataclass(frozen=True)
class Settings:
    """bits: of the hashed indicators. smoothing: added to every count. cost, rounds, tolerance: of the descent. block_rows,
    block_indicators: a block ends with whichever is reached first. threshold: score from which a text is predicted good."""

    bits: int = 18
    smoothing: float = 1.0
    cost: float = 1.0
    rounds: int = 12
    tolerance: float = 0.05
    block_rows: int = 4_000
    block_indicators: int = 6_000_000
    threshold: float = 0.7


def indicator_sets(texts: list[str | None], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, indicator) of all texts, sorted and distinct: the text's position, and a number below 2 ** bits.

    Words are what stands between ASCII white space; they are found and hashed for all texts at once.
    """
    encoded = [(t or "").encode("utf-8", "surrogatepass") + b"\n" for t in texts]
    data = np.frombuffer(b"\n" + b"".join(encoded), np.uint8)
    starts, ends, begin = word_bounds(data)
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    text = np.searchsorted(np.cumsum([len(e) for e in encoded]) + 1, starts, "right")
    at = np.arange(len(data))
    word = word_sums(LETTER[data], at - begin, starts, ends)
    kind = _CLASS[data]
    turn = np.concatenate([[True], kind[1:] != kind[:-1]]) | (at == begin)  # one sign for equal ones in a row
    turned = np.cumsum(turn)
    outline = word_sums(np.where(turn, _SIGN[data], np.uint64(0)), turned - turned[begin], starts, ends)
    together = text[1:] == text[:-1]
    outline[1:][together & (word[1:] == word[:-1])] = _SAME
    with np.errstate(over="ignore"):
        pairs = [mix(x[:-1] * _PAIR + x[1:] * _NEXT + k)[together] for x, k in ((word, _PAIR), (outline, _OUTLINE))]
        grams = np.concatenate([word, mix(outline + _OUTLINE), *pairs]) >> np.uint64(64 - bits)
    owner = np.concatenate([text, text, text[1:][together], text[1:][together]])
    keys = np.sort((owner << bits) + grams.astype(np.int64))
    keys = keys[np.flatnonzero(np.diff(keys, prepend=-1))]
    return keys >> bits, keys & ((1 << bits) - 1)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        step = max(1, int(batch.num_rows * 2e6 / (batch.nbytes + 1)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def training_table(docs: DataFrame, labels: DataFrame, s: Settings) -> DataFrame:
    """Stored (good, part, gaps): indicators of the labelled rows as distances between them; part 0 is for calibration.

    ``labels``: doc_id, quality (0, 1 or NULL). Several labels of one id are averaged, from a half on it is good.
    """
    known = labels.where("quality is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg((F.avg("quality") >= 0.5).alias("good"))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    rows = rows.join(F.broadcast(known) if known.count() <= _BROADCAST_ROWS else known, "id").select("good", F.pmod(F.xxhash64("id"), F.lit(8)).cast("int").alias("part"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _texts(batches):
            text, ids = indicator_sets(piece.column(2).to_pylist(), s.bits)
            cuts = np.searchsorted(text, np.arange(1, piece.num_rows))
            gaps = [np.diff(x, prepend=0).astype(np.int32).tobytes() for x in np.split(ids, cuts)]
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(gaps, pa.binary())], ["good", "part", "gaps"])

    return stored(rows.mapInArrow(run, "good boolean, part int, gaps binary"), "labelled-indicators")


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, np.ndarray]]:
    for batch in batches:
        for good, gaps in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            yield good, np.cumsum(np.frombuffer(gaps.as_buffer(), np.int32))


def summed(rows: DataFrame, fold: Callable[[Iterator[tuple[bool, np.ndarray]]], np.ndarray], size: int) -> np.ndarray:
    """Sum over all partitions of the array (of ``size`` numbers) that ``fold`` makes of a partition's examples.

    Spark adds the arrays up element by element; what comes back has ``size`` numbers whatever the table's size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = fold(_examples(batches))
        for at in range(0, size, _CHUNK):
            if total[at : at + _CHUNK].any():
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total[at : at + _CHUNK]], pa.list_(pa.float64()))], ["first", "v"])

    parts = rows.select("good", "gaps").mapInArrow(run, "first int, v array<double>").select("first", F.posexplode("v").alias("i", "v"))
    got = parts.where("v <> 0").groupBy((F.col("first") + F.col("i")).alias("at")).agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(size)
    out[got.column("at").to_numpy()] = got.column("v").to_numpy()
    return out


def log_count_ratios(rows: DataFrame, s: Settings) -> np.ndarray:
    """Log of the ratio of an indicator's shares in good and in bad texts."""
    size = 1 << s.bits

    def count(examples) -> np.ndarray:
        out = np.zeros(2 * size)
        for good, ids in examples:
            out[ids + size * good] += 1
        return out

    bad, fine = summed(rows, count, 2 * size).reshape(2, size) + s.smoothing
    return np.log((fine / fine.sum()) / (bad / bad.sum()))


def _unit(ids: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    v = ratios[ids]
    return v / max(1e-9, float(np.sqrt(v @ v)))


def descend(examples: list[tuple[bool, np.ndarray, np.ndarray]], size: int, s: Settings) -> np.ndarray:
    """Weights, the last one the bias, of the hinge-loss model of (good, ids, values): dual coordinate descent.

    Minimises |w|^2 / 2 + cost * sum of hinge losses; ends when no dual variable can move by more than the tolerance.
    """
    w, alpha, rng = np.zeros(size + 1), np.zeros(len(examples)), np.random.default_rng(0)
    square = [float(v @ v) + 1.0 for _, _, v in examples]
    for _ in range(s.rounds):
        widest = 0.0
        for i in rng.permutation(len(examples)):
            good, ids, v = examples[i]
            y = 1.0 if good else -1.0
            slope = y * (float(w[ids] @ v) + w[-1]) - 1.0
            moved = min(max(alpha[i] - slope / square[i], 0.0), s.cost) - alpha[i]
            if moved:
                alpha[i] += moved
                w[ids] += moved * y * v
                w[-1] += moved * y
                widest = max(widest, abs(moved) * square[i])
        if widest < s.tolerance:
            break
    return w


def weights(rows: DataFrame, ratios: np.ndarray, s: Settings) -> np.ndarray:
    """Weights of the averaged blocks, the last one the bias."""
    size = 1 << s.bits

    def fit(examples) -> np.ndarray:
        total, block, held = np.zeros(size + 2), [], 0

        def close() -> None:
            total[:-1] += len(block) * descend(block, size, s)
            total[-1] += len(block)
            block.clear()

        for good, ids in examples:
            block.append((good, ids, _unit(ids, ratios)))
            held += len(ids)
            if len(block) >= s.block_rows or held >= s.block_indicators:
                close()
                held = 0
        if block:
            close()
        return total

    total = summed(rows, fit, size + 2)
    return total[:-1] / max(1.0, total[-1])


def logistic(margins: np.ndarray, good: np.ndarray, bad: np.ndarray) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(-(a * margin + b))) for counts of good and bad texts at each margin, by Newton steps.

    Targets are kept off 0 and 1 by one text each, and the slope positive, so that tiny or one-sided counts have a result.
    """
    n1, n0 = good.sum(), bad.sum()
    high, low = (n1 + 1) / (n1 + 2), 1 / (n0 + 2)
    n, hits = good + bad, good * high + bad * low
    a, b = 2.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -40, 40)))
        g = np.array([(margins * (hits - n * p)).sum() - 1e-3 * (a - 2.0), (hits - n * p).sum() - 1e-3 * b])
        q = n * p * (1 - p)
        h = np.array([[(q * margins**2).sum() + 1e-3, (q * margins).sum()], [(q * margins).sum(), q.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(1e-12, float(np.abs(step).max())))
        a, b = max(0.1, a + step[0]), b + step[1]
        if float(np.abs(step).max()) < 1e-9:
            break
    return a, b


@dataclass
class Model:
    """scaled: ratio times weight of each indicator; squares: of the ratios, for the length; bias, a and b of the curve."""

    settings: Settings
    scaled: np.ndarray
    squares: np.ndarray
    bias: float
    a: float = 2.0
    b: float = 0.0

    def margin(self, ids: np.ndarray) -> float:
        return float(self.scaled[ids].sum()) / max(1e-9, float(np.sqrt(self.squares[ids].sum()))) + self.bias

    def scores(self, texts: list[str | None]) -> np.ndarray:
        text, ids = indicator_sets(texts, self.settings.bits)
        dots, squares = (np.bincount(text, x[ids], len(texts)) for x in (self.scaled, self.squares))
        return 1 / (1 + np.exp(-np.clip(self.a * (dots / np.maximum(1e-9, np.sqrt(squares)) + self.bias) + self.b, -40, 40)))


def fitted(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    """The model of all labelled rows of ``docs``."""
    table = training_table(docs, labels, s)
    learn, check = table.where("part > 0"), table.where("part = 0")
    ratios = log_count_ratios(learn, s)
    w = weights(learn, ratios, s)
    model = Model(s, (ratios * w[:-1]).astype(np.float32), (ratios**2).astype(np.float32), float(w[-1]))
    half = 16 * _STEPS

    def histogram(examples) -> np.ndarray:
        out = np.zeros(4 * half)
        for good, ids in examples:
            out[2 * half * good + min(2 * half - 1, max(0, int(np.floor(model.margin(ids) * _STEPS)) + half))] += 1
        return out

    bad, good = summed(check, histogram, 4 * half).reshape(2, 2 * half)
    model.a, model.b = logistic((np.arange(2 * half) - half + 0.5) / _STEPS, good, bad)
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """Every row's doc_id, score and predicted. Texts are read whole; NULL and empty ones have no indicator and get the bias's score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _texts(batches):
            scores = model.scores(piece.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(scores), pa.array(scores >= model.settings.threshold).cast(pa.int32())], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def judged(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Rows whose crc32(doc_id as text) modulo 4 is 2 are held out: no label of theirs is learnt from. Rows without id are not
    held out and have no label. Repeated rows count each. NULL, empty and very long texts: see ``scored``; equal texts have
    equal scores. Without any label every score is a half; an empty table gives no rows. Other columns do not matter.
    """
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = fitted(docs.where(~held_out), labels, s)
    return scored(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")
