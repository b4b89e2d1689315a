"""Quality rules whose cutoffs are certified on labelled documents.

A rule rejects a document when a signal (symbol share, repeated words, ...) reaches a cutoff. For every stratum and signal
the labelled good documents of the holdout are counted per signal level; the exact binomial tail tells whether the false
rejection rate at a cutoff is proven to be at most ``alpha / number of signals``. Cutoffs are tested from the mildest to the
strictest and testing stops at the first that fails (a fixed sequence needs no correction of its own); strata and signals
share the error by Bonferroni. So with probability ``1 - delta`` no stratum loses more than ``alpha`` of its good documents
to all rules together. Among the proven cutoffs the one with the best gain on the holdout is taken.
"""

from __future__ import annotations

import functools
import math
import operator
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wardspan.llm.common import fresh, let, stored, text_hash, words

SIGNALS = ("symbols", "dup_lines", "repeats", "shouting", "lexicon", "long_words")
LEVELS = 100
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Settings:
    """alpha: share of good documents all rules of a stratum may reject. delta: chance that this fails anywhere.
    penalty: rejected bad documents that outweigh one rejected good one. fit_docs: labelled documents at most from which the
    lexicon is fitted (a hashed fifth of the labels; the other labels are the holdout, all of them).
    lexicon_words: words in the lexicon at most."""

    strata: tuple[str, ...] = ("en", "de", "fr", "es")
    alpha: float = 0.05
    delta: float = 0.05
    penalty: float = 10.0
    fit_docs: int = 20_000
    lexicon_words: int = 40
    lexicon_support: int = 5


def _pair(h: Column, step: int) -> Column:
    return let(h, lambda a: F.when(F.size(a) > step, F.transform(F.sequence(F.lit(0), F.size(a) - 1 - step), lambda i: F.xxhash64(F.get(a, i), F.get(a, i + step)))).otherwise(F.array().cast("array<bigint>")))


def _covered(windows: Column, width: int) -> Column:
    """Words that lie in some window whose hash occurs twice or more."""

    def count(d: Column) -> Column:
        ranked = F.sort_array(F.transform(d, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        twice = let(ranked, lambda s: F.filter(s, lambda e, j: F.coalesce(F.get(s, j - 1)["x"] == e["x"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["x"] == e["x"], F.lit(False))))
        starts = F.sort_array(F.transform(twice, lambda e: e["i"]))
        return F.aggregate(
            starts, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-width).alias("last")),
            lambda acc, x: F.struct((acc["n"] + F.least(F.lit(width), x - acc["last"])).alias("n"), x.alias("last")), lambda acc: acc["n"],
        )

    return let(windows, lambda d: F.when(F.size(F.array_distinct(d)) == F.size(d), F.lit(0).cast("long")).otherwise(count(d)))


def with_signals(docs: DataFrame, lexicon: list[str], text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """Adds the counts and one level (0 to 100) per signal; returns the frame and the names given to the new columns."""
    t = F.coalesce(F.col(text), F.lit(""))
    name = {c: fresh(docs.columns, c) for c in (*COUNTS, *SIGNALS, "words", "n_lines")}
    n = lambda c: F.col(name[c])
    df = docs.withColumn(name["words"], words(F.col(text)))
    hashes = F.transform(n("words"), lambda w: F.xxhash64(w))
    line = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    lines = let(line, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    bad_word = r"\b(?:" + "|".join(sorted(re.escape(w) for w in lexicon)) + r")\b"
    df = df.select(
        *docs.columns,
        F.size(n("words")).cast("long").alias(name["n_words"]),
        F.length(F.array_join(n("words"), "")).cast("long").alias(name["word_chars"]),
        (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]+", ""))).cast("long").alias(name["n_symbols"]),
        lines.alias(name["n_lines"]),
        _covered(_pair(_pair(_pair(hashes, 1), 2), 4), 8).alias(name["n_repeat_words"]),
        (F.length(t) - F.length(F.regexp_replace(t, r"[A-Z!]+", ""))).cast("long").alias(name["shouting"]),
        (F.when(functools.reduce(operator.or_, (F.contains(F.lower(t), F.lit(w)) for w in lexicon)), F.regexp_count(F.lower(t), F.lit(bad_word))).otherwise(0) if lexicon else F.lit(0)).cast("long").alias(name["lexicon"]),
    )
    df = df.withColumn(name["n_dup_lines"], n("n_lines")["dup"])
    share = lambda a, b: F.least(F.lit(LEVELS), F.floor(100 * a / F.greatest(b, F.lit(1)))).cast("int")
    level = {
        "symbols": share(n("n_symbols"), n("word_chars")), "dup_lines": share(n("n_dup_lines"), n("n_lines")["n"]), "repeats": share(n("n_repeat_words"), n("n_words")),
        "shouting": share(n("shouting"), n("word_chars")), "lexicon": F.least(F.lit(LEVELS).cast("long"), n("lexicon")).cast("int"),
        "long_words": F.least(F.lit(LEVELS), F.floor(2 * n("word_chars") / F.greatest(n("n_words"), F.lit(1)))).cast("int"),
    }
    plain = [c for c in (*COUNTS,) if c != "n_dup_lines"]
    return df.select(*docs.columns, *(name[c] for c in plain), name["n_dup_lines"], *(level[s].alias(name[s]) for s in SIGNALS)), name


def base_failed(name: dict[str, str]) -> Column:
    return (F.col(name["n_words"]) < 20) | (100 * F.col(name["n_repeat_words"]) > 30 * F.col(name["n_words"]))


def stratum_of(column: Column, s: Settings) -> Column:
    """The value itself if it is one of the named strata, else 'other' (NULL too)."""
    return F.when(column.isin(*s.strata), column).otherwise(F.lit("other"))


def clean_labels(labels: DataFrame) -> DataFrame:
    """One row per labelled document: good if every label row calls it of quality and none toxic; NULL labels are left out."""
    return labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(
        ((F.min("quality") == 1) & (F.coalesce(F.max("toxic"), F.lit(0)) == 0)).alias("_good"), (F.coalesce(F.max("toxic"), F.lit(0)) == 1).alias("_toxic"))


def _in_fit(doc_id: str) -> Column:
    return F.pmod(F.xxhash64(F.col(doc_id), F.lit("fit")), F.lit(5)) == 0


def fit_lexicon(docs: DataFrame, labels: DataFrame, s: Settings) -> list[str]:
    """Words that occur nearly only in toxic documents of the fitting part; at most ``lexicon_words`` of them."""
    part = clean_labels(labels).where(_in_fit("_id")).orderBy(F.xxhash64("_id"), "_id").limit(s.fit_docs)
    text = F.regexp_extract_all(F.lower(F.col("text")), F.lit(r"(\p{L}{3,})"), F.lit(1))
    seen = docs.select("doc_id", "text").join(F.broadcast(part), F.col("doc_id") == F.col("_id")).select("_toxic", F.explode(F.array_distinct(text)).alias("w"))
    tox = F.count_if("_toxic")
    best = seen.groupBy("w").agg(tox.alias("t"), F.count("*").alias("n")).where((F.col("t") >= s.lexicon_support) & (F.col("t") >= 0.9 * F.col("n")))
    return [r["w"] for r in best.orderBy(F.desc("t"), "w").limit(s.lexicon_words).collect()]


def _log_factorial(x: Column) -> Column:
    z = F.greatest(x, F.lit(1)).cast("double")
    series = z * F.log(z) - z + 0.5 * F.log(2 * math.pi * z) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)
    return F.when(x <= 20, F.log(F.factorial(F.least(x, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k), summed downwards from k; 1 where k is not below the mean.

    Terms further than 40 standard deviations below are left out: they are below 1e-300 of the sum.
    """
    first = F.exp(_log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * math.log(p) + (n - k) * math.log1p(-p))
    far = F.greatest(F.lit(0).cast("long"), k - F.ceil(40 * F.sqrt(n * p)).cast("long") - 100)
    down = F.when(k > far, F.sequence(k, far + 1, F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    total = F.aggregate(
        down, F.struct(first.alias("t"), first.alias("s")),
        lambda a, j: let(a["t"] * j * (1 - p) / ((n - j + 1) * p), lambda t: F.struct(t.alias("t"), (a["s"] + t).alias("s"))), lambda a: a["s"],
    )
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), total))


def certify(levels: DataFrame, s: Settings) -> DataFrame:
    """Cutoff per (stratum, signal) from rows (stratum, signal, level, good, bad); signals without a proven useful one are absent."""
    m = (len(s.strata) + 1) * len(SIGNALS)
    key = W.partitionBy("stratum", "signal")
    down = key.orderBy(F.desc("level"))
    t = levels.groupBy("stratum", "signal", "level").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    grid = t.select("stratum", "signal").distinct().withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS))))
    t = grid.join(t, ["stratum", "signal", "level"], "left").fillna(0, ["good", "bad"])
    t = t.select("stratum", "signal", "level", F.sum("good").over(key).alias("n"), F.sum("good").over(down).alias("k"), F.sum("bad").over(down).alias("caught"))
    t = t.where(F.col("level") > 0).withColumn("ok", binomial_tail(F.col("n"), F.col("k"), s.alpha / len(SIGNALS)) <= s.delta / m)
    t = t.withColumn("proven", F.min(F.col("ok").cast("int")).over(down)).where("proven = 1")
    t = t.withColumn("gain", F.col("caught") - s.penalty * F.col("k")).where("gain > 0")
    best = t.groupBy("stratum", "signal").agg(F.max(F.struct("gain", "level", "n", "k", "caught")).alias("b"))
    return best.select("stratum", "signal", F.col("b.level").alias("cutoff"), "b.n", "b.k", "b.caught")


def signal_table(docs: DataFrame, labels: DataFrame, s: Settings, stratum: str) -> DataFrame:
    """One stored row per document: doc_id, text hash, stratum, counts, base_failed and levels. Texts are read once for it."""
    lexicon = fit_lexicon(docs, labels, s)
    df, name = with_signals(docs.select("doc_id", "text", stratum_of(F.col(stratum), s).alias("stratum")), lexicon)
    return stored(df.select("doc_id", text_hash(F.col("text")).alias("text_hash"), "stratum", base_failed(name).alias("base_failed"), *(F.col(name[c]).alias(c) for c in (*COUNTS, *SIGNALS))), "signals")


def fit_cutoffs(signals: DataFrame, labels: DataFrame, s: Settings) -> list[tuple[str, str, int]]:
    """(stratum, signal, cutoff); bounded by the settings, so they come to the driver."""
    hold = clean_labels(labels).where(~_in_fit("_id"))
    rows = signals.where("not base_failed").select("doc_id", "stratum", *SIGNALS).join(hold, F.col("doc_id") == F.col("_id"))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("signal"), F.col(c).alias("level")) for c in SIGNALS)))
    rows = rows.select("stratum", each.alias("x"), F.col("_good").cast("long").alias("good"), (~F.col("_good")).cast("long").alias("bad")).select("stratum", "x.*", "good", "bad")
    return sorted((r["stratum"], r["signal"], r["cutoff"]) for r in certify(rows, s).select("stratum", "signal", "cutoff").collect())


def judge(signals: DataFrame, cutoffs: list[tuple[str, str, int]]) -> DataFrame:
    hits = [F.when((F.col("stratum") == g) & (F.col(c) >= cut), F.lit(c)) for g, c, cut in cutoffs]
    why = F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*hits)))), ",") if hits else F.lit("")
    return signals.withColumn("rejected_by", why).withColumn("kept", ~F.col("base_failed") & (F.col("rejected_by") == ""))


def judged(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), stratum: str = "lang") -> DataFrame:
    """One row per row of ``documents``: doc_id, text_hash, the five counts, base_failed, kept, rejected_by.

    NULL text counts as empty (base_failed). Repeated rows are judged alike; extra columns do not matter. Empty tables
    give no rows; without labels only the base rule rejects. NULL or unknown strata share one stratum.
    """
    signals = signal_table(docs, labels, s, stratum)
    return judge(signals, fit_cutoffs(signals, labels, s)).select("doc_id", "text_hash", *COUNTS, "base_failed", "kept", "rejected_by")


def keep(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), stratum: str = "lang") -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns; rejected ones are joined away by id and text."""
    h, of, bad_text = (fresh(docs.columns, x) for x in ("text_hash", "bad_id", "bad_text"))
    bad = judged(docs, labels, s, stratum).where("not kept").select(F.col("doc_id").alias(of), F.col("text_hash").alias(bad_text)).distinct()
    out = docs.withColumn(h, text_hash(F.col("text")))
    return out.join(bad, F.col("doc_id").eqNullSafe(F.col(of)) & (F.col(h) == F.col(bad_text)), "left_anti").select(*docs.columns)
