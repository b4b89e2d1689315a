"""Line deduplication by winnowing over line hashes.

Lines without a word take no part. From each line on, the shortest run of lines that holds ``gram_words`` words is a gram.
Among the grams that begin within the next ``window_words - gram_words`` words the smallest hash is kept as a fingerprint, so
every run of at least ``window_words`` words that two places share has a fingerprint in common.

Long runs: in the documents with a fingerprint that occurs again, every shortest run of lines with ``window_words`` words,
read forward from its first line or backward from its last, is compared with the first place that has the same run
(smallest document, then smallest line), and deleted from all later ones. Any shared run of that many words or more is
covered by such runs from end to end, however long its lines are, and whichever earlier place shares it. Shorter runs: all
occurrences of a fingerprint are compared with its first one; from there the match is extended line by line in both
directions. Work is one comparison per occurrence: no pairs among the occurrences.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wardspan.llm.common import SPACE, fresh, stored, text_hash

KEY = ("doc", "th")


@dataclass(frozen=True)
class Settings:
    gram_words: int = 25
    window_words: int = 50


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc, th, line, h, n): the lines with a word; repeated rows once. ``th`` tells rows with equal ids apart."""
    rows = docs.select(F.col("doc_id").alias("doc"), text_hash(F.col("text")).alias("th"), F.posexplode(F.split(F.col("text"), "\n")).alias("line", "s"))
    n = F.size(F.array_remove(F.split("s", SPACE), "")).cast("long")
    return rows.select(*KEY, "line", F.xxhash64("s").alias("h"), n.alias("n")).where("n > 0")


def fingerprints(docs: DataFrame, s: Settings) -> DataFrame:
    """(doc, th, k, g1, g2, near): gram starts kept by winnowing; near: the lines around, by place among the lines with words."""
    key = W.partitionBy(*KEY)
    # a row that is repeated as a whole gives each line several times; one of them is enough
    lines = lines_of(docs).groupBy(*KEY, "line").agg(F.first("h").alias("h"), F.first("n").alias("n"))
    up = key.orderBy("line")
    lines = lines.select("*", F.row_number().over(up).alias("k"), (F.sum("n").over(up) - F.col("n")).alias("b"))
    by_words = key.orderBy("b")
    ahead = lambda words: by_words.rangeBetween(0, words - 1)
    gram = ahead(s.gram_words)
    lines = lines.select(
        "*", F.when(F.sum("n").over(gram) >= s.gram_words, F.collect_list("h").over(gram)).alias("gram"),
        (F.sum("n").over(ahead(s.window_words)) >= s.window_words).alias("full"),
    )
    lines = lines.withColumns({"g1": F.when(F.col("gram").isNotNull(), F.xxhash64("gram")), "g2": F.when(F.col("gram").isNotNull(), F.xxhash64(F.lit(1), F.col("gram")))}).drop("gram")
    reach = s.window_words  # a longer run is a matter of ``long_runs``
    lines = lines.select(
        "*", F.min(F.when(F.col("g1").isNotNull(), F.struct("g1", -F.col("k")))).over(by_words.rangeBetween(0, s.window_words - s.gram_words)).alias("least"),
        F.collect_list(F.struct("k", "line", "h")).over(by_words.rangeBetween(-reach, reach)).alias("near"),
    )
    # a line is a fingerprint if a full window that begins at or before it chose it
    chosen = F.collect_set(F.when(F.col("full"), -F.col("least.col2"))).over(by_words.rangeBetween(s.gram_words - s.window_words, 0))
    return lines.withColumn("chosen", chosen).where(F.array_contains("chosen", F.col("k"))).select(*KEY, "k", "g1", "g2", "near")


def _run(near: Column, other: Column, k: Column, diag: Column, step: int) -> Column:
    """Line numbers from place k on in the given direction, as long as the other document has the same line on the diagonal."""
    there = F.map_from_entries(F.transform(other, lambda e: F.struct(e["k"] + diag, e["h"])))
    ahead = F.filter(near, lambda e: (e["k"] >= k) if step > 0 else (e["k"] < k))
    ahead = F.sort_array(ahead, asc=step > 0)
    empty = F.array().cast("array<int>")
    return F.aggregate(
        ahead, F.struct(F.lit(True).alias("on"), empty.alias("got")),
        lambda a, e: F.when(a["on"] & (F.try_element_at(there, e["k"]) == e["h"]), F.struct(F.lit(True).alias("on"), F.concat(a["got"], F.array(e["line"])).alias("got"))).otherwise(F.struct(F.lit(False).alias("on"), a["got"].alias("got"))),
        lambda a: a["got"],
    )


def long_runs(docs: DataFrame, s: Settings) -> DataFrame:
    """(doc, th, k, g1, g2, got): the shortest runs with ``window_words`` words from each line on and, where they are others, up to each line."""
    key = W.partitionBy(*KEY)
    lines = lines_of(docs).groupBy(*KEY, "line").agg(F.first("h").alias("h"), F.first("n").alias("n"))
    up = key.orderBy("line")
    lines = lines.select("*", F.row_number().over(up).alias("k"), F.sum("n").over(up).alias("e")).withColumn("b", F.col("e") - F.col("n"))
    ahead, back = key.orderBy("b").rangeBetween(0, s.window_words - 1), key.orderBy("e").rangeBetween(1 - s.window_words, 0)
    run = lambda over, full: F.when(full, F.struct(F.collect_list("h").over(over).alias("hs"), F.collect_list("line").over(over).alias("got")))
    lines = lines.select("*", run(ahead, F.sum("n").over(ahead) >= s.window_words).alias("fore"))
    # with fewer words before its last line, a run is that of its first line
    lines = lines.select("*", run(back, F.sum("n").over(back) - F.col("n") >= s.window_words).alias("aft"))
    runs = lines.select(*KEY, "k", F.explode(F.array_compact(F.array("fore", "aft"))).alias("r"))
    return runs.select(*KEY, "k", F.xxhash64("r.hs").alias("g1"), F.xxhash64(F.lit(1), "r.hs").alias("g2"), F.col("r.got").alias("got"))


def first_places(marks: DataFrame) -> DataFrame:
    """(g1, g2, src): the first place of what occurs more than once."""
    return marks.groupBy("g1", "g2").agg(F.min(F.struct("doc", "th", "k")).alias("src"), F.count("*").alias("times")).where("times > 1").drop("times")


def repeated_lines(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc, th, cut): numbers of the lines (from 0) to delete from each document that has later repeats."""
    marks = stored(fingerprints(docs, s), "fingerprints")
    spot = F.struct("doc", "th", "k")
    first = stored(first_places(marks), "first-places")
    again = marks.join(first, ["g1", "g2"]).select(F.col("doc").alias("d0"), F.col("th").alias("t0")).distinct()
    some = docs.select("doc_id", "text").join(again, F.col("doc_id").eqNullSafe(F.col("d0")) & (text_hash(F.col("text")) == F.col("t0")), "left_semi")
    runs = stored(long_runs(some, s), "long-runs")
    late = runs.join(first_places(runs), ["g1", "g2"]).where(~spot.eqNullSafe(F.col("src"))).select(*KEY, "got")
    hits = marks.select("g1", "g2", *KEY, "k").join(first, ["g1", "g2"]).where(~spot.eqNullSafe(F.col("src")))
    hits = hits.select(*KEY, "k", F.col("src.doc").alias("sdoc"), F.col("src.th").alias("sth"), F.col("src.k").alias("sk"))
    here = marks.select(F.col("doc").alias("d0"), F.col("th").alias("t0"), F.col("k").alias("k0"), "near")
    src = marks.select(F.col("doc").alias("d1"), F.col("th").alias("t1"), F.col("k").alias("k1"), F.col("near").alias("snear"))
    hits = hits.join(here, F.col("doc").eqNullSafe(F.col("d0")) & (F.col("th") == F.col("t0")) & (F.col("k") == F.col("k0"))).drop("d0", "t0", "k0")
    hits = hits.join(src, F.col("sdoc").eqNullSafe(F.col("d1")) & (F.col("sth") == F.col("t1")) & (F.col("sk") == F.col("k1")))
    diag = F.col("k") - F.col("sk")
    same = F.col("doc").eqNullSafe(F.col("sdoc")) & (F.col("th") == F.col("sth"))
    # inside one document the run must not reach its own source
    near = F.when(same, F.filter("near", lambda e: e["k"] > F.col("sk"))).otherwise(F.col("near"))
    run = F.concat(*(_run(near, F.col("snear"), F.col("k"), diag, step) for step in (1, -1)))
    cut = hits.select(*KEY, run.alias("got")).unionByName(late).select(*KEY, F.explode("got").alias("line")).groupBy(*KEY).agg(F.sort_array(F.collect_set("line")).alias("cut"))
    return cut


def deduplicated(docs: DataFrame, s: Settings = Settings()) -> tuple[DataFrame, str]:
    """``docs`` with repeated runs deleted from ``text``, and the name of the added column with the deleted line numbers.

    The first occurrence (smallest doc_id, NULL first; then the text's hash, then the line) stays. Rows with equal id and
    text are one document: they are cut alike and are no repeats of each other. NULL and empty texts, and texts with fewer
    words than a window, come out as they went in; lines without a word are never deleted. Empty tables give empty results.
    """
    cut = repeated_lines(docs, s)
    h, c, doc, th, lines = (fresh(docs.columns, x) for x in ("text_hash", "cut", "cut_doc", "cut_hash", "cut_lines"))
    cut = cut.select(F.col("doc").alias(doc), F.col("th").alias(th), F.col("cut").alias(lines))
    df = docs.withColumn(h, text_hash(F.col("text"))).join(cut, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(h) == F.col(th)), "left")
    left = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(lines, i)), "\n")
    text = F.when(F.col(lines).isNull(), F.col("text")).otherwise(left).alias("text")
    return df.select(*(text if x == "text" else F.col(x) for x in docs.columns), F.coalesce(lines, F.array().cast("array<int>")).alias(c)), c
