"""License scan as an exact set-similarity join of text blocks with license templates.

A block is a line or, for notices that are wrapped, what stands around a line break: the n words before it and the n words
after it, where n is the number of words of the longest template. Any n words in a row stand in a line or in such a block.
A block matches a template if it contains at least ``percent`` of the template's distinct words. Words are ordered by their
frequency in the whole corpus, rarest first. Prefix filter: of a template with n words of which r are required, a matching
block has one of the n - r + 1 rarest. Length filter: a block needs r of the templates' words in all. Positional filter: after
a common word, enough words must be left in both to reach r. What passes is verified on the full word sets.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardspan.llm.common import let, prefix_sums, stored, text_hash

#: Separators of words, after lower-casing.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases whose words must stand together, and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Usual notices of public licenses, and their labels.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("all-rights-reserved", "All rights reserved"),
)


@dataclass(frozen=True)
class Settings:
    """percent: share of a template's words that a block must contain."""

    percent: int = 80
    templates: tuple[tuple[str, str], ...] = TEMPLATES
    phrases: tuple[tuple[str, str], ...] = PHRASES


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), GAP), "")


def token_set(template: str) -> list[str]:
    return sorted(set(re.sub(GAP, " ", template.lower()).split()))


def required(size: int, percent: int) -> int:
    return -(-size * percent // 100)


def global_order(docs: DataFrame, vocabulary: list[str]) -> list[str]:
    """The templates' words, rarest in the corpus first. The result is bounded by the templates."""
    seen = docs.select(F.explode(words_of(F.col("text"))).alias("w")).where(F.col("w").isin(vocabulary)).groupBy("w").count().collect()
    times = {r["w"]: r["count"] for r in seen}
    return sorted(vocabulary, key=lambda w: (times.get(w, 0), w))


def phrase_places(words: Column, phrases) -> Column:
    """array<struct<label, n, first, last>>: places of each phrase that occurs, counted in words from 0."""
    # every word has a blank on either side, so neighbouring matches share none
    joined = F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" "))

    def one(s: Column, phrase: str, label: str) -> Column:
        p = " " + phrase.replace(" ", "  ") + " "
        before = lambda at: _div2(at - 1 - F.length(F.replace(F.substring(s, F.lit(1), at - 1), F.lit(" "), F.lit(""))))
        first = F.instr(s, p)
        last = F.length(s) - F.instr(F.reverse(s), p[::-1]) - len(p) + 2
        n = (F.length(s) - F.length(F.replace(s, F.lit(p), F.lit("")))) / len(p)
        return F.when(first > 0, F.struct(F.lit(label).alias("label"), n.cast("long").alias("n"), before(first).alias("first"), before(last).alias("last")))

    return F.transform(F.array(joined), lambda s: F.array_compact(F.array(*(one(s, p, label) for p, label in phrases))))[0]


def _div2(x: Column) -> Column:
    return F.shiftright(x, 1).cast("long")


def document_rows(docs: DataFrame, order: list[str], s: Settings) -> DataFrame:
    """Stored (doc_id, th, n_words, places, blocks): phrases found, and the template words of the blocks of texts that hold
    enough words of some template. Blocks of line i and of the break behind it have the numbers 2 i and 2 i + 1."""
    needs = [(token_set(t), required(len(token_set(t)), s.percent)) for _, t in s.templates]
    least = min((need for _, need in needs), default=1)
    reach = max((len(re.sub(GAP, " ", t.lower()).split()) for _, t in s.templates), default=1)
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select("doc_id", text_hash(F.col("text")).alias("th"), text.alias("t"), words_of(text).alias("w"))
    possible = F.lit(False)
    for phrase, _ in s.phrases:
        possible = possible | F.forall(F.array(*map(F.lit, phrase.split())), _in(F.col("w")))
    literal = lambda ws: F.array(*map(F.lit, ws)) if ws else F.array().cast("array<string>")
    enough = let(F.array_intersect(literal(order), F.col("w")), lambda x: functools.reduce(lambda a, b: a | b, (F.size(F.array_intersect(literal(ws), x)) >= need for ws, need in needs), F.lit(False)))
    block = lambda i, ws: F.struct(i.cast("int").alias("block"), F.array_intersect(literal(order), ws).alias("x"))
    lines = F.transform(F.split("t", "\n"), lambda x: words_of(x))
    ends = let(lines, lambda ls: prefix_sums(F.transform(ls, lambda l: F.size(l).cast("long"))))
    first = lambda end: F.greatest(end - reach, F.lit(0).cast("long"))

    def around(end: Column) -> Column:
        return F.slice(F.col("w"), (first(end) + 1).cast("int"), (end + reach - first(end)).cast("int"))

    # a line without words has its break where the one before it is
    breaks = let(ends, lambda es: F.transform(F.filter(F.sequence(F.lit(0), F.size(es) - 3), lambda i: F.get(es, i + 1) > F.get(es, i)), lambda i: block(2 * i + 1, around(F.get(es, i + 1)))))
    many = F.size(F.split("t", "\n")) > 1
    blocks = F.concat(F.transform(lines, lambda ws, i: block(2 * i, ws)), F.when(many, breaks).otherwise(F.array().cast("array<struct<block:int,x:array<string>>>")))
    blocks = F.filter(blocks, lambda b: F.size(b["x"]) >= least)
    none = "array<struct<block:int,x:array<string>>>"
    return stored(df.select(
        "doc_id", "th", F.size("w").cast("long").alias("n_words"),
        F.when(possible, phrase_places(F.col("w"), s.phrases)).otherwise(F.array().cast("array<struct<label:string,n:bigint,first:bigint,last:bigint>>")).alias("places"),
        F.when(enough, blocks).otherwise(F.array().cast(none)).alias("blocks"),
    ), "license-rows")


def _in(words: Column):
    return lambda p: F.array_contains(words, p)


def matches(rows: DataFrame, order: list[str], s: Settings) -> DataFrame:
    """(doc_id, th, block, found): per block the templates (number, containment) that it matches, subsets of others aside."""
    spark = rows.sparkSession
    rank = {w: i for i, w in enumerate(order)}
    sets = [sorted(token_set(t), key=rank.__getitem__) for _, t in s.templates]
    prefix = [(w, k, q, len(ws), required(len(ws), s.percent), ws) for k, ws in enumerate(sets) for q, w in enumerate(ws[: len(ws) - required(len(ws), s.percent) + 1])]
    table = F.broadcast(spark.createDataFrame(prefix, "token string, k int, q int, size int, need int, words array<string>"))
    blocks = rows.select("doc_id", "th", F.explode("blocks").alias("b")).select("doc_id", "th", "b.block", "b.x")
    hits = blocks.select("*", F.posexplode("x").alias("p", "token")).join(table, "token")
    hits = hits.where((F.size("x") >= F.col("need")) & (1 + F.least(F.size("x") - F.col("p") - 1, F.col("size") - F.col("q") - 1) >= F.col("need")))
    both = F.size(F.array_intersect("words", "x"))
    hits = hits.where(both >= F.col("need")).select("doc_id", "th", "block", F.struct("k", (both / F.col("size")).alias("share")).alias("m"))
    found = hits.groupBy("doc_id", "th", "block").agg(F.sort_array(F.collect_set("m")).alias("found"))
    covers = [(a, b) for a, x in enumerate(sets) for b, y in enumerate(sets) if set(x) < set(y)]
    for a, b in covers:  # a template inside a longer one that matches as well says nothing of its own
        found = found.withColumn("found", F.when(F.exists("found", _is(b)), F.filter("found", _not(a))).otherwise(F.col("found")))
    return found


def _is(k: int):
    return lambda m: m["k"] == k


def _not(k: int):
    return lambda m: m["k"] != k


def scanned(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks.

    score: the greatest containment of a matched template, 1 where a phrase stands, else 0. blocks: (block, label, containment);
    line i has the number 2 i there, the break behind it 2 i + 1. NULL and empty texts have no words and no labels. Repeated rows are alike; extra columns do not matter; an empty table
    gives an empty result.
    """
    order = global_order(docs, sorted({w for _, t in s.templates for w in token_set(t)}))
    rows = document_rows(docs, order, s)
    names = F.array(*(F.lit(label) for label, _ in s.templates))
    named = F.transform("found", lambda m: F.struct(F.col("block"), F.get(names, m["k"]).alias("label"), m["share"].alias("share")))
    per = matches(rows, order, s).select("doc_id", "th", named.alias("m")).groupBy(F.col("doc_id").alias("_m_id"), F.col("th").alias("_m_th")).agg(F.sort_array(F.flatten(F.collect_list("m"))).alias("blocks"))
    out = rows.drop("blocks").join(per, F.col("doc_id").eqNullSafe(F.col("_m_id")) & (F.col("th") == F.col("_m_th")), "left")
    base = F.transform("places", lambda p: p["label"])
    own = F.coalesce(F.transform("blocks", lambda b: b["label"]), F.array().cast("array<string>"))
    listed = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    n_base = F.aggregate("places", F.lit(0).cast("long"), lambda a, p: a + p["n"])
    share = F.coalesce(F.array_max(F.transform("blocks", lambda b: b["share"])), F.lit(0.0))
    return out.select(
        "doc_id", "n_words", n_base.alias("n_base"), F.array_min(F.transform("places", lambda p: p["first"])).alias("first_word"), F.array_max(F.transform("places", lambda p: p["last"])).alias("last_word"),
        listed(base).alias("base_labels"), listed(F.concat(base, own)).alias("labels"), F.greatest(share, F.when(n_base > 0, 1.0).otherwise(0.0)).alias("score"), "blocks",
    )
