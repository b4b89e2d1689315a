"""Secret scan over a trigram inverted index.

Each rule's regex gives a Boolean query of trigrams that any match must contain: an AND of ORs of ANDs. The index holds, for
every trigram that some rule asks for, a posting per document that contains it. Intersecting the postings per document
leaves the candidates of each rule; only those texts are searched with the regex. A rule without mandatory trigrams
(``hex``) is searched in every text.
"""

from __future__ import annotations

import functools
import operator
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardspan.llm.common import fresh, spans_if, text_hash

try:
    from re import _constants as C
    from re import _parser as P
except ImportError:  # before Python 3.11
    import sre_constants as C
    import sre_parse as P


@dataclass(frozen=True)
class Rule:
    """kind: name in the result. regex: Java regex of a whole match. secret: group that must hold ``at_least`` characters
    (0: the match). base: whether it belongs to the fixed base set, whose matches are always reported. probe: regex that every
    reported match contains, asked first by rules that the index cannot help."""

    kind: str
    regex: str
    at_least: int = 0
    secret: int = 0
    base: bool = False
    probe: str = ""


#: The base rules, and well-known public token formats.
RULES = (
    Rule("assign", r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]++)""", 6, 1, True),
    Rule("access", r"AKIA[A-Z0-9]++", 20, 0, True),
    Rule("hex", r"[0-9a-f]++", 24, 0, True, r"[0-9a-f]{24}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}+"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"),
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}+"),
    Rule("stripe", r"[sr]k_live_[0-9A-Za-z]{16,}+"),
)
#: Longest set of literal strings that is followed through a regex.
_WIDTH = 64


def mandatory(regex: str) -> list[set[str]]:
    """Sets of lower-case strings; any match contains one string of every set."""
    found: list[set[str]] = []

    def close(open_: set[str]) -> set[str]:
        if all(len(x) >= 3 for x in open_):
            found.append(open_)
        return {""}

    def literal(item) -> set[str] | None:
        """The strings an element can stand for, if they are few."""
        op, arg = item
        if op is C.LITERAL:
            return {chr(arg).lower()}
        if op is C.IN:
            if all(o is C.LITERAL for o, _ in arg):
                return {chr(a).lower() for _, a in arg}
            return None
        if op is C.SUBPATTERN:
            return whole(arg[3])
        if op is C.BRANCH:
            parts = [whole(x) for x in arg[1]]
            return set().union(*parts) if all(p is not None for p in parts) else None
        if op in (C.MAX_REPEAT, C.MIN_REPEAT, getattr(C, "POSSESSIVE_REPEAT", None)):
            low, high, sub = arg
            one = whole(sub)
            if one is not None and (low, high) == (0, 1):
                return one | {""}
            if one is not None and len(one) == 1 and low == high and low <= 64:
                return {next(iter(one)) * low}
        return None

    def whole(items) -> set[str] | None:
        strings = {""}
        for item in items:
            one = literal(item)
            if one is None or len(strings) * len(one) > _WIDTH:
                return None
            strings = {a + b for a in strings for b in one}
        return strings

    def walk(items) -> None:
        strings = {""}
        for item in items:
            one = literal(item)
            if one is not None and len(strings) * len(one) <= _WIDTH:
                strings = {a + b for a in strings for b in one}
                continue
            strings = close(strings)
            if item[0] is C.SUBPATTERN:
                walk(item[1][3])
            elif item[0] in (C.MAX_REPEAT, C.MIN_REPEAT, getattr(C, "POSSESSIVE_REPEAT", None)) and item[1][0] >= 1:
                walk(item[1][2])
        close(strings)

    walk(P.parse(regex))
    return found


def trigrams(text: str) -> list[str]:
    return [text[i : i + 3] for i in range(len(text) - 2)]


def trigram_query(regex: str) -> list[list[list[str]]]:
    """AND of ORs of ANDs of trigrams; empty if none is mandatory."""
    return [sorted(sorted(set(trigrams(x))) for x in strings) for strings in mandatory(regex)]


def postings(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(doc, th, t): a posting per document and trigram of the vocabulary (its number); letters in lower case."""
    low = F.lower(F.col("text"))
    held = F.array_compact(F.array(*(F.when(F.contains(low, F.lit(t)), F.lit(i)) for i, t in enumerate(vocabulary))))
    return docs.where(F.col("text").isNotNull()).select(F.col("doc_id").alias("doc"), text_hash(F.col("text")).alias("th"), F.explode(held).alias("t"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame | None:
    """(doc, th, rules): kinds whose trigram query the document's postings satisfy."""
    asked = {r.kind: q for r in rules if (q := trigram_query(r.regex))}
    if not asked:
        return None
    vocabulary = sorted({t for q in asked.values() for clause in q for grams in clause for t in grams})
    number = {t: i for i, t in enumerate(vocabulary)}
    held = lambda grams: functools.reduce(operator.and_, (F.array_contains("held", number[t]) for t in grams))
    clause = lambda c: functools.reduce(operator.or_, map(held, c))
    fits = {k: functools.reduce(operator.and_, map(clause, q)) for k, q in asked.items()}
    lists = postings(docs, vocabulary).groupBy("doc", "th").agg(F.collect_set("t").alias("held"))
    kinds = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in fits.items())))
    return lists.select("doc", "th", kinds.alias("rules")).where(F.size("rules") > 0)


def _found(text: Column, rule: Rule, where: Column) -> Column:
    every = spans_if(where, text, rule.regex)
    if not rule.at_least:
        return every
    return F.filter(every, lambda m: F.length(F.regexp_extract(m["value"], rule.regex, rule.secret) if rule.secret else m["value"]) >= rule.at_least)


def listed(found: list[tuple[str, Column]]) -> Column:
    """All spans as array<struct<start, rank, kind, end>>, by start, then kind as listed."""

    def tag(rank: int, kind: str):
        return lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), m["end"].alias("end"))

    return F.sort_array(F.concat(*(F.transform(c, tag(i, k)) for i, (k, c) in enumerate(found))))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", m["kind"], m["start"], m["end"])), ",")


def scanned(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, str]:
    """``docs`` with one added column (its name is returned): array<struct<kind, spans>>, all matches of each rule.

    NULL and empty texts have none. Repeated rows get the same spans; extra columns pass through; an empty table gives an
    empty result. Overlapping matches of different rules are all kept.
    """
    found = candidates(docs, rules)
    h, out, doc, th, hit = (fresh(docs.columns, x) for x in ("text_hash", "found", "hit_doc", "hit_hash", "hit_rules"))
    df = docs.withColumn(h, text_hash(F.col("text")))
    indexed = {r.kind for r in rules if trigram_query(r.regex)}
    if found is not None:
        found = found.select(F.col("doc").alias(doc), F.col("th").alias(th), F.col("rules").alias(hit))
        df = df.join(found, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(h) == F.col(th)), "left")
    else:
        df = df.withColumn(hit, F.array().cast("array<string>"))
    text = F.coalesce(F.col("text"), F.lit(""))
    quick = lambda r: text.rlike(r.probe) if r.probe else F.lit(True)
    each = [_found(text, r, F.coalesce(F.array_contains(hit, r.kind), F.lit(False)) if r.kind in indexed else quick(r)) for r in rules]
    col = F.array(*(F.struct(F.lit(r.kind).alias("kind"), c.alias("spans")) for r, c in zip(rules, each)))
    return df.select(*docs.columns, col.alias(out)), out


def digest(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, count per base kind, base_sha256, spans."""
    df, c = scanned(docs, rules)
    of = lambda i: F.get(F.col(c), i)["spans"]
    base = [(r.kind, of(i)) for i, r in enumerate(rules) if r.base]
    counts = [F.size(x).cast("long").alias(f"n_{k}") for k, x in base]
    df = df.select("doc_id", *counts, listed(base).alias("b"), listed([(r.kind, of(i)) for i, r in enumerate(rules)]).alias("a"))
    return df.select("doc_id", *(f"n_{k}" for k, _ in base), F.sha2(written(F.col("b")), 256).alias("base_sha256"), written(F.col("a")).alias("spans"))
