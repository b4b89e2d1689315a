"""Personal data by bootstrapped contextual extraction.

Seeds are identifiers found by fixed rules (e-mail, IP address, payment card, phone). Every seed, and every other token that
holds digits, is an occurrence: an instance (its value) in a pattern (the two words before it, and its shape). Patterns and
instances form a graph that Spark scores in rounds: a pattern scores the known share of its instances, an instance the
best score among its patterns. Patterns with enough distinct known instances and a high final score are trusted, and their
other occurrences are reported as further identifiers.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardspan.llm.common import spans_if, stored, text_hash
from wardspan.llm.secret_scan import written

#: The base rules. Possessive quantifiers and the run-start conditions change no match; they keep matching linear.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
CONTEXT = 80


@dataclass(frozen=True)
class Settings:
    """rounds: rounds of scoring. support: distinct known instances a trusted pattern needs. score: share of a trusted
    pattern's instances that must be known. digits: digits a token needs to be an occurrence."""

    rounds: int = 3
    support: int = 3
    score: float = 0.8
    digits: int = 3


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a right check digit."""
    d = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.get(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), c.cast("int"))))
    return F.aggregate(d, F.lit(0), lambda a, x: a + x) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """Valid matches per base kind. A match that fails its test is dropped, the search goes on behind it."""
    small = lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3
    part = lambda p: small(p) & (F.coalesce(F.when(small(p), F.substring(F.concat(F.lit("000"), F.regexp_replace(p, "^0+", "")), -3, 3)).try_cast("int"), F.lit(999)) <= 255)
    return {
        "email": spans_if(F.contains(text, F.lit("@")), text, EMAIL),
        "ip": F.filter(spans_if(text.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"), text, IP), lambda m: F.forall(F.split(m["value"], r"\."), part)),
        "card": F.filter(
            spans_if(text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"), text, CARD),
            lambda m: F.when(F.length(_digits(m["value"])).between(14, 19), luhn(_digits(m["value"]))).otherwise(False)),
        "phone": F.filter(spans_if(F.contains(text, F.lit("+")), text, PHONE), lambda m: F.length(_digits(m["value"])).between(10, 15)),
    }


def marked(docs: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, th, base, more): base spans (start, rank, kind, end, value) and other tokens with digits, with their contexts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = base_spans(text)

    def tag(rank: int, kind: str):
        return lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), m["end"].alias("end"), m["value"].alias("value"))

    base = F.sort_array(F.concat(*(F.transform(found[k], tag(i, k)) for i, k in enumerate(KINDS))))
    token = r"(?:(?<![\p{L}\p{N}_@+.-])|\G)[\p{L}\p{N}_@+-](?:[\p{L}\p{N}_@+.-]*+(?<=[\p{L}\p{N}_]))?"
    tokens = F.filter(spans_if(text.rlike("[0-9]"), text, token), lambda m: F.length(_digits(m["value"])) >= s.digits)
    df = docs.select("doc_id", text_hash(F.col("text")).alias("th"), text.alias("t"), base.alias("base"), tokens.alias("tokens"))
    more = F.filter("tokens", lambda m: ~F.exists("base", lambda b: (m["start"] < b["end"]) & (b["start"] < m["end"])))
    df = df.withColumn("more", F.transform(more, lambda m: F.struct(m["start"].alias("start"), F.lit(len(KINDS)).alias("rank"), F.lit("context").alias("kind"), m["end"].alias("end"), m["value"].alias("value"))))

    def before(m: Column) -> Column:
        cut = F.greatest(F.lit(0).cast("long"), m["start"] - CONTEXT)
        left = F.lower(F.substring(F.col("t"), cut + 1, m["start"] - cut))
        return F.regexp_extract(left, r"(?:^|[\x20\t-\r])((?:[^\x20\t-\r]{1,40}[\x20\t-\r]+)?[^\x20\t-\r]{1,40})[\x20\t-\r]*$", 1)

    seen = F.concat("base", "more")
    shape = lambda v: F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[0-9]+", "9"), r"\p{Lu}+", "A"), r"\p{Ll}+", "a")
    seen = F.transform(seen, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lower(m["value"]).alias("instance"), (m["rank"] < len(KINDS)).alias("seed"), F.concat_ws(" ", before(m), F.lit("~"), shape(m["value"])).alias("pattern")))
    return df.select("doc_id", "th", "base", seen.alias("seen"))


def trusted_patterns(seen: DataFrame, s: Settings) -> DataFrame:
    """(pattern) from occurrences (pattern, instance, seed), scored on the pattern-instance graph."""
    edges = stored(seen.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "pii-edges")
    known = edges.groupBy("instance").agg(F.max("seed").cast("double").alias("known"))
    scores = None
    for _ in range(s.rounds):
        scores = edges.join(known, "instance").groupBy("pattern").agg(F.avg("known").alias("score"), F.sum(F.col("seed").cast("long")).alias("support"))
        scores = stored(scores.where(F.col("support") >= s.support), "pii-patterns")
        rise = edges.join(scores.select("pattern", "score"), "pattern").groupBy("instance").agg(F.max("score").alias("rise"))
        known = edges.groupBy("instance").agg(F.max("seed").cast("double").alias("was")).join(rise, "instance", "left").select("instance", F.greatest("was", F.coalesce("rise", F.lit(0.0))).alias("known"))
    return scores.where(F.col("score") >= s.score).select("pattern")


def discovered(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row per row of ``docs``: doc_id, base (array of start, rank, kind, end, value), found (likewise, kind 'context').

    NULL and empty texts have none. Repeated rows are alike. Further identifiers overlap no base span; base spans of
    different kinds may overlap each other. Empty tables give empty results; extra columns do not matter.
    """
    rows = stored(marked(docs, s), "pii")
    seen = rows.select("doc_id", "th", F.explode("seen").alias("o")).select("doc_id", "th", "o.*")
    good = trusted_patterns(seen.select("pattern", "instance", "seed"), s)
    new = seen.where("not seed").join(good, "pattern", "left_semi")
    span = F.struct("start", F.lit(len(KINDS)).alias("rank"), F.lit("context").alias("kind"), "end", F.col("instance").alias("value"))
    new = new.groupBy(F.col("doc_id").alias("_n_doc"), F.col("th").alias("_n_th")).agg(F.collect_set(span).alias("_n_found"))
    out = rows.join(new, F.col("doc_id").eqNullSafe(F.col("_n_doc")) & (F.col("th") == F.col("_n_th")), "left")
    none = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint,value:string>>")
    return out.select("doc_id", "base", F.coalesce("_n_found", none).alias("found"))


def digest(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    df = discovered(docs, s)
    counts = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return df.select("doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.sort_array(F.concat("base", "found"))).alias("spans"))


def _is(kind: str):
    return lambda m: m["kind"] == kind
