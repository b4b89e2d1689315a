"""URL filter: fixed rules first, gradient-boosted trees on lexical features for the rest.

The trees are Spark ML's, trained on the URLs that a rule decides. Features: length, depth, digit ratio, entropy, parameter
counts and suffix statistics (smoothed share of blocked URLs among the labelled ones of the same host suffix).
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardspan.llm.common import fresh, let, stored

#: Fixed values: (rule, verdict); a rule is host/path, the host with all its subdomains, the path as a prefix.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Suffixes of one kind up to which their shares are broadcast; beyond, they are joined by a shuffle.
_BROADCAST_ROWS = 200_000
FEATURES = ("f_length", "f_host_length", "f_depth", "f_labels", "f_digits", "f_entropy", "f_params", "f_query", "f_hyphens", "f_longest", "f_top", "f_site", "f_first", "f_section")


@dataclass(frozen=True)
class Settings:
    """train_rows: labelled URLs at most to which the trees are fitted (those with the smallest hashes). prior: labelled
    URLs' worth of weight of the mean share in a suffix statistic; suffixes of no labelled URL count as the mean."""

    train_rows: int = 20_000
    trees: int = 12
    depth: int = 3
    prior: float = 20.0
    seed: int = 7


def host_of(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end, A-Z in lower case; empty for NULL or without '://'."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, or NULL."""

    def fits(rule: str) -> Column:
        h, _, p = rule.partition("/")
        return ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit("/" + p))

    ordered = sorted((r for r, _ in rules), key=lambda r: (-len(r), r))
    return functools.reduce(lambda acc, r: acc.when(fits(r), r), ordered[1:], F.when(fits(ordered[0]), ordered[0]))


def entropy(text: Column) -> Column:
    """Bits per character."""

    def bits(chars: Column) -> Column:
        n = F.size(chars).cast("double")
        # counts of equal neighbours in the sorted characters: one pass, whatever the alphabet
        runs = F.aggregate(
            F.sort_array(chars), F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0.0).alias("sum")),
            lambda a, c: F.when(a["last"] == c, F.struct(c.alias("last"), (a["run"] + 1).alias("run"), a["sum"].alias("sum"))).otherwise(
                F.struct(c.alias("last"), F.lit(1).alias("run"), (a["sum"] + F.when(a["run"] > 0, a["run"] * F.log2(a["run"].cast("double"))).otherwise(0.0)).alias("sum"))),
            lambda a: a["sum"] + F.when(a["run"] > 0, a["run"] * F.log2(a["run"].cast("double"))).otherwise(0.0),
        )
        return F.log2(n) - runs / n

    return let(F.split(text, ""), lambda c: F.when(F.size(c) > 1, bits(c)).otherwise(0.0))


def suffixes(host: Column, path: Column) -> dict[str, Column]:
    """Last label, last two labels and first label of the host, and the first part of the path."""
    section = F.get(F.split(path, "/"), F.lit(1))
    return {"top": F.substring_index(host, ".", -1), "site": F.substring_index(host, ".", -2), "first": F.substring_index(host, ".", 1), "section": F.coalesce(section, F.lit(""))}


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    u = F.coalesce(url, F.lit(""))
    count = lambda x, chars: (F.length(x) - F.length(F.translate(x, chars, ""))).cast("double")
    query = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    return {
        "f_length": F.length(u).cast("double"), "f_host_length": F.length(host).cast("double"),
        "f_depth": F.size(F.array_remove(F.split(path, "/"), "")).cast("double"), "f_labels": count(host, "."),
        "f_digits": count(u, "0123456789") / F.greatest(F.length(u), F.lit(1)), "f_entropy": entropy(u),
        "f_params": F.size(F.array_remove(F.split(query, "[&;]"), "")).cast("double"), "f_query": F.length(query).cast("double"),
        "f_hyphens": count(host, "-"), "f_longest": F.array_max(F.transform(F.split(path, "/"), lambda s: F.length(s))).cast("double"),
    }


def verdicts(pages: DataFrame, s: Settings = Settings(), rules=RULES) -> DataFrame:
    """``pages`` with host, path, rule, verdict and score (probability of block; NULL where a rule decides) added.

    NULL urls and urls without '://' have empty host and path, no rule, and the trees' verdict. Repeated rows are alike;
    columns of the input with these names are replaced; an empty table gives an empty result. Where the labelled URLs do
    not hold both verdicts nothing can be learnt and the rest gets the only verdict there is, or 'allow'.
    """
    verdict = dict(rules)
    added = ("host", "path", "rule", "verdict", "score")
    base = pages.drop(*added).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    base = base.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    decided = F.lit(None).cast("string")
    for r, v in verdict.items():
        decided = F.when(F.col("rule") == r, F.lit(v)).otherwise(decided)
    own = [c for c in pages.columns if c.lower() not in added]
    label = (decided == "block").cast("double")
    y = fresh(own, "label")
    known = base.where("rule is not null").select("url", "host", "path", label.alias(y))
    # suffix statistics of all labelled URLs: every suffix keeps its own
    parts = known.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), c.alias("suffix")) for k, c in suffixes(F.col("host"), F.col("path")).items()))).alias("p"), y)
    stats = stored(parts.groupBy("p.kind", "p.suffix").agg(F.sum(y).alias("blocked"), F.count("*").alias("n")), "suffixes")
    kinds = {r["kind"]: r for r in stats.groupBy("kind").agg(F.count("*").alias("suffixes"), F.sum("n").alias("n"), F.sum("blocked").alias("blocked")).collect()}
    n, blocked = (kinds["top"]["n"], kinds["top"]["blocked"]) if kinds else (0, 0.0)
    if not n or blocked in (0, n):
        only = "block" if n and blocked == n else "allow"
        return base.select(*own, "host", "path", "rule", F.coalesce(decided, F.lit(only)).alias("verdict"), F.lit(None).cast("double").alias("score"))
    mean = blocked / n
    share = (F.col("blocked") + s.prior * mean) / (F.col("n") + s.prior)

    def featured(df: DataFrame) -> DataFrame:
        feats = lexical(F.col("url"), F.col("host"), F.col("path"))
        keys = suffixes(F.col("host"), F.col("path"))
        for k, c in keys.items():
            table = stats.where(F.col("kind") == k).select(F.col("suffix").alias(f"k_{k}"), share.alias(f"s_{k}"))
            df = df.join(F.broadcast(table) if kinds[k]["suffixes"] <= _BROADCAST_ROWS else table, c == F.col(f"k_{k}"), "left")
        feats |= {f"f_{k}": F.coalesce(F.col(f"s_{k}"), F.lit(mean)) for k in keys}
        return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(df.withColumns(feats))

    train = known.orderBy(F.xxhash64("url"), "url").limit(s.train_rows)
    model = GBTClassifier(labelCol=y, featuresCol="features", maxIter=s.trees, maxDepth=s.depth, maxBins=64, seed=s.seed, cacheNodeIds=False).fit(featured(train).select(y, "features"))
    model.setRawPredictionCol("").setPredictionCol("")
    scored = model.transform(featured(base)).withColumn("score", F.when(F.col("rule").isNull(), F.get(vector_to_array("probability"), F.lit(1))))
    return scored.select(*own, "host", "path", "rule", F.coalesce(decided, F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")
