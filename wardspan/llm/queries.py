"""Queries of the dealt operators, and their DuckDB counterparts where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspan.llm import conversation_repair, jaccard_join, latent_decontamination, lexical_search, license_scan, line_dedup, mixture_packing, page_difference, pii_bootstrap, quality_classifier, quality_rules, secret_scan, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_quality_rules(spark, sf_dir):
    return quality_rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text_hash")


@query
def op9_line_dedup(spark, sf_dir):
    """doc_id, n_lines, n_removed, removed (numbers of the deleted lines), text left."""
    n = F.size(F.split(F.coalesce(F.col("text"), F.lit("")), "\n")).cast("long")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", n.alias("n_lines"))
    df, cut = line_dedup.deduplicated(docs)
    return df.select("doc_id", "n_lines", F.size(cut).cast("long").alias("n_removed"), F.array_join(cut, ",").alias("removed"), "text")


@query
def op8_secret_scan(spark, sf_dir):
    return secret_scan.digest(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op10_pii_bootstrap(spark, sf_dir):
    return pii_bootstrap.digest(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op6_url_filter(spark, sf_dir):
    return url_filter.verdicts(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "score")


def tokenizer_path() -> str:
    """The tokenizer of the packing contract, where the package that carries the vocabularies is installed."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op2_mixture_packing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixture_packing.packed(docs, mixture_packing.Settings(tokenizer_path()))


@query
def op5_jaccard_join(spark, sf_dir):
    return jaccard_join.grouped(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op7_license_scan(spark, sf_dir):
    return license_scan.scanned(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("blocks")


@query
def op4_latent_decontamination(spark, sf_dir):
    """doc_id, item_id, lcs (words), near (word of the document), answer: one row per document and item found in it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return latent_decontamination.contaminated(docs, table(spark, sf_dir, "benchmark")).drop("cosine")


@query
def op3_page_difference(spark, sf_dir):
    return page_difference.extracted(table(spark, sf_dir, "pages"))


@query
def op11_conversation_repair(spark, sf_dir):
    return conversation_repair.summaries(conversation_repair.edits(conversation_repair.damaged(table(spark, sf_dir, "conversations"))))


@query
def op12_quality_classifier(spark, sf_dir):
    return quality_classifier.judged(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


@query
def op13_lexical_search(spark, sf_dir):
    return lexical_search.ranked(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


ORACLES["op13_lexical_search"] = r"""
with terms as (
  select doc_id, row_number() over () as rid, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ws from documents
), lengths as (select rid, doc_id, len(ws)::bigint as n from terms where len(ws) > 0),
total as (select count(*)::bigint as docs, sum(n)::bigint as length from lengths),
asked as (
  select item_id, w, count(*)::bigint as times from (
    select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as w from benchmark) group by all
), tf as (
  select rid, w, count(*)::bigint as tf from (select rid, unnest(ws) as w from terms) where w in (select w from asked) group by all
), weights as (
  select w, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::bigint as weight from tf, total group by w, docs
), scores as (
  select item_id, rid, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // length))))::bigint as score
  from asked join weights using (w) join tf using (w) join lengths using (rid), total group by all
), placed as (
  select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id) as rank from scores join lengths using (rid) where score > 0
)
select item_id, rank::int as rank, doc_id, score from placed where rank <= 20
"""
