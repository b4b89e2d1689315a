"""The corpus pipeline: quality rules, line deduplication, near-duplicate removal, benchmark decontamination, packing.

Each stage gets the rows that the stage before it kept, as a table that has been written and read again. All but the last
return the columns of ``documents``. Tables that a stage stored for itself are removed when the next stage begins.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspan.llm import jaccard_join, latent_decontamination, line_dedup, mixture_packing, quality_rules
from wardspan.llm.common import release, shared_folder, storing_for
from wardspan.llm.queries import table, tokenizer_path

OWNER = "pipeline"


def _stage(fn: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, OWNER)
        with storing_for(OWNER):
            return fn(spark, docs, sf_dir)

    run_stage.__name__, run_stage.__doc__ = fn.__name__, fn.__doc__
    return run_stage


@_stage
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.keep(docs, table(spark, sf_dir, "labels"))


@_stage
def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the runs of lines that stand in an earlier document; documents of which no word is left go."""
    df, _ = line_dedup.deduplicated(docs)
    return df.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns)


@_stage
def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, Jaccard similarity 0.8 or more."""
    return jaccard_join.keep_one(docs, jaccard_join.Settings(shingle=5, percent=80))


@_stage
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return latent_decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


@_stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, mixed by source."""
    return mixture_packing.packed(docs, mixture_packing.Settings(tokenizer_path()))


STAGES = [
    ("quality_rules", good_quality),
    ("line_dedup", without_repeated_lines),
    ("jaccard_join", one_of_each_group),
    ("latent_decontamination", decontaminated),
    ("mixture_packing", packed),
]

#: The fitted rules, winnowing, components and packing are beyond SQL; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, fn) in enumerate(STAGES):
        out = fn(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = f"{shared_folder(spark).rstrip('/')}/pipeline-{name}-{uuid.uuid4().hex}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
