"""Columns of the input may have any names, those used inside the operators included: they come back as they were."""

from pyspark.sql import functions as F

from wardspan.llm import jaccard_join, latent_decontamination, line_dedup, quality_rules, secret_scan

NAMES = ("_bad_id bad_id bad_text _bad_text _cut_doc cut_doc cut_hash cut_lines cut _id kept_id least_hash times _th _times free _c_doc "
         "hit_doc hit_hash hit_rules found text_hash _text_hash th cls component_id n stratum kept doc leader").split()


def test_rows_keep_their_own_columns(spark):
    line = "a line of some length that stands in more than one document of this small table"
    rows = [(i, f"{line} number {i}\n" * 3 + "and a password = hunter2222 ends it.", "en", "src", 5) for i in range(6)] + [(0, None, "en", "src", 0)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = plain.select("*", *(F.concat(F.lit(n), F.col("doc_id")).alias(n) for n in NAMES))
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([(1, "nothing of this stands anywhere in the documents")], "item_id long, text string")
    outs = [
        quality_rules.keep(docs, labels), line_dedup.deduplicated(docs)[0], jaccard_join.keep_one(docs, jaccard_join.Settings(shingle=5, percent=80)),
        latent_decontamination.clean(docs, benchmark), secret_scan.scanned(docs)[0],
    ]
    for out in outs:
        assert out.columns[: len(docs.columns)] == docs.columns
        for r in out.collect():
            assert all(r[n] == f"{n}{r['doc_id']}" for n in NAMES)
