"""Queries of the trained operators; held-out accuracy is tested, as SQL cannot express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from campaignlens.llm.language import fit_language, predict_language
from campaignlens.llm.quality import THRESHOLD, fit_quality, fold, score_quality
from campaignlens.llm.registry import query
from campaignlens.sources.readers import read_table


@query("op4_language_id")
def op4_language_id(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    tagger = fit_language(docs, learn=F.coalesce(fold("doc_id", 4) != 2, F.lit(True)))
    held_out = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    return predict_language(rows, tagger, keep_text=False)


@query("op6_quality_classifier")
def op6_quality_classifier(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    net = fit_quality(docs, read_table(spark, sf_dir, "labels"), learn=fold("doc_id", 5) != 0)
    held_out = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    scored = score_quality(docs.select("doc_id", held_out.alias("held_out"), "text"), net, keep_text=False)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
