"""Queries of quote verification: findings whose evidence is true, altered or made up, against the chapters of the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamplight.functions import scalars as S
from lamplight.operators import quotes as Q
from lamplight.plans.registry import register
from lamplight.plans.views import table


def texts(s, d):
    return table(s, d, "documents").select(F.col("doc_id").cast("int").alias("chapter_number"), F.col("text").alias("content"))


def findings(s, d):
    """One finding for each document: its words 3 to 9, in capitals for every third, made up for every fifth."""
    words = F.array_join(F.slice(F.split("text", " "), 3, 7), " ")
    said = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("no such words are anywhere "), F.col("doc_id").cast("string"))).when(F.col("doc_id") % 3 == 0, F.upper(words)).otherwise(words)
    return table(s, d, "documents").select(
        F.col("doc_id").alias("finding_id"), F.when(F.col("doc_id") % 10 == 0, "prose.repetition").otherwise("consistency.timeline").alias("dimension"), F.lit("concern").alias("severity"),
        F.lit("it does not fit").alias("summary"), F.concat(F.lit("Ch "), F.col("doc_id").cast("string"), F.lit(": '"), said, F.lit("'")).alias("evidence"),
        F.when(F.col("doc_id") % 4 == 0, "Canon C1").otherwise("").alias("counter_evidence"), F.concat(F.lit("scene 3, chapter "), F.col("doc_id").cast("string")).alias("chapter_ref"),
    )


_CITED = "SELECT doc_id AS finding_id, [CAST(doc_id AS INTEGER)] AS cited FROM documents"
register("F25_cited_chapters", lambda s, d: findings(s, d).select("finding_id", Q.cited_chapters(F.col("chapter_ref"), F.col("evidence"), F.col("counter_evidence")).alias("cited")), _CITED)
register("T20_quote_parts", lambda s, d: Q.parts_of(findings(s, d), "evidence").select("finding_id", "part_no", "cited", "quote"))
register("Q10_verified_findings", lambda s, d: Q.check_findings(findings(s, d), texts(s, d)).select("finding_id", "severity", "summary", "quote_verified", "match", F.col("location.chapter_number").alias("chapter"), F.col("location.start").alias("start"), "id"))
register("N02_prepared_texts", lambda s, d: texts(s, d).filter("chapter_number IS NOT NULL AND content <> ''").select("chapter_number", F.length(S.normalized_quote(F.col("content"))).alias("chars")))


def whole_quotes(s, d):
    """J18, exact tier, every pair."""
    return Q.whole(table(s, d, "benchmark"), table(s, d, "documents"), "item_id", "doc_id").select("doc_id", "item_id", "at")


register("J18_exact_quotes", whole_quotes, "SELECT doc_id, item_id, CAST(strpos(d.text, b.text) AS INTEGER) AS at FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
