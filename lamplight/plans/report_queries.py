"""Queries of repetition reports, homes of findings, voice cards and attribution."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamplight.functions import lexicons as L
from lamplight.functions.scratch import cut
from lamplight.operators import register as coined
from lamplight.operators import repetition as R
from lamplight.operators import reports as RP
from lamplight.operators import thrash, voice
from lamplight.plans.registry import register
from lamplight.plans.views import chapter_numbers, chapters, dialogue, table

KEY = ["manuscript", "chapter_number"]


def books(s, d):
    """manuscript, doc_id, content: the chapters by their ids, which stand in the order of their numbers."""
    return table(s, d, "documents").select(F.col("source").alias("manuscript"), "doc_id", F.col("text").alias("content")).filter("doc_id IS NOT NULL")


def _patterns(s, d, best=None):
    return RP.told_patterns(R.sentence_patterns(books(s, d), ["manuscript", "doc_id"], best=best))


def _held(s, d, scored, counts, cap):
    """The cap best of manuscript, term, score, count, with the chapters that count them."""
    best = cut(RP.first_rows(scored, "manuscript", [F.desc("score"), "term"], cap).select("manuscript", "term", "score", "count"))
    held = counts.join(best.select("manuscript", "term"), ["manuscript", "term"]).select("manuscript", "term", "doc_id")
    numbered = held.join(chapter_numbers(s, d).select("doc_id", "chapter_number"), "doc_id")
    return best.join(numbered.groupBy("manuscript", "term").agg(F.array_sort(F.collect_set("chapter_number")).alias("chapters")), ["manuscript", "term"])


def rows(s, d):
    texts, key = books(s, d), ["manuscript", "doc_id"]
    counts, grams = R.word_counts(texts, *key), R.gram_counts(texts, *key)
    of_books = grams.filter("term IS NULL").groupBy("manuscript").agg(F.countDistinct("doc_id").alias("chapters"))
    grams = grams.filter("term IS NOT NULL")
    words = R.word_tfidf(counts, *key).select("manuscript", "term", F.col("tfidf").alias("score"), F.col("total").alias("count"))
    phrases = R.weighed(grams, of_books, *key).filter("total >= 3").select("manuscript", "term", (F.col("total") * F.col("tfidf")).alias("score"), F.col("total").alias("count"))
    words, phrases = _held(s, d, words, R.each_count(counts, *key), RP.WORDS), _held(s, d, phrases, grams, RP.PHRASES)
    found = cut(RP.first_rows(_patterns(s, d, RP.PATTERNS), "manuscript", RP.pattern_order("doc_id"), RP.PATTERNS).drop("rank"))
    return cut(RP.report(words, phrases, found.join(chapter_numbers(s, d).select("doc_id", "chapter_number"), "doc_id")))


register("N08_sentence_patterns", lambda s, d: _patterns(s, d).groupBy("manuscript", "pattern_type").agg(F.count(F.lit(1)).alias("n")))
register("Q01_repetition_report", rows)
register("Q02_repetition_export", lambda s, d: RP.export(rows(s, d), books(s, d)).select("manuscript", "rank", "kind", "phrase", "count", "scope", "severity", "quote", "normalized_key"))


def tags(s, d):
    """manuscript, tag, count, chapters: counted by text, then numbered."""
    found = R.attribution(table(s, d, "documents").select("doc_id", F.col("text").alias("content")), "doc_id", s.createDataFrame(L.speech_forms(), "form string, counted string"))
    return found.join(chapter_numbers(s, d), "doc_id").groupBy("manuscript", "tag").agg(F.sum("count").alias("count"), F.array_sort(F.collect_set("chapter_number")).alias("chapters"))


def only(s, d, number):
    """chapters() of one number; the others' texts go nowhere."""
    asked = chapter_numbers(s, d).filter(F.col("chapter_number") == number)
    return books(s, d).drop("manuscript").join(F.broadcast(asked), "doc_id")


register("Q03_companion_repetition", lambda s, d: RP.companion(rows(s, d), tags(s, d), only(s, d, 3), 3).select("manuscript", "rank", "kind", "phrase", "count", "focus_count", "scope", "severity", "quote"))
register("W09_craft_window", lambda s, d: RP.craft_window(chapters(s, d), 7).select(*KEY), "SELECT * FROM (SELECT source AS manuscript, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INTEGER) AS chapter_number FROM documents) WHERE chapter_number BETWEEN 2 AND 7")
register("O13_fallback_rows", lambda s, d: RP.fallback(rows(s, d), books(s, d)).select("manuscript", "rank", "kind", "phrase", "quote"))


def machine(s, d):
    """Machine rows of the parts: a phrase of each, as repetition or as thrash."""
    named = table(s, d, "part").select(F.lit("book").alias("manuscript"), F.col("p_partkey").alias("k"), F.col("p_name").alias("phrase"))
    return named.filter("k % 2 = 0").select("manuscript", "phrase"), named.select("manuscript", F.when(F.col("k") % 3 == 0, "common_word").otherwise("phrase").alias("kind"), "phrase", F.lit("x").alias("lemma"))


def reported(s, d):
    said = F.when(F.col("p_partkey") % 4 == 0, F.upper("p_name")).otherwise(F.concat("p_name", F.lit("x")))
    return table(s, d, "part").select(F.lit("book").alias("manuscript"), F.col("p_partkey").alias("finding_id"), F.col("p_partkey").cast("int").alias("rank"), F.when(F.col("p_partkey") % 7 == 0, "prose.rhythm").otherwise("prose.repetition").alias("dimension"), F.lit("concern").alias("severity"), said.alias("summary"), F.lit("").alias("evidence"))


_KEYS = """k AS (SELECT DISTINCT lower(p_name) AS key FROM part WHERE p_name LIKE '% %' OR length(p_name) >= 5),
    f AS (SELECT p_partkey AS finding_id, p_partkey % 7 = 0 AS other, ' ' || lower(CASE WHEN p_partkey % 4 = 0 THEN upper(p_name) ELSE p_name || 'x' END) || ' ' AS said FROM part)"""
register("J22_covered_findings", lambda s, d: RP.covered(reported(s, d), RP.machine_keys(*machine(s, d))).select("finding_id"),
    rf"WITH {_KEYS} SELECT finding_id FROM f WHERE NOT other AND EXISTS (SELECT 1 FROM k WHERE contains(said, ' ' || key || ' '))")
register("Q12_check_homes", lambda s, d: RP.dedupe(reported(s, d), *machine(s, d))[0].select("finding_id", "rank"),
    rf"WITH {_KEYS} SELECT finding_id, CAST(row_number() OVER (ORDER BY finding_id) AS INTEGER) AS rank FROM f WHERE other OR NOT EXISTS (SELECT 1 FROM k WHERE contains(said, ' ' || key || ' '))")
register("J21_repetition_dedupe", lambda s, d: RP.dedupe(reported(s, d), *machine(s, d))[1].select("kind", "phrase"),
    "SELECT CASE WHEN p_partkey % 3 = 0 THEN 'common_word' ELSE 'phrase' END AS kind, p_name AS phrase FROM part WHERE p_partkey % 3 = 0 OR lower(p_name) NOT IN (SELECT lower(p_name) FROM part WHERE p_partkey % 2 = 0)")


# --- voices ---------------------------------------------------------------------------------------------------------
def stories(s, d):
    """Conversations as chapters of six manuscripts."""
    return dialogue(s, d).select(F.concat(F.lit("m"), (F.col("conv_id") % 6).cast("string")).alias("manuscript"), F.col("conv_id").cast("int").alias("chapter_number"), "content")


def cards(s, d):
    cast = s.createDataFrame([("user", "User", "terse and clipped"), ("assistant", "Dr. Assistant Prime", "formal, with slang"), ("assistant2", "Assistant", "a sermon")], "slug string, name string, dialogue_voice string")
    return stories(s, d).select("manuscript").distinct().crossJoin(F.broadcast(cast))


register("J08_attributed_quotes", lambda s, d: voice.attributed(stories(s, d), cards(s, d)).groupBy("manuscript", "slug").agg(F.count(F.lit(1)).alias("n")))
register("Q06_card_issues", lambda s, d: voice.card_issues(stories(s, d), cards(s, d)).select("manuscript", "rank", "kind", "severity", "speaker", "speaker_b", "quote"))
register("J09_speaker_aliases", lambda s, d: voice.aliases(table(s, d, "part").select(F.lit("m").alias("manuscript"), F.col("p_partkey").cast("string").alias("slug"), F.initcap("p_name").alias("name"))).select("called", "slug").filter("NOT contains(called, ' ')"),
    """SELECT split_part(lower(p_name), ' ', 1) AS called, max(CAST(p_partkey AS VARCHAR)) AS slug FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey) = 1""")  # fmt: skip
register("N14_scopes", lambda s, d: table(s, d, "events").groupBy("user_id").agg(F.collect_set(F.hour("ts")).alias("chapters")).select("user_id", voice.scope(F.col("chapters"), 3).alias("scope")),
    """SELECT user_id, CASE WHEN bool_or(hour(ts) = 3) AND bool_or(hour(ts) <> 3) THEN 'prior+focus' WHEN bool_or(hour(ts) = 3) THEN 'focus' ELSE 'prior — context only' END AS scope FROM events GROUP BY 1""")  # fmt: skip
_LINES = "[' he said, \"so it is\" and left', 'the \"dead silence\" of it', '\"Go\"', 'a word: \"Yes\"', '— x \"no\"', 'it was \"red\", she told him']"


def _spoken(s, d):
    import pandas as pd

    made = F.pandas_udf(lambda c: pd.Series([voice.spoken(x, x.index('"'), x.rindex('"') + 1) for x in c]), "boolean")
    return table(s, d, "region").select(F.explode(F.array(*[F.lit(x) for x in (' he said, "so it is" and left', 'the "dead silence" of it', '"Go"', 'a word: "Yes"', '— x "no"', 'it was "red", she told him')])).alias("line")).distinct().select("line", made("line").alias("spoken"))


register("F19_spoken", _spoken, f"SELECT unnest({_LINES}) AS line, unnest([true, false, true, true, true, true]) AS spoken")


def coined_chapters(s, d):
    return chapters(s, d).select(*KEY, F.replace(F.replace("content", F.lit(" the "), F.lit("-the-")), F.lit(" que "), F.lit(" *que* ")).alias("content"))


register("Q05_register_findings", lambda s, d: coined.register_findings(coined_chapters(s, d)))
register("O08_register_cap", lambda s, d: coined.register_cap(coined.register_findings(coined_chapters(s, d))).select("manuscript", "rank", "chapter_number", "kind", "severity", "normalized_key"))
register("F06_procedural", lambda s, d: table(s, d, "part").select("p_partkey", F.expr("CASE p_partkey % 3 WHEN 0 THEN 'two' WHEN 1 THEN 'mile' ELSE 'red' END").alias("a"), F.expr("CASE WHEN p_partkey % 2 = 0 THEN 'miles' ELSE 'ten' END").alias("b")).select("p_partkey", thrash.procedural(["a", "b"]).alias("si")),
    "SELECT p_partkey, p_partkey % 3 < 2 AS si FROM part")
