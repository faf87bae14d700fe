"""Repetition reports and the homes of findings."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamplight.functions import scalars as S
from lamplight.operators.repetition import kept_terms

# Caps, and the least length of a single word that ties a finding to a row.
WORDS, PHRASES, PATTERNS, PLACES, CAP, CRAFT_CAP, LEAST_KEY = 50, 40, 20, 8, 40, 25, 5


_WORD = regex.compile(r"\w")


def first_whole(term: str, text: str) -> tuple[int, int] | None:
    """Start and end of the first place where a term stands as whole words, without regard to case. A pattern is only made
    for what plain search may not know: terms beyond ASCII, and texts whose lower case does not match letter by letter."""
    low = text.lower()
    if not term.isascii() or len(low) != len(text) or "ſ" in text:
        m = regex.search(rf"(?<!\w){regex.escape(term)}(?!\w)", text, regex.I)
        return m and m.span()
    said, at = term.lower(), -1
    while (at := low.find(said, at + 1)) >= 0:
        end = at + len(said)
        if not (at and _WORD.match(text, at - 1)) and not _WORD.match(text, end):
            return at, end
    return None


def quote_around(term: str | None, text: str | None, most: int = 160) -> str | None:
    """the sentence around the first place where a term stands as whole words, without regard to case; of a long one
    `most` characters, a third of them before the term."""
    found = first_whole(term, text) if term and text else None
    if not found:
        return None
    first, last = found
    start = text.rfind(".", 0, first) + 1
    stops = [i for i in (text.find(c, last) for c in ".!?") if i >= 0]
    quote = text[start : min(stops) + 1 if stops else last + 80].strip()
    if len(quote) > most:
        left = max(0, first - start - most // 3)
        quote = quote[left : left + most].strip()
    return quote or None


def whole_phrases(term: Column, text: Column) -> Column:
    """how often a term stands in a text as whole words."""
    return F.regexp_count(text, F.concat(F.lit(r"(?iu)(?<!\w)\Q"), term, F.lit(r"\E(?!\w)")))


def word_severity(score: Column) -> Column:
    return F.when(score > 0.3, "high").when(score > 0.15, "moderate").otherwise("low")


def count_severity(count: Column) -> Column:
    return F.when(count >= 10, "high").when(count >= 5, "moderate").otherwise("low")


def likeness_severity(score: Column) -> Column:
    return F.when(score >= 0.9, "high").when(score >= 0.75, "moderate").otherwise("low")


def first_rows(rows: DataFrame, key: str, order: list, cap: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("rank") <= cap)


def report(words: DataFrame, phrases: DataFrame, found: DataFrame) -> DataFrame:
    """Manuscript, kind, phrase, count, chapters, severity, examples. words and phrases: manuscript, term, score,
    count, chapters; found: rows of told_patterns(), with their chapters. Each kind has its own order and cap."""
    none = F.array().cast("array<string>").alias("examples")
    w = first_rows(words, "manuscript", [F.desc("score"), "term"], WORDS).select("manuscript", F.lit("word").alias("kind"), F.col("term").alias("phrase"), F.col("count").cast("long").alias("count"), "chapters", word_severity(F.col("score")).alias("severity"), none)
    p = first_rows(phrases, "manuscript", [F.desc("score"), "term"], PHRASES).select("manuscript", F.lit("phrase").alias("kind"), F.col("term").alias("phrase"), F.col("count").cast("long").alias("count"), "chapters", count_severity(F.col("count")).alias("severity"), none)
    rows = found.withColumn("severity", likeness_severity(F.col("score")))
    s = first_rows(rows, "manuscript", pattern_order("chapter_number"), PATTERNS)
    s = s.select("manuscript", F.lit("sentence_pattern").alias("kind"), "phrase", "count", F.array("chapter_number").alias("chapters"), "severity", F.slice("examples", 1, 3).alias("examples"))
    return w.unionByName(p).unionByName(s)


def told_patterns(found: DataFrame) -> DataFrame:
    """Found with the phrase that a report says, of rows of repetition.sentence_patterns()."""
    kind = F.col("pattern_type")
    phrase = F.when(kind == "repeated_opening", F.concat(F.lit("Sentences opening with '"), "opening", F.lit("'"))).when(kind == "near_duplicate", "Near-duplicate sentences").otherwise("Sentences of one length")
    return found.withColumn("phrase", phrase).drop("opening")


def pattern_order(place: str) -> list:
    """The order of a book's patterns in a report."""
    return [S.severity_rank(likeness_severity(F.col("score"))), F.desc("score"), place, "phrase", F.col("examples").cast("string")]


def row_quotes(rows: DataFrame, chapters: DataFrame) -> DataFrame:
    """Manuscript, kind, phrase, quote of a report's words and phrases: from the first chapter that counts the term and
    yields one. Workers are told the rows and keep each row's first quote, so texts are neither shuffled nor repeated."""
    told: dict = {}
    asked = rows.filter("kind <> 'sentence_pattern' AND phrase <> '' AND manuscript IS NOT NULL").select("manuscript", "kind", "phrase").distinct()
    for name, kind, phrase in asked.toLocalIterator():
        told.setdefault(name, []).append((kind, phrase))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict = {}
        for batch in batches:
            for name, number, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                mine = [x for x in told.get(name, ()) if (name, *x) not in best or number < best[name, *x][0]]
                content, kept = text.as_py() if mine else None, None
                for kind, phrase in mine:
                    quote = quote_around(phrase, content)
                    if quote:
                        kept = kept or f" {' '.join(kept_terms(content))} "
                        if f" {phrase} " in kept:
                            best[name, kind, phrase] = (number, quote)
        if best:
            made = [(*k, *v) for k, v in best.items()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made, strict=True), (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()), strict=True)], ["manuscript", "kind", "phrase", "place", "quote"])

    place = "doc_id" if "doc_id" in chapters.columns else "chapter_number"
    made = chapters.select("manuscript", F.col(place).cast("long").alias("place"), "content").mapInArrow(run, "manuscript string, kind string, phrase string, place long, quote string")
    return made.groupBy("manuscript", "kind", "phrase").agg(F.min_by("quote", "place").alias("quote"))


def export(rows: DataFrame, chapters: DataFrame, cap: int = CAP) -> DataFrame:
    """The rows of a report with scope, quote and key, by severity, then count, then those of several chapters."""
    out = rows.withColumns({"chapters": F.array_sort(F.array_distinct("chapters")), "normalized_key": S.normalized_key(F.col("phrase"))})
    out = out.withColumn("scope", F.when(F.size("chapters") > 1, "cross_chapter").otherwise("local")).withColumn("focus_count", F.lit(0))
    order = [S.severity_rank(F.col("severity")), F.desc("count"), F.col("scope") != "cross_chapter", "kind", "phrase", F.col("chapters").cast("string"), F.col("examples").cast("string")]
    top = first_rows(out, "manuscript", order, cap)
    own = F.when((F.col("kind") == "sentence_pattern") & (F.size("examples") > 0), F.left(F.trim(F.get("examples", F.lit(0))), F.lit(160)))
    return top.join(row_quotes(top, chapters), ["manuscript", "kind", "phrase"], "left").withColumn("quote", F.coalesce(own, "quote")).drop("examples")


def craft_window(chapters: DataFrame, focus: int, k: int = 5) -> DataFrame:
    """The chapters [focus - k, focus]."""
    return chapters.filter(F.col("chapter_number").between(focus - k, focus))


def companion(rows: DataFrame, tags: DataFrame, chapters: DataFrame, focus: int, cap: int = CRAFT_CAP) -> DataFrame:
    """What a report says of one chapter: rows that it is in, with how often it has them; tags (manuscript, tag,
    count, chapters) among them. Quotes come from that chapter alone."""
    text = chapters.filter(F.col("chapter_number") == focus).select("manuscript", "content")
    all_ = rows.unionByName(tags.select("manuscript", F.lit("dialogue_tag").alias("kind"), F.col("tag").alias("phrase"), F.col("count").cast("long").alias("count"), "chapters", count_severity(F.col("count")).alias("severity"), F.array().cast("array<string>").alias("examples")))
    here = all_.filter(F.array_contains("chapters", focus)).withColumn("scope", F.when(F.exists("chapters", lambda c: c != focus), "cross_chapter").otherwise("local"))
    top = first_rows(here, "manuscript", [S.severity_rank(F.col("severity")), F.desc("count"), F.col("scope") != "cross_chapter", "kind", "phrase", F.col("examples").cast("string")], cap)
    told = top.join(text, "manuscript").withColumn("focus_count", F.when(F.col("kind") == "sentence_pattern", 0).otherwise(whole_phrases(F.col("phrase"), F.col("content"))))

    def quotes(kind: pd.Series, phrase: pd.Series, examples: pd.Series, content: pd.Series) -> pd.Series:
        rows_ = zip(kind, phrase, examples, content, strict=True)
        return pd.Series([(e[0].strip() if len(e) else None) if k == "sentence_pattern" else quote_around(p, t) for k, p, e, t in rows_])

    return told.withColumn("quote", F.pandas_udf(quotes, "string")("kind", "phrase", "examples", "content")).drop("content", "examples")


def machine_keys(repetition: DataFrame, thrash: DataFrame) -> DataFrame:
    """Keys of machine rows that can tie a finding to one: of several words, or of LEAST_KEY letters."""
    keys = repetition.select("manuscript", S.normalized_key(F.col("phrase")).alias("key")).unionByName(thrash.select("manuscript", S.normalized_key(F.coalesce("phrase", "lemma")).alias("key")))
    return keys.filter(F.contains("key", F.lit(" ")) | (F.length("key") >= LEAST_KEY)).distinct()


def covered(findings: DataFrame, keys: DataFrame) -> DataFrame:
    """finding_ids of prose.repetition concerns that name a key. A key is looked up by its first word, then confirmed
    as whole words."""
    asked = findings.filter("dimension = 'prose.repetition' AND severity = 'concern'").select("manuscript", "finding_id", S.normalized_key(F.concat_ws(" ", F.coalesce("summary", F.lit("")), F.coalesce("evidence", F.lit("")))).alias("said"))
    first = lambda c: F.regexp_extract(c, r"([\p{L}\p{N}_]+)", 1)
    words = F.array_distinct(F.regexp_extract_all("said", F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)))
    pairs = asked.select("manuscript", "finding_id", F.explode(words).alias("w")).join(keys.select("manuscript", "key", first(F.col("key")).alias("w")), ["manuscript", "w"])
    return pairs.select("manuscript", "finding_id", "key").join(asked, ["manuscript", "finding_id"]).filter(whole_phrases(F.col("key"), F.col("said")) > 0).select("manuscript", "finding_id").distinct()


def dedupe(findings: DataFrame, repetition: DataFrame, thrash: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings without those that a machine row covers, and thrash rows without phrases that are repetition rows."""
    phrases = repetition.select("manuscript", S.normalized_key(F.col("phrase")).alias("_k")).filter("_k <> ''").distinct()
    doubled = thrash.filter("kind = 'phrase'").withColumn("_k", S.normalized_key(F.col("phrase")))
    left = thrash.filter("kind IS NULL OR kind <> 'phrase'").unionByName(doubled.join(phrases, ["manuscript", "_k"], "left_anti").drop("_k"))
    gone = covered(findings, machine_keys(repetition, left))
    order = Window.partitionBy("manuscript").orderBy("rank", "finding_id")
    kept = findings.join(gone, ["manuscript", "finding_id"], "left_anti")
    return kept.withColumn("rank", F.row_number().over(order)), left


def fallback(rows: DataFrame, chapters: DataFrame, n: int = 3) -> DataFrame:
    """The n rows of a report that stand for evidence that failed: with a quote, words and phrases first, by severity
    and count."""
    held = rows.join(row_quotes(rows, chapters), ["manuscript", "kind", "phrase"])
    return first_rows(held, "manuscript", [~F.col("kind").isin("word", "phrase"), S.severity_rank(F.col("severity")), F.desc("count"), "phrase"], n).drop("examples")
