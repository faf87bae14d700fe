"""Coined terms in an opening."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamplight.functions import scalars as S
from lamplight.operators.reports import quote_around

# Plain English compounds that are no coined terms.
PLAIN_COMPOUNDS = [
    "cold-forged", "well-known", "well-worn", "long-term", "short-term", "two-turn", "half-bell", "slag-hills", "felt-lined",
    "middle-aged", "half-syllable", "soot-wet",
]
BUDGET, WINDOW_WORDS = 3, 300


def opening(text: Column, words: int = WINDOW_WORDS) -> Column:
    """The shortest beginning that holds the first `words` words."""
    return F.regexp_extract(text, rf"^\s*(?:\S+\s+){{0,{words - 1}}}\S+", 0)


def coined_terms(texts: DataFrame, key: str, content: str = "content") -> DataFrame:
    """Hyphenated terms of the opening by first place, their number in the text and a severity. Terms in
    title case and plain compounds are passed over."""
    found = F.regexp_extract_all(opening(F.col(content)), F.lit("([A-Za-z]+(?:-[A-Za-z]+)+)"), F.lit(1))
    rows = texts.select(key, F.lower(content).alias("_low"), F.posexplode(found).alias("pos", "term"))
    rows = rows.filter(~F.col("term").rlike("^[A-Z][a-z]*(?:-[A-Z][a-z]*)+$")).withColumn("term", F.lower("term")).filter(~F.col("term").isin(PLAIN_COMPOUNDS))
    firsts = rows.groupBy(key, "term").agg(F.min("pos").alias("pos"), F.max((F.length("_low") - F.length(F.replace("_low", F.col("term"), F.lit("")))) / F.length("term")).cast("long").alias("count"))
    ranked = firsts.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("pos")) - 1)
    severity = F.when((F.col("rank") < 3) & (F.col("count") >= 5), "high").when(F.col("rank") < 5, "moderate").otherwise("low")
    return ranked.select(key, "term", "rank", "count", severity.alias("severity"))


def overruns(terms: DataFrame, key: str) -> DataFrame:
    """Openings with more coined terms than the budget."""
    rows = terms.groupBy(key).agg(F.count(F.lit(1)).alias("terms")).filter(F.col("terms") > BUDGET)
    return rows.withColumn("severity", F.when(F.col("terms") - BUDGET >= 2, "high").otherwise("moderate"))


# Italic and hyphenated terms, and how a gloss is tied to a term (T).
ITALIC = regex.compile(r"(?<!\*)\*([A-Za-z][A-Za-z0-9']*)\*(?:-([A-Za-z][A-Za-z0-9']*))?")
HYPHENED = regex.compile(r"\b([A-Za-z]+(?:-[A-Za-z]+)+)\b")
GLOSSES = [r"T\s*[\(\[][^)\]]{1,80}[\)\]]", r"[\(\[][^)\]]{1,80}[\)\]]\s*T", r"\b(?:was|were|is|are)\s+called\s+T", r"\bknown\s+as\s+T", r"\bnamed\s+T", r"T\s+means?\b", r"\bmeans?\s+T"]
#: What a gloss of each kind cannot be without; patterns of a term are only made where the sentences have it.
SIGNS = [regex.compile(s, regex.I) for s in [*[r"[\(\[][^)\]]{1,80}[\)\]]"] * 2, r"\b(?:was|were|is|are)\s+called\s", r"\bknown\s+as\s", r"\bnamed\s", r"\smeans?\b", r"\bmeans?\s"]]
CAP = 15


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """Start and end of every sentence; what stands between them is white space."""
    ends = [m.start() for m in regex.finditer(r"(?<=[.!?])\s+", text)] + [len(text)]
    starts = [0] + [m.end() for m in regex.finditer(r"(?<=[.!?])\s+", text)]
    return [(s, e) for s, e in zip(starts, ends, strict=True) if e > s] if text.strip() else []


def untaught(found: list[tuple[int, str, str]], text: str) -> list[tuple[int, str, str]]:
    """the (place, term, key) to which no gloss is tied within two sentences of their place."""
    spans, signs, left = sentence_spans(text), {}, []
    ends = [e for _, e in spans]
    for at, term, key in found:
        here = min(bisect.bisect_right(ends, at), len(spans) - 1)
        if here not in signs:
            near = text[spans[max(0, here - 2)][0] : spans[min(len(spans) - 1, here + 2)][1]] if spans else ""
            signs[here] = near, [g for g, sign in zip(GLOSSES, SIGNS, strict=True) if sign.search(near)]
        near, glosses = signs[here]
        own = rf"(?<!\w)\*?{regex.escape(term)}\*?(?!\w)"
        if not any(regex.search(g.replace("T", own, 1), near, regex.I) for g in glosses):
            left.append((at, term, key))
    return left


def taught(term: str, text: str, at: int) -> bool:
    """whether a gloss is tied to the term within two sentences of its place."""
    return not untaught([(at, term, term)], text)


def candidates(text: str) -> list[tuple[int, str, str]]:
    """(place, term, key) of coined terms, each at its first place: italic words first, then hyphenated ones but for plain
    compounds and names in title case."""
    found: dict[str, tuple[int, str]] = {}
    spans = [(m.start(), "-".join(filter(None, m.groups()))) for m in ITALIC.finditer(text)]
    spans += [(m.start(), m[1]) for m in HYPHENED.finditer(text) if not (m[1][0].isupper() and any(p[:1].isupper() for p in m[1].split("-")[1:]))]
    for at, term in spans:
        key = term.lower()
        if key not in PLAIN_COMPOUNDS:
            found.setdefault(key, (at, term))
    return sorted((at, term, key) for key, (at, term) in found.items())


ROWS = "manuscript string, chapter_number int, kind string, severity string, term string, coined int, quote string, normalized_key string"


def _register(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for book, number, text in zip(b["manuscript"], b["chapter_number"], b["opening"], strict=True):
            left = untaught(candidates(text), text)
            over = len(left) - BUDGET
            if over > 0:
                rows.append((book, number, "initiation_budget", "high" if over >= 2 else "moderate", None, len(left), quote_around(left[0][1], text), f"initiation_budget:{number}"))
            for rank, (_, term, key) in enumerate(left):
                severity = "high" if len(left) >= BUDGET + 2 and rank < 3 else "moderate" if rank < 5 else "low"
                rows.append((book, number, "unearned_jargon", severity, term, None, quote_around(term, text), key))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in ROWS.split(", ")]).astype({"coined": "Int32"})


def register_findings(chapters: DataFrame) -> DataFrame:
    """Q05: of every chapter's opening the terms that nothing explains, and whether there are more than the budget. Only
    openings go to the workers."""
    body = S.without_front_matter(F.coalesce("content", F.lit("")))
    return chapters.select("manuscript", "chapter_number", opening(body).alias("opening")).filter("opening <> ''").mapInPandas(_register, ROWS)


def register_cap(rows: DataFrame, cap: int = CAP) -> DataFrame:
    """The first rows of every chapter by kind, severity and key; of these the first of the book by severity, kind,
    chapter and key, with their rank."""
    kind, severity = F.when(F.col("kind") == "initiation_budget", 0).otherwise(1), S.severity_rank(F.col("severity"))
    chapter = Window.partitionBy("manuscript", "chapter_number").orderBy(kind, severity, "normalized_key")
    book = Window.partitionBy("manuscript").orderBy(severity, kind, "chapter_number", "normalized_key")
    kept = rows.withColumn("_n", F.row_number().over(chapter)).filter(F.col("_n") <= cap).drop("_n")
    return kept.withColumn("rank", F.row_number().over(book)).filter(F.col("rank") <= cap)
