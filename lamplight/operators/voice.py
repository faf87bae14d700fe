"""Attribution of quotes, speaker metrics and voice cards."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamplight.functions import lexicons as L
from lamplight.functions import scalars as S

# Quoted spans, verbs next to a quote, contractions, and the cap and least lines of reports.
QUOTED = regex.compile(r"\u201c([^\u201d]+)\u201d|\"([^\"]+)\"", regex.S)
VERBS = (
    "said|says|say|asked|asks|ask|replied|replies|reply|answered|answers|answer|whispered|whispers|muttered|mutters|"
    "shouted|shouts|told|tells|spoke|speaks|called|calls|cried|cries|added|adds|continued|continues"
)
VERB_BEFORE = regex.compile(rf"\b(?:{VERBS})\s*[,:]?\s*$", regex.I)
VERB_AFTER = regex.compile(rf"^[,.]?\s*(?:\w+\s+)?(?:{VERBS})\b", regex.I)
CONTRACTIONS = ["n't", "'ll", "'ve", "'re", "'d", "'m"]
LEAST_LINES, CAP = 4, 15


def given_name(name: Column) -> Column:
    """the first word that is no title, in lower case."""
    words = F.filter(F.split(F.lower(name), r"\s+"), lambda w: (w != "") & ~F.regexp_replace(w, r"\.$", "").isin(L.TITLES))
    return F.get(words, F.lit(0))


def cue_families(text: Column) -> Column:
    """the families with a cue in the text; monotone gives way to sermon."""
    low = F.lower(text)
    hit = {k: F.exists(F.array(*map(F.lit, cues)), lambda c: F.contains(low, c)) for k, cues in L.CUES.items()}
    hit["monotone"] = hit["monotone"] & ~hit["sermon"]
    return F.array_compact(F.array(*[F.when(c, k) for k, c in sorted(hit.items())]))


def speaker_metrics(lines: DataFrame, speaker: str, line: str) -> DataFrame:
    """Lines, mean words and the rates of contractions, fragments (one to five words) and interruptions."""
    words = F.regexp_count(line, F.lit("[A-Za-z']+"))
    mean = lambda c, name: F.round(F.avg(c.cast("int")), 4).alias(name)
    return lines.groupBy(speaker).agg(
        F.count(F.lit(1)).alias("line_count"),
        F.round(F.avg(words), 4).alias("avg_words"),
        mean(F.col(line).rlike("[A-Za-z]'[A-Za-z]"), "contraction_rate"),
        mean(words.between(1, 5), "fragment_rate"),
        mean(F.col(line).rlike("(--|—)$"), "interruption_rate"),
    )


def spoken(line: str, start: int, end: int) -> bool:
    """whether the quote at [start, end) of a line is speech: by a dash or a verb of speech next to it, or by where it
    stands; one that a clause runs into is not."""
    before, after = line[:start].rstrip(), line[end:].lstrip()
    dash = ("—", "–")
    if before.endswith(dash) or after.startswith(dash) or line.lstrip().startswith(dash):
        return True
    if VERB_BEFORE.search(before) or VERB_AFTER.match(after):
        return True
    return not before or before[-1] in ".!?:" or not before[-1].isalnum()


def named_in(name: str, context: str) -> bool:
    """whether a name stands in a text as a whole word; both in folded case."""
    return bool(name) and regex.search(rf"(?<!\w){regex.escape(name)}(?!\w)", context) is not None


def aliases(cards: DataFrame) -> DataFrame:
    """Manuscript, called, slug: full names, and given names that no other speaker of the manuscript has."""
    named = cards.filter("trim(coalesce(name, '')) <> ''").select("manuscript", "slug", F.lower("name").alias("full"), given_name(F.col("name")).alias("given"))
    full = named.groupBy("manuscript", F.col("full").alias("called")).agg(F.max("slug").alias("slug"))
    short = named.filter("given IS NOT NULL AND given <> full").groupBy("manuscript", F.col("given").alias("called")).agg(F.countDistinct("slug").alias("n"), F.max("slug").alias("slug")).filter("n = 1").drop("n")
    return full.unionByName(short.join(full, ["manuscript", "called"], "left_anti"))


ATTRIBUTED = "manuscript string, chapter_number int, quote_no int, slug string, quote string"


def _attribute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for book, number, text, called in zip(b["manuscript"], b["chapter_number"], b["content"], b["called"], strict=True):
            known = sorted(((c["called"], c["slug"]) for c in called), key=lambda c: (-len(c[0]), c))
            lines, n = text.split("\n"), 0
            for m in QUOTED.finditer(text):
                said = " ".join((m[1] or m[2]).split())
                at = text.count("\n", 0, m.start())
                begin = text.rfind("\n", 0, m.start()) + 1
                if not said or not spoken(lines[at], m.start() - begin, min(m.end() - begin, len(lines[at]))):
                    continue
                near = (lines[at].casefold(), " ".join(lines[max(0, at - 2) : at + 3]).casefold())
                who = next((slug for context in near for name, slug in known if named_in(name, context)), None)
                if who is not None:
                    rows.append((book, number, n, who, said))
                    n += 1
        yield pd.DataFrame(rows, columns=["manuscript", "chapter_number", "quote_no", "slug", "quote"])


def attributed(chapters: DataFrame, cards: DataFrame) -> DataFrame:
    """The quoted speech of every chapter with its speaker: the longest name in its line, or else within two lines
    of it. Speech near no name is nobody's. chapters: manuscript, chapter_number, content; cards: manuscript, slug, name.
    A manuscript's cast goes to its chapters as one list."""
    lists = aliases(cards).groupBy("manuscript").agg(F.collect_list(F.struct("called", "slug")).alias("called"))
    rows = chapters.join(lists, "manuscript").filter("content IS NOT NULL")
    return rows.select("manuscript", "chapter_number", S.without_front_matter(F.col("content")).alias("content"), "called").mapInPandas(_attribute, ATTRIBUTED)


def voice_metrics(lines: DataFrame) -> DataFrame:
    """A15 over attributed speech: manuscript, slug, line_count, avg_words, contraction_rate, fragment_rate,
    interruption_rate, the last quote and the chapters."""
    words, low = F.regexp_count("quote", F.lit("[A-Za-z']+")), F.lower("quote")
    share = lambda c, name: F.avg(c.cast("int")).alias(name)
    cut = F.contains("quote", F.lit("—")) | F.contains("quote", F.lit("...")) | F.contains("quote", F.lit("…"))
    return lines.groupBy("manuscript", "slug").agg(
        F.count(F.lit(1)).alias("line_count"), F.avg(words).alias("avg_words"),
        share(F.exists(F.array(*map(F.lit, CONTRACTIONS)), lambda c: F.contains(low, c)), "contraction_rate"), share(words.between(1, 5), "fragment_rate"), share(cut, "interruption_rate"),
        F.max_by("quote", F.struct("chapter_number", "quote_no")).alias("quote"), F.array_sort(F.collect_set("chapter_number")).alias("chapters"),
    )


def contrast(a: Column, b: Column) -> Column:
    """Two cards that say something, and not the same."""
    x, y = S.card_text(F.coalesce(a, F.lit(""))), S.card_text(F.coalesce(b, F.lit("")))
    return (x != "") & (y != "") & (x != y)


def card_issues(chapters: DataFrame, cards: DataFrame, least: int = LEAST_LINES, cap: int = CAP) -> DataFrame:
    """Manuscript, rank, kind, severity, speaker, speaker_b, quote, chapters: speakers of `least` lines or more whose
    speech does not keep what their card promises, and pairs who sound alike although their cards differ; pairs first,
    then by severity, then by speaker. cards: manuscript, slug, name, dialogue_voice, one for a speaker. Pairs are tried
    within one cast, bucketed by words in a line, which must be near."""
    rows = voice_metrics(attributed(chapters, cards)).filter(F.col("line_count") >= least).join(cards.select("manuscript", "slug", "dialogue_voice"), ["manuscript", "slug"])
    missed = cue_misses(rows.withColumnRenamed("slug", "speaker"), None, "speaker").select("manuscript", F.lit("card_mismatch").alias("kind"), "severity", "speaker", F.lit(None).cast("string").alias("speaker_b"), "quote", "chapters")
    left = rows.withColumn("bucket", F.floor(F.col("avg_words") / 2.0))
    right = left.select("manuscript", *[F.col(c).alias(f"b_{c}") for c in left.columns if c not in ("manuscript", "bucket")], F.explode(F.array(*[F.col("bucket") + k for k in (-1, 0, 1)])).alias("bucket"))
    near = lambda c, most: F.abs(F.col(c) - F.col(f"b_{c}")) <= most
    alike = left.join(right, ["manuscript", "bucket"]).filter((F.col("slug") < F.col("b_slug")) & near("avg_words", 2.0) & near("contraction_rate", 0.1) & near("fragment_rate", 0.1) & contrast(F.col("dialogue_voice"), F.col("b_dialogue_voice")))
    pairs = alike.select("manuscript", F.lit("card_collapse").alias("kind"), F.lit("moderate").alias("severity"), F.col("slug").alias("speaker"), F.col("b_slug").alias("speaker_b"), "quote", F.array_sort(F.array_union("chapters", "b_chapters")).alias("chapters"))
    order = Window.partitionBy("manuscript").orderBy(F.when(F.col("kind") == "card_collapse", 0).otherwise(1), S.severity_rank(F.col("severity")), "speaker", "speaker_b")
    return pairs.unionByName(missed).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= cap)


def scope(chapters: Column, focus: Column | int) -> Column:
    """Whether a row's chapters are the focus, others, or both."""
    here, other = F.array_contains(chapters, focus), F.exists(chapters, lambda c: c != focus)
    return F.when(here & other, "prior+focus").when(here, "focus").otherwise("prior — context only")


def collapsed(metrics: DataFrame, speaker: str) -> DataFrame:
    """Pairs of speakers who sound alike. The metrics are one row per speaker of a cast."""
    a, b = metrics.select(*[F.col(c).alias(f"a_{c}") for c in metrics.columns]), metrics.select(*[F.col(c).alias(f"b_{c}") for c in metrics.columns])
    near = lambda c, d: F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) <= d
    on = (F.col(f"a_{speaker}") < F.col(f"b_{speaker}")) & near("avg_words", 2.0) & near("contraction_rate", 0.1) & near("fragment_rate", 0.1)
    return a.join(b, on).select(F.col(f"a_{speaker}").alias("a"), F.col(f"b_{speaker}").alias("b"))


def cue_misses(metrics: DataFrame, cards: DataFrame, speaker: str) -> DataFrame:
    """What a card's cues promise and the lines do not keep, for speakers of four lines or more. Without cards the
    metrics hold the column dialogue_voice themselves."""
    if cards is not None:
        metrics = metrics.join(cards.select(F.col("slug").alias(speaker), "dialogue_voice"), speaker)
    rows = metrics.filter("line_count >= 4").withColumn("families", cue_families(F.col("dialogue_voice")))
    has = lambda f: F.array_contains("families", f)
    misses = {
        "terse": (has("terse") | has("monotone")) & (F.col("avg_words") >= 12),
        "formal": has("formal") & (F.col("contraction_rate") >= 0.35),
        "colloquial": has("colloquial") & (F.col("contraction_rate") <= 0.05),
        "fragmentary": has("fragmentary") & (F.col("fragment_rate") <= 0.05) & (F.col("interruption_rate") <= 0.05),
        "sermon": has("sermon") & ((F.col("avg_words") <= 4) | (F.col("contraction_rate") >= 0.4)),
    }
    found = F.array_compact(F.array(*[F.when(c, k) for k, c in misses.items()]))
    rows = rows.withColumn("misses", found).filter(F.size("misses") > 0)
    return rows.select(*(["manuscript", "quote", "chapters"] if cards is None else []), speaker, "misses", F.when(F.size("misses") >= 2, "high").otherwise("moderate").alias("severity"))
