"""Rare and common words that come too often."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamplight.functions import lexicons as L
from lamplight.functions import scalars as S

RARE_BELOW, CHAPTER_CAP, MERGED_CAP = 4.0, 12, 40


def scenes(text: Column) -> Column:
    """Parts of a text between rules, or else between blank lines; blank parts go."""
    house, loose, blank = F.split(text, "\n\n---\n\n"), F.split(text, r"\n---\n"), F.split(text, r"\n\s*\n")
    parts = F.when(F.contains(text, F.lit("\n\n---\n\n")), house).when(F.size(loose) > 1, loose).otherwise(blank)
    return F.filter(parts, lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")) != "")


def tokens(texts: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """T11 with W05: keys, pos, tok, what stands before it (sep) and the next token."""
    found = F.regexp_extract_all(content, F.lit(f"({S.TOKEN})"), F.lit(1))
    held = texts.select(*keys, found.alias("_t"), F.split(content, S.TOKEN).alias("_s"))
    rows = F.transform("_t", lambda t, i: F.struct(t.alias("tok"), F.get("_s", i).alias("sep"), F.get("_t", i + 1).alias("nxt")))
    return held.select(*keys, F.posexplode(rows).alias("pos", "x")).select(*keys, "pos", "x.tok", "x.sep", "x.nxt")


def _proper(c: Column) -> Column:
    return c.rlike("^[A-Z]") & (c != F.upper(c))


def content_hits(toks: DataFrame) -> DataFrame:
    """tokens without names: a capitalised word (not all capitals) inside a sentence, or before another, goes."""
    before = F.rtrim(F.regexp_replace("sep", r"\s+$", ""))
    inside = F.when(before == "", F.col("pos") > 0).otherwise(~F.right(before, F.lit(1)).isin(".", "!", "?"))
    name = _proper(F.col("tok")) & (inside | F.coalesce(_proper(F.col("nxt")), F.lit(False)))
    return toks.filter(~name).withColumn("lemma", S.lemma(F.col("tok")))


def lemma_counts(hits: DataFrame, keys: list[str]) -> DataFrame:
    """keys, lemma, count: what lexicon and carpets are made of; texts are read once for both."""
    return hits.groupBy(*keys, "lemma").agg(F.count(F.lit(1)).alias("count"))


def lexicon(counts: DataFrame) -> DataFrame:
    """A Zipf lexicon of a corpus, from the counts of its lemmas: log10 of occurrences in a thousand million."""
    sums = counts.groupBy("lemma").agg(F.sum("count").alias("n"))
    total = counts.agg(F.sum("count").alias("total"))
    return sums.join(F.broadcast(total)).select("lemma", F.round(F.log10(F.col("n") * 1e9 / F.col("total")), 6).alias("zipf"))


def uncommon(lex: DataFrame, common: list[str] | None = None, below: float = RARE_BELOW) -> DataFrame:
    """The lemmas of three letters or more that the lexicon knows as rare and that are not common English
    (a list; the closed lists of the lexicons where none is given). What the lexicon does not know is not rare."""
    common = L.common_words() if common is None else common
    return lex.filter((F.col("zipf") < below) & (F.length("lemma") >= 3) & ~F.col("lemma").isin(list(common) or [""])).select("lemma")


def rare_rows(hits: DataFrame, rare: DataFrame, keys: list[str]) -> DataFrame:
    """A06 (keys with a scene) and A07 (without): rare lemmas that come twice or more: count, foothold, the later
    surfaces in order. The lexicon is as large as the vocabulary, so the join is by key, with partial sums first."""
    found = hits.join(rare, "lemma", "left_semi")
    rows = found.groupBy(*keys, "lemma").agg(F.count(F.lit(1)).alias("count"), F.array_sort(F.collect_list(F.struct("pos", "tok"))).alias("_l")).filter("count >= 2")
    return rows.select(
        *keys,
        "lemma",
        "count",
        F.col("_l")[0]["tok"].alias("foothold"),
        F.array_distinct(F.transform(F.filter("_l", lambda x, i: i > 0), lambda x: x["tok"])).alias("later"),
        S.severity(F.col("count")).alias("severity"),
    )


def capped(rows: DataFrame, keys: list[str], order: list, cap: int) -> DataFrame:
    """The first `cap` rows of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") <= cap).drop("_n")


def common_words(counts: DataFrame, rare: DataFrame, keys: list[str], load_bearing: list[str] = ()) -> DataFrame:
    """A09 with J02, M02, M03, from lemma_counts."""
    exempt = sorted({*L.EXEMPT_WORDS, *L.SI_UNITS, *L.SAID_FAMILY, *L.fancy_tags()})
    words = counts.groupBy(*keys).agg(F.sum("count").alias("words"))
    kept = counts.filter((F.length("lemma") >= 3) & (F.col("count") >= 4) & ~F.col("lemma").isin(exempt)).join(rare, "lemma", "left_anti").join(words, keys)
    over = S.over_threshold(F.col("count"), F.col("words"), F.col("lemma").isin(list(load_bearing) or [""]))
    return kept.filter(over).select(*keys, "lemma", "count", S.severity(F.col("count"), 8, 6).alias("severity"))


def content_tokens(toks: DataFrame) -> DataFrame:
    """Tokens with their normalised form; those that have none go."""
    return toks.withColumn("norm", S.norm_token(F.col("tok"))).filter("norm <> ''")


def procedural(columns: list[str]) -> Column:
    """a phrase of numbers and units: a number or a unit first and a unit last, or nothing but these."""
    units = [*L.SI_UNITS, "pace", "paces"]
    shaped = [F.col(c).isin([*L.NUMBER_WORDS, *units]) for c in columns]
    return (F.col(columns[-1]).isin(units) & shaped[0]) | F.forall(F.array(*shaped), lambda x: x)


def phrases(toks: DataFrame, keys: list[str]) -> DataFrame:
    """Two and three neighbouring normalised tokens, at most two characters apart and in one sentence."""
    w = Window.partitionBy(*keys).orderBy("pos")
    near = lambda k: (F.length(F.lead("sep", k).over(w)) <= 2) & ~F.lead("sep", k).over(w).rlike("[.!?]")
    rows = toks.withColumn("norm", S.norm_token(F.col("tok")))
    rows = rows.withColumns({"n2": F.lead("norm", 1).over(w), "n3": F.lead("norm", 2).over(w), "near2": near(1), "near3": near(2)})
    good = lambda c: (F.length(c) >= 3) & ~F.col(c).isin(L.STOP_WORDS)
    two = rows.filter(F.col("near2") & good("norm") & good("n2") & ~procedural(["norm", "n2"])).select(*keys, "pos", "tok", F.concat_ws(" ", "norm", "n2").alias("phrase"))
    three = rows.filter(F.col("near2") & F.col("near3") & good("norm") & good("n2") & good("n3") & ~procedural(["norm", "n2", "n3"]))
    return two.unionByName(three.select(*keys, "pos", "tok", F.concat_ws(" ", "norm", "n2", "n3").alias("phrase")))


def phrase_rows(grams: DataFrame, keys: list[str]) -> DataFrame:
    """Phrases that come twice or more, with their first surface."""
    rows = grams.groupBy(*keys, "phrase").agg(F.count(F.lit(1)).alias("count"), F.min_by("tok", "pos").alias("first_surface")).filter("count >= 2")
    return rows.withColumn("severity", S.severity(F.col("count")))


def cross_chapter(within: DataFrame, chapter: DataFrame) -> DataFrame:
    """A08 over J04: of a lemma's rows in a chapter the scene's is preferred, else the larger; lemmas in two
    chapters or more are summed, with the densest chapter."""
    both = within.select("manuscript", "chapter_number", "lemma", "count", F.lit(0).alias("kind")).unionByName(
        chapter.select("manuscript", "chapter_number", "lemma", "count", F.lit(1).alias("kind"))
    )
    one = both.groupBy("manuscript", "chapter_number", "lemma").agg(F.min_by("count", F.struct("kind", -F.col("count"))).alias("count"), F.min("kind").alias("kind"))
    rolled = one.groupBy("manuscript", "lemma").agg(
        F.sum("count").alias("count"),
        F.sort_array(F.collect_set("chapter_number")).alias("chapters"),
        F.min_by("chapter_number", F.struct(-F.col("count"), "kind", "chapter_number")).alias("densest"),
        F.count("chapter_number").alias("_in"),
    )
    return rolled.filter("_in >= 2").drop("_in").withColumn("severity", S.severity(F.col("count")))


def merged(rows: DataFrame, cap: int = MERGED_CAP) -> DataFrame:
    """The first `cap` rows by severity, kind, count and key, of which a quarter are kept for cross-chapter
    rows as far as there are any. Both kinds are cut to the cap first; ranks come from windows over these."""
    order = [S.severity_rank(F.col("severity")), "kind_rank", F.desc("count"), "key"]
    seats = max(1, cap // 4)
    cross = F.col("kind").eqNullSafe("cross_chapter")
    top = rows.filter(cross).orderBy(*order).limit(cap).unionByName(rows.filter(~cross).orderBy(*order).limit(cap)).withColumn("is_cross", cross)
    mine = top.withColumn("_r", F.row_number().over(Window.partitionBy("is_cross").orderBy(*order)))
    kept = mine.withColumn("_first", F.when(F.col("is_cross") & (F.col("_r") <= seats), 0).otherwise(1))
    picked = kept.withColumn("_seat", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_first", *order))).filter(F.col("_seat") <= cap)
    return picked.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))).drop("_r", "_first", "_seat", "is_cross")
