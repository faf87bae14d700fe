"""Paragraphs, turns, volleys and dialogue shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamplight.functions import scalars as S

SHORT, LONG, BREAK = 12, 40, 30


def without_front_matter(text):
    """A text that starts with --- loses all up to and with the line of the next ---."""
    closing = F.position(F.lit("\n---"), text)
    rest = F.substring(text, closing + 4, F.length(text))
    line_end = F.position(F.lit("\n"), rest)
    body = F.when(line_end > 0, F.substring(rest, line_end + 1, F.length(rest))).otherwise("")
    return F.when(text.startswith("---") & (closing > 0), body).otherwise(text)


def paragraphs(texts: DataFrame, key: str, content: str = "content") -> DataFrame:
    """Key, para_no (from 0), para. Blank lines part paragraphs; headings and rules are dropped."""
    body = without_front_matter(F.replace(F.col(content), F.lit("\r\n"), F.lit("\n")))
    parts = F.transform(F.split(body, r"\n\s*\n"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")))
    kept = F.filter(parts, lambda p: (p != "") & ~p.startswith("#") & ~p.rlike(r"^[*\-_ ]+$"))
    return texts.select(key, F.posexplode(kept).alias("para_no", "para"))


def turns(paras: DataFrame) -> DataFrame:
    """T16 with T13: spoken (null for narration), spoken_words and words of each paragraph."""
    spans = F.regexp_extract_all("para", F.lit('["“]([^"“”]*)["”]?'), F.lit(1))
    said = F.filter(F.transform(spans, lambda s: F.trim(s)), lambda s: s != "")
    spoken = F.when(F.size(said) > 0, F.array_join(said, " "))
    return paras.withColumn("spoken", spoken).withColumns(
        {"spoken_words": F.regexp_count("spoken", F.lit(S.SPOKEN_WORD)), "words": F.regexp_count("para", F.lit(S.SPOKEN_WORD))}
    )


def volleys(turned: DataFrame, key: str) -> DataFrame:
    """Runs of turns of at most SHORT words. A longer turn, or narration of more than BREAK words, ends one."""
    order = Window.partitionBy(key).orderBy("para_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = F.when(F.col("spoken").isNull(), F.col("words") > BREAK).otherwise(F.col("spoken_words") > SHORT)
    runs = turned.withColumn("run", F.sum(ends.cast("long")).over(order)).filter(F.col("spoken").isNotNull() & (F.col("spoken_words") <= SHORT))
    return runs.groupBy(key, "run").agg(F.count(F.lit(1)).alias("turns"), F.min("para_no").alias("start_paragraph")).drop("run")


def exchange_pairs(turned: DataFrame, key: str) -> DataFrame:
    """A turn and the one before, unless that ends in a question or more than BREAK words of narration
    lie between."""
    order = Window.partitionBy(key).orderBy("para_no")
    told = F.sum(F.when(F.col("spoken").isNull(), F.col("words")).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    said = turned.withColumn("told", told).filter("spoken IS NOT NULL")
    said = said.withColumns({"prev": F.lag("spoken").over(order), "gap": F.col("told") - F.lag("told").over(order)})
    return said.filter(F.col("prev").isNotNull() & ~F.rtrim("prev").endswith("?") & (F.col("gap") <= BREAK)).select(key, "para_no", "prev", "spoken", "gap")


def shape(turned: DataFrame, key: str) -> DataFrame:
    """One row per text."""
    marks = S.hesitations(F.col("spoken"))
    said = F.col("spoken").isNotNull()
    any_mark = F.coalesce(marks["broken_off"] | marks["trailing_off"] | marks["filler"] | marks["hedge"] | marks["restart"], F.lit(False))
    stats = turned.groupBy(key).agg(
        F.count_if(said).alias("turns"),
        F.sum("words").alias("words"),
        F.coalesce(F.sum("spoken_words"), F.lit(0)).alias("spoken_words"),
        F.count_if(F.col("spoken_words") <= SHORT).alias("short_turns"),
        F.count_if(F.col("spoken_words") >= LONG).alias("long_turns"),
        F.coalesce(F.max("spoken_words"), F.lit(0)).alias("longest_turn"),
        F.count_if(said & any_mark).alias("hesitant_turns"),
        *[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in marks.items()],
    )
    share = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)), 3)
    return stats.withColumns(
        {
            "dialogue_share": share("spoken_words", "words"),
            "short_share": share("short_turns", "turns"),
            "long_share": share("long_turns", "turns"),
            "hesitant_share": share("hesitant_turns", "turns"),
        }
    )


def book_totals(stats: DataFrame) -> DataFrame:
    """Turn-weighted means of the shares and the largest of the maxima."""
    mean = lambda c: F.round(F.try_divide(F.sum(F.col(c) * F.col("turns")), F.sum("turns")), 3).alias(c)
    return stats.agg(F.sum("turns").alias("turns"), F.sum("words").alias("words"), mean("short_share"), mean("long_share"), F.max("longest_turn").alias("longest_turn"))


def findings(stats: DataFrame, runs: DataFrame, key: str) -> DataFrame:
    """Q07 with O10's rank: volleys, no_long_speech and fluent_speech rows."""
    starved = F.col("long_share") < 0.03
    severe = F.when(starved, F.when(F.col("n") >= 16, "high").otherwise("moderate")).otherwise("low")
    volley = (
        runs.filter("turns >= 10").select(key, F.col("turns").alias("n"), "start_paragraph").join(stats.select(key, "long_share"), key)
        .select(key, F.lit("volley").alias("kind"), severe.alias("severity"), F.col("n").alias("turns"), (F.col("start_paragraph") + 1).alias("start_paragraph"), F.col("n").cast("double").alias("metric"))
    )
    spoken = stats.filter("turns >= 25")
    silent = spoken.filter(F.col("longest_turn") < LONG).select(
        key, F.lit("no_long_speech").alias("kind"), F.lit("moderate").alias("severity"), "turns", F.lit(None).cast("int").alias("start_paragraph"), F.col("longest_turn").cast("double").alias("metric")
    )
    fluent = spoken.filter("hesitant_share < 0.05").select(
        key, F.lit("fluent_speech").alias("kind"), F.when(F.col("hesitant_share") < 0.02, "high").otherwise("moderate").alias("severity"), "turns",
        F.lit(None).cast("int").alias("start_paragraph"), F.col("hesitant_share").alias("metric"),
    )
    return volley.unionByName(silent).unionByName(fluent)
