"""Findings: citing, partition, ranking, ratings, dedupe and comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_of(severity: Column) -> Column:
    return F.when(severity == "concern", 0).when(severity == "neutral", 1).otherwise(2)


def prioritized(findings: DataFrame, key: str) -> DataFrame:
    """By severity, certainty and dimension; ranks from 1."""
    w = Window.partitionBy(key).orderBy(rank_of(F.col("severity")), F.desc("certainty"), "dimension", "finding_id")
    return findings.withColumn("rank", F.row_number().over(w))


def severity_counts(findings: DataFrame, key: str) -> DataFrame:
    """A18."""
    return findings.groupBy(key).agg(F.count_if(F.col("severity") == "strength").alias("strengths"), F.count_if(F.col("severity") == "concern").alias("concerns"), F.count(F.lit(1)).alias("total"))


def ratings(findings: DataFrame, dims: DataFrame) -> DataFrame:
    """A dimension's first finding by severity and place; neutral without any."""
    first = findings.groupBy("dimension").agg(F.min_by("severity", F.struct(rank_of(F.col("severity")), "finding_id")).alias("severity"))
    return dims.join(first, "dimension", "left").select("dimension", F.coalesce("severity", F.lit("neutral")).alias("severity"))


def involves(chapter: int) -> Column:
    return F.array_contains("cited", chapter)


def two_quotes() -> Column:
    """Evidence and counter evidence that are not the same words."""
    x, y = (F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))) for c in ("evidence", "counter_evidence"))
    return (x != "") & (y != "") & (x != y)


def partitioned(findings: DataFrame, now: int, gate: list[str], sweep: bool = False) -> DataFrame:
    """Q11: every concern of a gate dimension in one bucket. Concerns whose quotes were not found never gate; a sweep asks
    for two quotes and a cited chapter; else those of earlier chapters alone are older, and those that cite the chapter,
    with two quotes, gate. findings: dimension, severity, quote_verified, cited, evidence, counter_evidence."""
    older = (F.size("cited") > 0) & F.forall("cited", lambda c: c < now)
    unfound = F.coalesce(~F.col("quote_verified"), F.lit(False))
    if sweep:
        bucket = F.when(~unfound & two_quotes() & (F.size("cited") >= 1), "gate").otherwise("ungrounded")
    else:
        bucket = F.when(older, "preexisting").when(~unfound & involves(now) & two_quotes(), "gate").otherwise("ungrounded")
    return findings.filter((F.col("severity") == "concern") & F.col("dimension").isin(gate)).withColumn("bucket", bucket)


def informed(findings: DataFrame, now: int, info: list[str]) -> DataFrame:
    """Concerns of the dimensions that only inform, and whether they are grounded in the chapter; older ones go."""
    older = (F.size("cited") > 0) & F.forall("cited", lambda c: c < now)
    rows = findings.filter((F.col("severity") == "concern") & F.col("dimension").isin(info) & ~older)
    return rows.withColumn("grounded", F.coalesce("quote_verified", F.lit(True)) & (F.trim(F.coalesce("evidence", F.lit(""))) != "") & involves(now))


def verdict(findings: DataFrame, key: str, drives: list[str] | None = None) -> DataFrame:
    """Watch if there is any concern of the dimensions that drive (all where none are named), and which these are."""
    concern = (F.col("severity") == "concern") & (F.col("dimension").isin(drives) if drives else F.lit(True))
    rows = findings.groupBy(key).agg(F.bool_or(concern).alias("w"), F.array_sort(F.collect_set(F.when(concern, F.col("dimension")))).alias("d"))
    return rows.select(key, F.when(F.col("w"), "watch").otherwise("ship").alias("verdict"), F.array_join("d", ",").alias("drivers"))


def grounded_ratings(findings: DataFrame, dims: list[str], now: int, key: str) -> DataFrame:
    """A rating for each dimension: the first severity, but neutral where it is a concern that nothing grounds: evidence
    that cites the chapter."""
    rows = findings.filter(F.col("dimension").isin(dims))
    concern = F.col("severity") == "concern"
    first = rows.groupBy(key, "dimension").agg(F.min_by("severity", "finding_id").alias("severity"), F.bool_or(concern).alias("concern"), F.bool_or(concern & involves(now) & (F.trim(F.coalesce("evidence", F.lit(""))) != "")).alias("grounded"))
    every = findings.select(key).distinct().select(key, F.explode(F.array(*map(F.lit, dims))).alias("dimension"))
    rating = F.when(F.col("concern") & ~F.col("grounded"), "neutral").otherwise(F.coalesce("severity", F.lit("neutral")))
    return every.join(first, [key, "dimension"], "left").select(key, "dimension", rating.alias("severity"))


def hit_weights(known: DataFrame, findings: DataFrame, focused: bool = False) -> DataFrame:
    """Story, chapter_number, weight: one for each known chapter, two more for each time a summary names it, and five
    times that, once, where a reference does and the pass is focused."""
    number = lambda c: F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(\d+)"), F.lit(1)), lambda x: F.try_to_number(x, F.lit("999999999")).cast("int"))
    named = findings.select("story", F.explode(number("summary")).alias("chapter_number")).groupBy("story", "chapter_number").agg(F.count(F.lit(1)).alias("n"))
    focus = findings.select("story", F.explode(number("chapter_ref")).alias("chapter_number")).distinct().withColumn("f", F.lit(focused))
    rows = known.select("story", "chapter_number").distinct().join(named, ["story", "chapter_number"], "left").join(focus, ["story", "chapter_number"], "left")
    return rows.select("story", "chapter_number", ((1.0 + 2.0 * F.coalesce("n", F.lit(0))) * F.when(F.coalesce("f", F.lit(False)), 5.0).otherwise(1.0)).alias("weight"))


def forms(answers: DataFrame, key: str) -> DataFrame:
    """How often each form of a return is used, its share of all answers, and whether it is a habit: a share of 0.02 or
    more, twice or more. answers: key, form (null for none)."""
    total = answers.groupBy(key).agg(F.count(F.lit(1)).alias("pairs"))
    rows = answers.filter("form IS NOT NULL").groupBy(key, "form").agg(F.count(F.lit(1)).alias("n")).join(total, key)
    share = F.round(F.col("n") / F.col("pairs"), 4)
    return rows.select(key, "form", "n", share.alias("share"), ((share >= 0.02) & (F.col("n") >= 2)).alias("habit"))


def quip_mix(labels: DataFrame, key: str) -> DataFrame:
    """Where four moments or more are comic and less than a quarter of them come from situation or character: high
    below a tenth, else moderate. labels: key, source (situation, character, quip, or none)."""
    comic = F.col("source").isin("situation", "character", "quip")
    rows = labels.groupBy(key).agg(F.count_if(comic).alias("comic"), F.count_if(F.col("source").isin("situation", "character")).alias("grown"))
    share = F.col("grown") / F.col("comic")
    return rows.filter((F.col("comic") >= 4) & (share < 0.25)).select(key, "comic", F.when(share < 0.1, "high").otherwise("moderate").alias("severity"))


def last_wins(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """A map merged over another: rows of the second replace those of the same keys."""
    return first.join(second.select(*keys).distinct(), keys, "left_anti").unionByName(second)


def warnings(lists: DataFrame, key: str) -> DataFrame:
    """A key's warnings from all lists (key, list_no, warnings), each once, in order of first sight."""
    rows = lists.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("list_no", "warnings"))).alias("l"))
    return rows.select(key, F.array_distinct(F.flatten(F.transform("l", lambda x: x["warnings"]))).alias("warnings"))


def usage(calls: DataFrame) -> DataFrame:
    """Calls and tokens by model, and overall (model null)."""
    return calls.rollup("model").agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens").alias("tokens"))


def merged_stats(stats: DataFrame, key: str) -> DataFrame:
    """All counters of a key's parts, summed."""
    return stats.groupBy(key).agg(*[F.sum(c).alias(c) for c in stats.columns if c not in (key, "agent")])


def scorecard(a: DataFrame, b: DataFrame, dims: DataFrame) -> DataFrame:
    """Both reports on every dimension, and the change of the score."""
    score = lambda c: F.when(F.col(c) == "strength", 1).when(F.col(c) == "concern", -1).otherwise(0)
    rows = dims.join(a.withColumnRenamed("severity", "a"), "dimension", "left").join(b.withColumnRenamed("severity", "b"), "dimension", "left")
    return rows.withColumn("delta", score("b") - score("a"))
