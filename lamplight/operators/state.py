"""Versioned story state, audits and interval algebra."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def before(chapter: Column, n: int) -> Column:
    """Undated rows pass; dated ones must come before chapter n."""
    return chapter.isNull() | (chapter < n)


def cast_as_of(characters: DataFrame, n: int) -> DataFrame:
    """A death in chapter n or later is not known yet."""
    known = characters.filter(before(F.col("introduced"), n))
    dead = F.col("died").isNotNull() & (F.col("died") < n)
    return known.select("slug", F.when((F.col("status") == "dead") & ~dead, "active").otherwise(F.when(dead, "dead").otherwise(F.col("status"))).alias("status"))


def state_as_of(history: DataFrame, key: str, state: str, at: str, n: int) -> DataFrame:
    """The last state before n, one partial maximum per key."""
    return history.filter(F.col(at) < n).groupBy(key).agg(F.max_by(state, F.struct(at, "seq")).alias("state"), F.max(at).alias("since"))


def latest(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """The last value of each key, without a window: partial sums shrink hot keys before the shuffle."""
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value), F.max(order[0]).alias(order[0]))


def last_rows(rows: DataFrame, keys: list[str], order: list, k: int = 3) -> DataFrame:
    """The last k rows of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") <= k).drop("_n")


def open_seeds(seeds: DataFrame, n: int) -> DataFrame:
    """R05."""
    return seeds.filter((F.col("planted") < n) & (F.col("resolved").isNull() | (F.col("resolved") >= n)))


def temporal_issues(characters: DataFrame, seeds: DataFrame) -> DataFrame:
    """R06."""
    seen = characters.filter(F.col("died").isNotNull() & (F.col("last_seen") > F.col("died"))).select(F.lit("seen_after_death").alias("kind"), F.col("slug").alias("entity"))
    when = seeds.filter(F.col("resolved") == F.col("planted")).select(F.lit("seed_resolved_when_planted").alias("kind"), F.col("slug").alias("entity"))
    early = seeds.filter(F.col("resolved") < F.col("planted")).select(F.lit("seed_resolved_before_planted").alias("kind"), F.col("slug").alias("entity"))
    return seen.unionByName(when).unionByName(early)


def unrecorded(present: DataFrame, key: str, chapter: str, last: int) -> DataFrame:
    """The chapters 1..last that a key has no row for."""
    have = present.groupBy(key).agg(F.collect_set(chapter).alias("have"))  # at most `last` values
    gaps = F.array_except(F.sequence(F.lit(1), F.lit(last)), F.col("have"))
    return have.select(key, F.array_join(F.array_sort(gaps), ",").alias("missing")).filter("missing <> ''")


def vague_timeline(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Of three rows or more, three quarters or more hold the same value or none."""
    counts = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    found = counts.groupBy(key).agg(F.sum("n").alias("rows"), F.max(F.when(F.col(value).isNotNull(), F.col("n"))).alias("modal"), F.sum(F.when(F.col(value).isNull(), F.col("n")).otherwise(0)).alias("blank"))
    share = (F.coalesce("modal", F.lit(0)) + F.col("blank")) / F.col("rows")
    return found.filter(F.col("rows") >= 3).withColumn("share", F.round(share, 4)).filter(share >= 0.75)


def merge_intervals(rows: DataFrame, key: str) -> DataFrame:
    """Unions of [s, e) that overlap or touch."""
    order = Window.partitionBy(key).orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(reach.isNull() | (F.col("s") > F.col("_reach")), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    marked = rows.withColumn("_reach", reach)
    return marked.withColumn("_i", island).groupBy(key, "_i").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("_i")


def allocate(weights: DataFrame, key: str, item: str, weight: str, budget: int) -> DataFrame:
    """Whole shares of the budget by weight: floors, and what is left to the largest fractions."""
    all_ = Window.partitionBy(key)
    share = F.col(weight) * F.lit(float(budget)) / F.sum(weight).over(all_)
    rows = weights.withColumn("_x", share).withColumn("_f", F.floor("_x")).withColumn("_r", F.round(F.col("_x") - F.col("_f"), 9))
    rows = rows.withColumn("_left", F.lit(budget) - F.sum("_f").over(all_)).withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_r"), item)))
    return rows.select(key, item, (F.col("_f") + F.when(F.col("_n") <= F.col("_left"), 1).otherwise(0)).cast("long").alias("share"))


def running_budget(rows: DataFrame, key: str, order: list, size: str, ceiling: int) -> DataFrame:
    """Sizes taken in order until the ceiling."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("taken", F.greatest(F.lit(0), F.least(F.col(size), F.lit(ceiling) - (F.sum(size).over(w) - F.col(size)))).cast("long"))
