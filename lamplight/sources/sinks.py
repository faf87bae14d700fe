"""Reports and tables written out."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def as_json(rows: DataFrame, version: str, *keys: str) -> DataFrame:
    """One JSON document per key, with a contract version and a rows array that is always present."""
    body = F.struct(*[c for c in rows.columns if c not in keys])
    held = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(body)).alias("rows"))
    return held.select(*keys, F.to_json(F.struct(F.lit(version).alias("contract_version"), *keys, "rows")).alias("document"))


def as_markdown(rows: DataFrame, key: str, line: Column, order: str, shown: int = 30) -> DataFrame:
    """A section per key with at most `shown` lines, and how many more there are."""
    held = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order), line.alias("line")))).alias("l"))
    lines = F.transform(F.slice("l", 1, shown), lambda x: F.concat(F.lit("- "), x["line"]))
    more = F.when(F.size("l") > shown, F.array(F.concat(F.lit("… "), (F.size("l") - shown).cast("string"), F.lit(" more")))).otherwise(F.array().cast("array<string>"))
    return held.select(key, F.array_join(F.concat(F.array(F.concat(F.lit("## "), F.col(key).cast("string"))), lines, more), "\n").alias("section"))


def replace_table(rows: DataFrame, path: str) -> None:
    """Drop and write anew."""
    rows.write.mode("overwrite").parquet(path)


def by_dimension(findings: DataFrame, key: str) -> DataFrame:
    """Key, prefix (what stands before the dimension's first dot), findings in order of rank."""
    held = findings.groupBy(key, F.split_part("dimension", F.lit("."), F.lit(1)).alias("prefix")).agg(F.array_sort(F.collect_list(F.struct("rank", "dimension", "summary"))).alias("l"))
    return held.select(key, "prefix", F.transform("l", lambda x: F.struct(x["rank"].alias("rank"), x["summary"].alias("summary"))).alias("findings"))


def brief(findings: DataFrame, key: str, bands: list[str], shown: int = 30) -> DataFrame:
    """Key, brief: a section for each band of findings (band, rank, dimension, summary) in the order of the bands, with
    how many more there are; a band without findings says so."""
    line = F.concat(F.lit("- **"), "dimension", F.lit("**: "), "summary")
    held = findings.groupBy(key, "band").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("l"))
    every = findings.select(key).distinct().select(key, F.posexplode(F.array(*map(F.lit, bands))).alias("i", "band")).join(held, [key, "band"], "left")
    lines = F.array_join(F.transform(F.slice("l", 1, shown), lambda x: x["line"]), "\n")
    more = F.when(F.size("l") > shown, F.concat(F.lit("\n… "), (F.size("l") - shown).cast("string"), F.lit(" more"))).otherwise("")
    section = F.concat(F.lit("## "), "band", F.lit("\n"), F.coalesce(F.concat(lines, more), F.lit("(none)")))
    return every.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", section.alias("s")))), lambda x: x["s"]), "\n\n").alias("brief"))


def save_document(document: DataFrame, path: str) -> None:
    """Whole documents (key, document) as JSON text, written anew."""
    document.write.mode("overwrite").json(path)


def load_document(spark: SparkSession, path: str) -> DataFrame | None:
    """What was saved, or None where nothing was; rows without a document are passed over."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.schema("key string, document string").json(path).filter("document IS NOT NULL")


def free_name(spark: SparkSession, folder: str, day: str) -> str:
    """Report-DAY.md, or the first of report-DAY-2.md, report-DAY-3.md ... that is not there."""
    jvm = spark.sparkContext._jvm
    for k in itertools.count(1):
        name = f"report-{day}.md" if k == 1 else f"report-{day}-{k}.md"
        at = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return name
    raise AssertionError


def terminal(rows: DataFrame, title: str, n: int = 30) -> str:
    """The first n rows as a table of text."""
    return f"{title}\n{rows._jdf.showString(n, 60, False)}"
