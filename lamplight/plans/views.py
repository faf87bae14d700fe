"""Derived inputs over the driver's tables, each as a DataFrame and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chapter_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, manuscript, chapter_number: chapters() without their texts."""
    number = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return table(spark, sf_dir, "documents").select("source", "doc_id").select("doc_id", F.col("source").alias("manuscript"), number.alias("chapter_number"))


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """manuscript, chapter_number, doc_id, title, content: a source's documents by doc_id. Only ids are numbered
    in the window; the texts join by id."""
    docs = table(spark, sf_dir, "documents")
    number = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    numbers = docs.select("source", "doc_id").select("doc_id", number.alias("chapter_number"))
    return docs.join(numbers, "doc_id").select(F.col("source").alias("manuscript"), "chapter_number", "doc_id", F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("content"))


CHAPTERS = """chapters AS (SELECT source AS manuscript, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INTEGER) AS chapter_number,
    doc_id, split_part(text, chr(10), 1) AS title, text AS content FROM documents)"""


def dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, content: conversations told as prose, with quotes, attribution and narration."""
    turns = table(spark, sf_dir, "conversations")
    lines = turns.select("conv_id", "turn", "role", F.posexplode(F.split(F.replace("text", F.lit(". "), F.lit(".\n")), "\n")).alias("i", "line"))
    lines = lines.withColumn("i", F.col("i") + 1).withColumn("line", F.trim("line")).filter("line <> ''")
    tag = F.element_at(F.array(*map(F.lit, ["said", "muttered", "whispered", "asked quietly", "replied"])), ((F.col("turn") + F.col("i")) % 5 + 1).cast("int"))
    prefix = F.when((F.col("turn") * 7 + F.col("i")) % 9 == 0, "Maybe ").when((F.col("turn") * 7 + F.col("i")) % 11 == 0, "Well... ").otherwise("")
    para = F.when(F.col("role") == "system", F.col("line")).otherwise(F.concat(F.lit('"'), prefix, "line", F.lit('" '), F.initcap("role"), F.lit(" "), tag, F.lit(".")))
    told = lines.select("conv_id", F.struct("turn", "i", para.alias("para")).alias("p"))
    return told.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["para"]), "\n\n").alias("content"))


DIALOGUE = """lines AS (SELECT conv_id, turn, role, unnest(l) AS line0, generate_subscripts(l, 1) AS i
      FROM (SELECT *, string_split(replace(text, '. ', '.' || chr(10)), chr(10)) AS l FROM conversations)),
    paras AS (SELECT conv_id, turn, i, CASE WHEN role = 'system' THEN trim(line0) ELSE
        '"' || CASE WHEN (turn * 7 + i) % 9 = 0 THEN 'Maybe ' WHEN (turn * 7 + i) % 11 = 0 THEN 'Well... ' ELSE '' END || trim(line0) || '" '
        || upper(role[1]) || role[2:] || ' ' || (['said', 'muttered', 'whispered', 'asked quietly', 'replied'])[(turn + i) % 5 + 1] || '.' END AS para
      FROM lines WHERE trim(line0) <> ''),
    dialogue AS (SELECT conv_id, string_agg(para, chr(10) || chr(10) ORDER BY turn, i) AS content FROM paras GROUP BY conv_id)"""
