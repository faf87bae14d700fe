"""Chapters from Markdown files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """chapter_number, title, content, source_path of one .md file or of all in a folder.

    A file named chapter-NNN.md keeps its number; the others, by name, take the positive numbers that are free. Only
    names are numbered in one task, not texts; a folder's list of names is small.
    """
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.md")
    texts = files.select(F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.file_name").alias("file"), F.col("value").alias("content"))
    names = texts.select("source_path", "file", F.expr("try_cast(nullif(regexp_extract(file, '(?i)^chapter-([0-9]+)[.]md$', 1), '') AS INT)").alias("own"))
    own = F.collect_set("own").over(Window.partitionBy(F.lit(0)))
    count = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    free = F.array_sort(F.array_except(F.sequence(F.lit(1), (count + F.size(own)).cast("int")), own))
    nth = F.row_number().over(Window.partitionBy(F.col("own").isNull()).orderBy("file"))  # from 1
    numbers = names.withColumn("chapter_number", F.when(F.col("own").isNotNull(), F.col("own")).otherwise(F.get(free, nth - 1)))
    stem = F.regexp_replace("file", r"(?i)\.md$", "")
    title = F.coalesce(F.nullif(F.trim(F.regexp_extract("content", r"(?m)^\s*# (.*)$", 1)), F.lit("")), stem)
    return texts.join(numbers.select("source_path", "chapter_number"), "source_path").select("chapter_number", title.alias("title"), "content", "source_path")


def discover(chapters: DataFrame, upto: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The chapters up to a number (all without one), and the numbers missing from 1 to the last."""
    found = chapters if upto is None else chapters.filter(F.col("chapter_number") <= upto)
    last = found.agg(F.coalesce(F.max("chapter_number"), F.lit(0)).alias("last"))
    wanted = last.select(F.explode(F.expr("CASE WHEN last > 0 THEN sequence(1, last) ELSE array() END")).alias("chapter_number"))
    return found, wanted.join(found.select("chapter_number"), "chapter_number", "left_anti")


def read_story(spark: SparkSession, path: str) -> DataFrame:
    """chapter_number, content of the files chapter-*.md with a number in their name; of equal numbers the last by name.
    Bytes that are no UTF-8 are replaced."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "chapter-*.md").load(path)
    name = F.regexp_extract("path", r"([^/]+)\.md$", 1)
    rows = files.select(name.alias("name"), F.regexp_extract(name, r"(\d+)", 1).alias("n"), F.make_valid_utf8(F.col("content").cast("string")).alias("content")).filter("n <> ''")
    return rows.groupBy(F.col("n").cast("int").alias("chapter_number")).agg(F.max_by("content", "name").alias("content"))


def read_chapters(spark: SparkSession, path: str) -> DataFrame:
    """Chapters of an .epub file, of one .md file or of a folder of them; other files are an error."""
    from lamplight.sources import epub

    name = path.rstrip("/").rpartition("/")[2].lower()
    if name.endswith(".epub"):
        return epub.read_epub(spark, path)
    if "." in name and not name.endswith(".md"):
        raise ValueError(f"neither Markdown nor EPUB: {path}")
    return read_markdown(spark, path)
