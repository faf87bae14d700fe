"""Index and retrieval, summaries of chapters, acts and books."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamplight.functions import scalars as S
from lamplight.operators import chunks, vectors


def embed(text: Column, embedder=None) -> Column:
    """The vector of a text by a given embedder, or by the stub."""
    return (embedder or S.stub_embedding)(text)


def indexed(chapters: DataFrame, embedder=None) -> DataFrame:
    """Manuscript, chapter_number, chunk_index, vec_id, text, embedding: overlapping chunks with their vectors."""
    made = chunks.chunked(chapters, ["manuscript", "chapter_number"]).withColumnRenamed("chunk", "text")
    number = F.xxhash64("manuscript", "chapter_number", "chunk_index")
    return made.select("manuscript", "chapter_number", "chunk_index", number.alias("vec_id"), "text", embed(F.col("text"), embedder).cast("array<double>").alias("embedding"))


def stamp(chapters: DataFrame, model: str) -> DataFrame:
    """One hash of the embedder's name and of all chapters' contents in order. Only hashes meet in one row."""
    each = chapters.select("manuscript", F.col("chapter_number").alias("n"), F.sha2("content", 256).alias("sha"))
    held = each.groupBy("manuscript").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "sha"))), lambda x: F.concat(x["n"].cast("string"), F.lit(":"), x["sha"])), "\n"), 256).alias("sha"))
    return held.select("manuscript", F.sha2(F.concat(F.lit(model + "\n"), "sha"), 256).alias("stamp"))


def ensure_index(spark: SparkSession, chapters: DataFrame, path: str, model: str = "stub", embedder=None) -> bool:
    """Write the index of the books anew unless the stamps beside it are the same; whether it was written."""
    now = stamp(chapters, model)
    try:
        old = spark.read.parquet(f"{path}/stamp")
        if old.exceptAll(now).isEmpty() and now.exceptAll(old).isEmpty():
            return False
    except Exception as error:  # no index yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
    indexed(chapters, embedder).write.mode("overwrite").parquet(f"{path}/chunks")
    now.write.mode("overwrite").parquet(f"{path}/stamp")
    return True


def retrieve(questions: DataFrame, index: DataFrame, k: int = 5, embedder=None) -> DataFrame:
    """q_id, rank, manuscript, chapter_number, text: the k nearest chunks of each question (q_id, question)."""
    asked = questions.select(F.col("q_id").alias("vec_id"), embed(F.col("question"), embedder).cast("array<double>").alias("embedding"))
    near = vectors.nearest(index.select("vec_id", "embedding"), asked, k)
    return near.join(index.select("vec_id", "manuscript", "chapter_number", "text"), "vec_id").select("q_id", "rank", "manuscript", "chapter_number", "text")


def context(found: DataFrame, summaries: DataFrame | None = None, findings: DataFrame | None = None) -> DataFrame:
    """q_id, context: what retrieve() found, then summaries (q_id, rank, level, title, summary), then at most ten
    findings (q_id, rank, severity, dimension, summary), as text."""
    parts = found.select("q_id", F.lit(0).alias("s"), "rank", F.concat(F.lit("[Chapter "), F.col("chapter_number").cast("string"), F.lit("]\n"), "text").alias("part"))
    if summaries is not None:
        parts = parts.unionByName(summaries.select("q_id", F.lit(1).alias("s"), "rank", F.concat(F.lit("["), "level", F.lit(" — "), "title", F.lit("]\n"), "summary").alias("part")))
    if findings is not None:
        line = F.concat(F.lit("#"), F.col("rank").cast("string"), F.lit(" ["), "severity", F.lit("] "), "dimension", F.lit(": "), "summary")
        told = findings.filter("rank <= 10").groupBy("q_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))), lambda x: x["l"]), "\n").alias("l"))
        parts = parts.unionByName(told.select("q_id", F.lit(2).alias("s"), F.lit(1).alias("rank"), F.concat(F.lit("[Prior Analysis — Prioritized Findings]\n"), "l").alias("part")))
    return parts.groupBy("q_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s", "rank", "part"))), lambda x: x["part"]), "\n\n").alias("context"))


def acts(chapters: DataFrame, sizes: DataFrame | None = None, per_act: int = 5) -> DataFrame:
    """Manuscript, chapter_number, act. By groups of per_act chapters; or by the sizes of the acts of a manuscript
    (manuscript, act_no, used, budget): those used, or where none is, those budgeted, in order; chapters past the last
    act belong to it."""
    order = Window.partitionBy("manuscript").orderBy("chapter_number")
    rows = chapters.select("manuscript", "chapter_number").distinct().withColumn("i", F.row_number().over(order))
    plain = F.floor((F.col("i") - 1) / per_act) + 1
    if sizes is None:
        return rows.select("manuscript", "chapter_number", plain.cast("int").alias("act"))
    any_used = F.max(F.coalesce("used", F.lit(0))).over(Window.partitionBy("manuscript")) > 0
    size = F.greatest(F.lit(0), F.coalesce(F.when(any_used, F.col("used")).otherwise(F.col("budget")), F.lit(0)))
    held = sizes.withColumn("size", size).filter("size > 0")
    ends = held.withColumn("last", F.sum("size").over(Window.partitionBy("manuscript").orderBy("act_no"))).withColumn("act", F.row_number().over(Window.partitionBy("manuscript").orderBy("act_no")))
    lists = ends.groupBy("manuscript").agg(F.array_sort(F.collect_list(F.struct("act", "last"))).alias("acts"))
    reach = F.filter("acts", lambda a: a["last"] >= F.col("i"))
    found = F.when(F.size(reach) > 0, F.get(reach, F.lit(0))["act"]).otherwise(F.element_at("acts", -1)["act"])
    return rows.join(lists, "manuscript", "left").select("manuscript", "chapter_number", F.coalesce(F.when(F.col("acts").isNotNull(), found), plain).cast("int").alias("act"))


def first_sentence(text: Column) -> Column:
    """The stub summariser: a text's first sentence, 300 characters at most."""
    return F.left(F.regexp_extract(F.trim(text), r"^(?s)(.*?[.!?])(\s|$)", 1), F.lit(300))


def hierarchy(chapters: DataFrame, sizes: DataFrame | None = None, summarise=first_sentence) -> DataFrame:
    """Manuscript, level (chapter, act, global), n, sha (key of what was summarised), summary: a chapter from its
    text, an act from its chapters' summaries, a book from its acts'."""
    one = chapters.select("manuscript", "chapter_number", F.sha2("content", 256).alias("sha"), summarise(F.col("content")).alias("summary"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(c, "summary"))), lambda x: x["summary"]), "\n")
    act = one.join(acts(chapters, sizes), ["manuscript", "chapter_number"]).groupBy("manuscript", "act").agg(joined("chapter_number").alias("text")).select("manuscript", "act", F.sha2("text", 256).alias("sha"), summarise(F.col("text")).alias("summary"))
    book = act.groupBy("manuscript").agg(joined("act").alias("text")).select("manuscript", F.lit("global").alias("level"), F.lit(1).alias("n"), F.sha2("text", 256).alias("sha"), summarise(F.col("text")).alias("summary"))
    rows = one.select("manuscript", F.lit("chapter").alias("level"), F.col("chapter_number").alias("n"), "sha", "summary").unionByName(act.select("manuscript", F.lit("act").alias("level"), F.col("act").alias("n"), "sha", "summary"))
    return rows.unionByName(book)
