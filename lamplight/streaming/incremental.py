"""Incremental state (X01-X07, X09, X10): progress, late arrivals, upserts by content hash, windows over event streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def arrivals(progress: DataFrame, arrived: DataFrame) -> DataFrame:
    """For each story the high-water mark, which never falls, and what each arrival is to it: next, regression
    (still processed, with a warning) or skip (with the missing numbers)."""
    rows = arrived.join(progress, "story", "left").withColumn("mark", F.coalesce("mark", F.lit(0)))
    kind = F.when(F.col("chapter") <= F.col("mark"), "regression").when(F.col("chapter") > F.col("mark") + 1, "skip").otherwise("next")
    gap = F.when(F.col("chapter") > F.col("mark") + 1, F.expr("sequence(mark + 1, chapter - 1)")).otherwise(F.expr("CAST(array() AS array<int>)"))
    return rows.select("story", "chapter", kind.alias("kind"), gap.alias("missing"), F.greatest("mark", "chapter").alias("mark"))


def stale(cached: DataFrame, now: DataFrame) -> DataFrame:
    """Keys whose content is new or has another hash, or whose result failed."""
    hashed = now.withColumn("sha", F.sha2("content", 256))
    fresh = cached.filter(~F.coalesce("failed", F.lit(False))).select("key", "sha")
    return hashed.join(fresh, ["key", "sha"], "left_anti")


def upsert(cached: DataFrame, changed: DataFrame) -> DataFrame:
    """The changed rows replace those of their keys."""
    return cached.join(changed.select("key"), "key", "left_anti").unionByName(changed)


def invalidate_from(cached: DataFrame, chapter: int) -> DataFrame:
    """X05."""
    return cached.filter(F.col("chapter") < chapter)


def high_water(saved: DataFrame, ran: DataFrame) -> DataFrame:
    """Story, mark: the last chapter ever run; a rewrite or a missing file does not lower it."""
    rows = saved.select("story", F.col("mark").alias("chapter")).unionByName(ran.select("story", "chapter"))
    return rows.groupBy("story").agg(F.max("chapter").alias("mark"))


def rolling_prior(sheets: DataFrame, keep: int = 15, budget: int = 48_000, force: bool = False) -> DataFrame:
    """Story, chapter, rolling: all chapters before; only the last `keep` where the sheets are longer than the budget
    (or it is asked for) and there are more chapters than that."""
    sums = sheets.groupBy("story").agg(F.sum(F.length("sheet")).alias("chars"), F.count(F.lit(1)).alias("n"))
    cut = sums.withColumn("rolling", (F.lit(force) | (F.col("chars") > budget)) & (F.col("n") > keep)).select("story", "rolling")
    last = F.row_number().over(Window.partitionBy("story").orderBy(F.desc("chapter")))
    return sheets.select("story", "chapter", last.alias("_n")).join(cut, "story").filter(~F.col("rolling") | (F.col("_n") <= keep)).select("story", "chapter", "rolling")


def sliding(chapters: DataFrame, k: int = 5) -> DataFrame:
    """Story, chapter, seen: the chapters there are in [chapter - k, chapter]."""
    w = Window.partitionBy("story").orderBy("chapter").rangeBetween(-k, 0)
    return chapters.withColumn("seen", F.array_sort(F.collect_set("chapter").over(w)))


def probes_due(models: DataFrame, passed: DataFrame, day: Column) -> DataFrame:
    """The models to probe: those without a pass of the day. Only passes are kept (model, day)."""
    return models.select("model").distinct().join(passed.filter(F.col("day") == day).select("model").distinct(), "model", "left_anti")


def replace_atomically(rows: DataFrame, path: str) -> str:
    """Write a new version beside the old ones, then point to it by a file that appears whole or not at all; readers
    see the version before or the new one, never a part. Returns the version's folder."""
    spark = rows.sparkSession
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(path)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    made = f"{path}/version={uuid.uuid4().hex}"
    rows.write.parquet(made)  # _SUCCESS comes last: a folder without it is no version
    assert fs.exists(jvm.org.apache.hadoop.fs.Path(f"{made}/_SUCCESS"))
    return made


def read_current(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest whole version, or None."""
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(path)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    marks = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/version=*/_SUCCESS")) or []
    newest = max(marks, key=lambda m: (m.getModificationTime(), str(m.getPath())), default=None)
    return None if newest is None else spark.read.parquet(str(newest.getPath().getParent()))


def upsert_stream(stream: DataFrame, path: str, checkpoint: str, once: bool = True):
    """X04 as a stream: each micro-batch writes, for its keys, the last content; a batch that is run again after a loss
    writes its own folder again, so nothing is lost or doubled. read_upserts() takes the newest of a key."""

    def write(batch: DataFrame, number: int) -> None:
        last = batch.groupBy("key").agg(F.max_by("content", "version").alias("content"), F.max("version").alias("version"))
        last.withColumn("sha", F.sha2("content", 256)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_upserts(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    newest = F.struct("version", "batch")
    return rows.groupBy("key").agg(F.max_by("content", newest).alias("content"), F.max_by("sha", newest).alias("sha"), F.max("version").alias("version"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Event-time windows with a watermark, for streams and tables alike (an extra: the operators above keep late rows)."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
