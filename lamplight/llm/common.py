"""Shared pieces of the training-data operators: scratch tables, running sums, group joins."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamplight.functions.scratch import clear_scratch, cut, scratch_dir  # noqa: F401

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Most rows of a side that is broadcast behind a count.
BROADCAST_ROWS = 200_000


def counted(df: DataFrame) -> DataFrame:
    """A table of a few short columns, to be broadcast where its rows are counted to be few; else left to a shuffled join."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def running_sums(df: DataFrame, order: list[str], value: str, group: str | None = None) -> DataFrame:
    """Global running sums without a global sort in one task.

    Rows are range-partitioned by (group, *order); each partition's total is summed on its own, the few
    totals are prefix-summed, and a window inside each partition adds the rest. Adds `_before` (sum of value
    over the rows before this one, within the group) and `_row` (the row's number, from 0, within the group),
    and `_part`. Ties in the order may fall either way but are numbered once. The totals are one row per
    partition and group that meets it, so they are bounded by the number of partitions plus groups, and counted before
    they are broadcast.
    """
    spark = df.sparkSession
    keys = ([F.col(group).asc_nulls_last()] if group else []) + [F.col(c) for c in order]
    ranged = cut(df.repartitionByRange(shuffle_parts(spark), *keys).withColumn("_part", F.spark_partition_id()))
    by = ["_part"] + ([group] if group else [])
    totals = ranged.groupBy(*by).agg(F.sum(value).alias("_sum"), F.count(F.lit(1)).alias("_count"))
    w = Window.partitionBy(*([group] if group else [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(
        *by,
        F.coalesce(F.sum("_sum").over(w), F.lit(0)).alias("_sum0"),
        F.coalesce(F.sum("_count").over(w), F.lit(0)).alias("_count0"),
    )
    bases = bases.select(F.col("_part").alias("_p"), *([F.col(group).alias("_g")] if group else []), "_sum0", "_count0")
    on = F.col("_part") == F.col("_p")
    if group:
        on = on & F.col(group).eqNullSafe(F.col("_g"))
    inside = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        ranged.withColumn("_upto", F.sum(value).over(inside))
        .withColumn("_nth", F.row_number().over(inside))
        .join(counted(bases), on)
        .withColumn("_before", F.col("_sum0") + F.col("_upto") - F.col(value))
        .withColumn("_row", F.col("_count0") + F.col("_nth") - 1)
        .drop("_p", "_g", "_sum0", "_count0", "_upto", "_nth")
    )


#: Bytes of text that a Python worker takes at a time.
PIECE_BYTES = 2_000_000


def pieces(batch: pa.RecordBatch, column: int, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most that many bytes in a column of strings (a longer one stands alone)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).tolist()
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)


LONG_KEY = 4096


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, row_id: str, total: int, heavy: int = 1000) -> DataFrame:
    """Left join of rows with groups on a string key, for keys that may hold a third of all rows.

    A group with at least total / heavy rows and a key of at most LONG_KEY characters is a heavy one: there are at most
    `heavy` of them, so that side is broadcast with a proven bound. (The few groups with longer keys are left to the
    shuffled join, whose large partitions can be split.) Rows of heavy groups get a key of their own for the shuffled join that
    serves all other groups, so no task gets more than the rows of a light group.
    """
    least = max(2, -(-total // heavy))
    columns = [c for c in groups.columns if c != key]
    heavy_one = (F.col(size) >= least) & (F.length(key) <= LONG_KEY)
    big = groups.filter(heavy_one).select(F.col(key).alias("_bk"), *[F.col(c).alias(f"_b_{c}") for c in columns])
    small = groups.filter(~heavy_one).select(F.col(key).alias("_sk"), *[F.col(c).alias(f"_s_{c}") for c in columns])
    found = rows.join(F.broadcast(big), F.col(key) == F.col("_bk"), "left")
    salted = F.when(F.col("_bk").isNotNull(), F.concat(F.lit("~"), F.col(row_id).cast("string"))).otherwise(F.col(key))
    found = found.withColumn("_jk", salted).join(small, F.col("_jk") == F.col("_sk"), "left")
    for c in columns:
        found = found.withColumn(c, F.coalesce(F.col(f"_b_{c}"), F.col(f"_s_{c}")))
    return found.drop("_bk", "_sk", "_jk", *[f"_b_{c}" for c in columns], *[f"_s_{c}" for c in columns])


def is_fold(column: Column | str, folds: int, fold: int) -> Column:
    """True where crc32 of the id as text, modulo folds, is fold. A null id counts as the empty text."""
    text = F.coalesce(F.col(column).cast("string") if isinstance(column, str) else column.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % F.lit(folds) == F.lit(fold)
