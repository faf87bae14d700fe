"""Contiguous shards of equal bytes from global prefix sums. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamplight.llm.common import running_sums

SHARDS = 24


def byte_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Size is the UTF-8 length of the text (null: none) plus `overhead`. In the order of doc_id (then checksum
    and size; nulls first) every document gets the sum of the sizes before it: each partition's total is
    summed on its own and the totals are prefix-summed. A document goes to the shard in which its middle
    byte falls when all bytes are cut at equal targets, so each shard is one run of the order and is off its
    target by half a document at each end at most. Slots number a shard's rows from 0. Repeated rows take
    slots of their own; an empty table gives no rows; empty texts weigh `overhead` bytes.
    """
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + F.lit(overhead)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        size.alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    summed = running_sums(rows, ["doc_id", "text_crc32", "size"], "size")
    total = summed.agg(F.max(F.col("_before") + F.col("size"))).first()[0] or 1
    shard = F.expr(f"(2 * _before + size) * {shards} div (2 * {total})")
    placed = summed.withColumn("shard", F.least(F.lit(shards - 1), shard).cast("int"))
    first = placed.groupBy("shard").agg(F.min("_row").alias("_first")).select(F.col("shard").alias("_s"), "_first")
    return placed.join(F.broadcast(first), F.col("shard") == F.col("_s")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("_row") - F.col("_first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
