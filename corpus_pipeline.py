"""The corpus pipeline: toxicity, exact dedup, near dedup, mixing, token ids.

Every stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamplight.llm import bpe, exact_dedup, mixing, near_dedup, toxicity
from lamplight.llm.common import cut, read
from lamplight.llm.queries import word_bpe_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go; training reads the labelled rows that are still among docs."""
    return toxicity.clean_documents(docs, read(spark, sf_dir, "labels"))


def _keyed(docs: DataFrame, **keys: Column) -> DataFrame:
    """The rows as one column, beside keys, so that no name of theirs can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[k.alias(name) for name, k in keys.items()])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays, once."""
    del spark, sf_dir
    found = exact_dedup.exact_dedup(docs).filter("kept").groupBy(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha")).agg(F.count(F.lit(1)).alias("rows"))
    kept = cut(found)
    rows = _keyed(docs, id=F.col("doc_id").cast("long"), sha=F.sha2(F.coalesce("text", F.lit("")), 256))
    same = F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("sha") == F.col("kept_sha"))
    if kept.filter("rows > 1").isEmpty():  # else rows that share id and text are reduced to one
        return rows.join(kept, same, "left_semi").select("row.*")
    once = rows.join(kept.filter("rows = 1"), same, "left_semi")
    return once.unionByName(rows.join(kept.filter("rows > 1"), same, "left_semi").dropDuplicates(["id", "sha"])).select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays."""
    del spark, sf_dir
    kept = near_dedup.near_dedup(docs).filter("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    return _keyed(docs, id=F.col("doc_id").cast("long")).join(kept, F.col("id").eqNullSafe(F.col("kept_id")), "left_semi").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix: one row for each pass over a source that takes words of a document."""
    del spark, sf_dir
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and decoded, the text of these ids."""
    del spark, sf_dir
    return bpe.bpe_encode(docs, word_bpe_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Training, hashing and permutations have no SQL form; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
