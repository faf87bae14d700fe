"""Exact dedup by content-defined chunk recipes.

Each text is cut where a rolling hash of its last 32 bytes says so, so equal texts get equal chunks. A chunk's
digest becomes an identifier only once verified: the distinct (digest, bytes) pairs are gathered, each task
sending a chunk once, and a digest that stands for more than one byte string is split by rank. Documents are
then compared by their ordered lists of identifiers alone: the long texts move once, as chunks, and never again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamplight.llm.common import cut, join_groups, pieces

WINDOW, LEAST, MEAN_BITS, MOST = 32, 256, 11, 16384
DIGEST = 16


def _gear() -> np.ndarray:
    return np.random.default_rng(20240229).integers(0, 2**32, 256, dtype=np.uint32)


def cut_points(data: np.ndarray) -> np.ndarray:
    """Positions after which a chunk may end: the rolling hash over the last 32 bytes has its top bits clear."""
    h = _gear()[data]
    width = 1
    while width < WINDOW:  # the hash over 2w bytes from two over w
        wide = h.copy()
        wide[width:] += h[:-width] << np.uint32(width)
        h, width = wide, 2 * width
    return np.flatnonzero((h >> np.uint32(32 - MEAN_BITS)) == 0) + 1


def chunk_ends(points: np.ndarray, start: int, end: int) -> list[int]:
    """Ends of the chunks of the text at [start, end). A chunk has at least LEAST bytes (so no window reaches
    into the text before) and at most MOST, but the last one may be shorter. An empty text has no chunks."""
    ends, at = [], start
    near = points[np.searchsorted(points, start + LEAST) : np.searchsorted(points, end)].tolist() if end - start > LEAST else []
    for p in near:
        while p - at > MOST:
            at += MOST
            ends.append(at)
        if p - at >= LEAST:
            ends.append(p)
            at = p
    while end - at > MOST:
        at += MOST
        ends.append(at)
    if at < end:
        ends.append(end)
    return ends


def _texts(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray, memoryview]:
    """Bytes and offsets of a string column without making Python strings."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), memoryview(b"")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    view = memoryview(data) if data is not None else memoryview(b"")
    return np.frombuffer(view, np.uint8), ends, view


def _recipes(digest_size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in pieces(whole, 1)):
            data, ends, view = _texts(batch.column(1))
            lo, hi = (int(ends[0]), int(ends[-1]))
            points = cut_points(data[lo:hi]) + lo if hi > lo else np.zeros(0, np.int64)
            recipes = []
            for start, end in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                at, recipe = start, []
                for p in chunk_ends(points, start, end):
                    recipe.append(hashlib.blake2b(view[at:p], digest_size=digest_size).hexdigest())
                    at = p
                recipes.append("".join(recipe))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(recipes, pa.string())], ["_row_id", "text_sha256", "recipe"])

    return run


def _chunks(digest_size: int, placed: bool):
    """Chunk rows; without places each batch sends a chunk once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in pieces(whole, 1)):
            data, ends, view = _texts(batch.column(1))
            lo, hi = (int(ends[0]), int(ends[-1]))
            points = cut_points(data[lo:hi]) + lo if hi > lo else np.zeros(0, np.int64)
            rows, seqs, digests, bodies, seen = [], [], [], [], {}
            for row, start, end in zip(batch.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                at = start
                for seq, p in enumerate(chunk_ends(points, start, end)):
                    digest = hashlib.blake2b(view[at:p], digest_size=digest_size).hexdigest()
                    if placed or view[at:p] not in seen.setdefault(digest, []):
                        seen[digest] = [*seen.get(digest, []), view[at:p]]
                        rows.append(row), seqs.append(seq), digests.append(digest), bodies.append(bytes(view[at:p]))
                    at = p
            columns = [pa.array(digests, pa.string()), pa.array(bodies, pa.binary())]
            names = ["digest", "body"]
            if placed:
                columns, names = [pa.array(rows, pa.int64()), pa.array(seqs, pa.int32()), *columns], ["_row_id", "seq", *names]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_size: int = DIGEST) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical, byte for byte; a null text counts as empty. Of equal texts the largest
    doc_id stays. Rows that repeat a doc_id with the same text all carry the same keep_id and all count as
    kept if that id stays. A null doc_id is smaller than any other. An empty table gives no rows. Other
    columns of docs are not read, so their names do not matter.
    """
    source = docs.select(F.col(id_col).cast("long").alias("_row_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    recipes = cut(
        source.withColumn("sha", F.sha2(F.col("text"), 256)).mapInArrow(_recipes(digest_size), "_row_id long, text_sha256 string, recipe string")
    )
    variants = source.mapInArrow(_chunks(digest_size, False), "digest string, body binary").distinct()
    split = cut(variants.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    if not split.isEmpty():
        recipes = _resolved(source, recipes, variants, split, digest_size)
    total = recipes.count()
    groups = recipes.groupBy("recipe").agg(F.max("_row_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).filter("group_size > 1")
    found = join_groups(recipes, groups, "recipe", "group_size", "_row_id", total)
    return found.select(
        F.col("_row_id").alias("doc_id"),
        F.coalesce("keep_id", F.col("_row_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("_row_id").eqNullSafe(F.coalesce("keep_id", F.col("_row_id"))).alias("kept"),
        "text_sha256",
    )


def _resolved(source: DataFrame, recipes: DataFrame, variants: DataFrame, split: DataFrame, digest_size: int) -> DataFrame:
    """Recipes in which a digest of several byte strings is followed by the rank of its own."""
    ranked = variants.join(split.select("digest"), "digest", "left_semi").withColumn(
        "rank", F.row_number().over(Window.partitionBy("digest").orderBy("body"))
    )
    spaced = cut(source.withColumn("_seq", F.monotonically_increasing_id()))  # numbered once, whatever is computed again
    places = spaced.select("_seq", "text", F.lit("").alias("sha")).mapInArrow(
        _chunks(digest_size, True), "_row_id long, seq int, digest string, body binary"
    )
    ids = places.join(ranked, ["digest", "body"], "left").select(
        F.col("_row_id").alias("_seq"), "seq", F.concat("digest", F.lit("."), F.coalesce("rank", F.lit(0)).cast("string")).alias("id")
    )
    lists = ids.groupBy("_seq").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "id"))), lambda x: x["id"]), "/").alias("recipe"))
    told = spaced.select("_seq", "_row_id", F.sha2("text", 256).alias("text_sha256"))
    return cut(told.join(lists, "_seq", "left").select("_row_id", "text_sha256", F.coalesce("recipe", F.lit("")).alias("recipe")))
