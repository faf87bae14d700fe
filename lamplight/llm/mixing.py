"""Mixing sources to target weights.

A source is the stream of its documents' words in the order of doc_id, packed into blocks of a fixed number of
words. Each source's quota of words is cut into slots of one block each. For every output shard the number of
slots of each source is drawn from a multinomial over what is left of the quotas, so the sums come out at the
quotas. A source's n-th slot takes the block that a keyed pseudorandom permutation of its blocks names, one
permutation for each pass over the source, and blocks are joined to slots by index.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamplight.llm.common import WORD, counted, running_sums, shuffle_parts

BLOCK_WORDS, SHARDS, SEED = 256, 64, 7
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
_MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor, shift, multiply)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def permute(index: np.ndarray, n: np.ndarray, key: np.ndarray, back: bool = False) -> np.ndarray:
    """The keyed pseudorandom permutation of 0..n-1 at index (or its inverse): four Feistel rounds over the
    least even number of bits that holds n, walked until the value is below n."""
    x, n, key = (np.array(a, np.uint64) for a in np.broadcast_arrays(index, n, key))
    half = np.ones(len(n), np.uint64)
    while (small := (np.uint64(1) << (np.uint64(2) * half)) < n).any():
        half[small] += np.uint64(1)
    mask = (np.uint64(1) << half) - np.uint64(1)
    todo = np.arange(len(x))
    while len(todo):
        left, right, m, k, h = x[todo] >> half[todo], x[todo] & mask[todo], mask[todo], key[todo], half[todo]
        for r in [3, 2, 1, 0] if back else [0, 1, 2, 3]:
            with np.errstate(over="ignore"):
                salt = k * np.uint64(0x9E3779B97F4A7C15) + np.uint64(r + 1)
            if back:
                left, right = right ^ (_mix(left ^ _mix(salt)) & m), left
            else:
                left, right = right, left ^ (_mix(right ^ _mix(salt)) & m)
        x[todo] = (left << h) | right
        todo = todo[x[todo] >= n[todo]]
    return x.astype(np.int64)


def _permuted(index: pd.Series, n: pd.Series, key: pd.Series) -> pd.Series:
    return pd.Series(permute(index.to_numpy(np.uint64), n.to_numpy(np.uint64), key.to_numpy(np.uint64)))


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """Words for each source: by weight (repeating) out of share times all words, at most `most` times the
    source's own; the excess is shared anew by weight until none is above."""
    left, out = share * sum(sizes), [0.0] * len(sizes)
    open_ = list(range(len(sizes)))
    while open_:
        unit = left / sum(weights[i % len(weights)] for i in open_)
        over = [i for i in open_ if unit * weights[i % len(weights)] > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = unit * weights[i % len(weights)]
            break
        for i in over:
            out[i] = most * sizes[i]
            left -= out[i]
        open_ = [i for i in open_ if i not in set(over)]
    return out


def _draws(slots: list[int], shards: int, seed: int) -> np.ndarray:
    """Slots of each source in each shard. The shards have equal numbers of slots, but for one; each draws from
    a multinomial over the slots that are left, and what a source cannot give is drawn again from the others."""
    left, rng = np.array(slots, np.int64), np.random.default_rng(seed)
    total = int(left.sum())
    out = np.zeros((shards, len(slots)), np.int64)
    for h in range(shards):
        need = total * (h + 1) // shards - total * h // shards
        while need:
            drawn = np.minimum(rng.multinomial(need, left / left.sum()), left)
            out[h] += drawn
            left -= drawn
            need -= int(drawn.sum())
    return out


def _key(sid: int, epoch: int, seed: int) -> int:
    return (seed * 1_000_003 + sid) * 64 + epoch


def plan(sources: list[tuple[str | None, int]], block: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = SEED, **how) -> dict:
    """What the mix takes: for each source (sorted by code point, null last) its target, quota, blocks, slots
    and the words of its last slot, and the draws of every shard."""
    sources = sorted(sources, key=lambda s: (s[0] is None, s[0] or ""))
    found = []
    for sid, ((name, size), target) in enumerate(zip(sources, targets([n for _, n in sources], **how), strict=True)):
        quota = min(math.floor(target + 1e-6), 2 * size) if how.get("most", MOST) <= 2 else math.floor(target + 1e-6)
        n, slots, last = -(-size // block), 0, 0
        if quota:
            passes, rest = divmod(quota, size)
            slots, short = passes * n, size - (n - 1) * block
            last = 0
            if rest:
                at = int(permute([n - 1], n, _key(sid, passes, seed), back=True)[0])  # where the short block comes
                k = -(-rest // block)
                full = k * block - (block - short if at < k else 0)
                if full < rest:
                    k += 1
                    full += short if at == k - 1 else block
                end = short if at == k - 1 else block
                slots, last = slots + k, end - (full - rest)
        found.append({"sid": sid, "source": name, "source_size": size, "target": target, "blocks": n, "slots": slots, "last": last})
    return {"sources": found, "draws": _draws([f["slots"] for f in found], shards, seed) if sum(f["slots"] for f in found) else None}


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = SEED, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, slots, spans) of the mix.

    documents: doc_id, size (words), sid, source_size, target, _before (words of the source before it), _row
    (its number in the source) and the columns named in `keep`. slots: sid, block, epoch, shard, slot, take
    (words from the block's start). spans: sid, _row, doc_id, epoch, shard, slot, doc_from, doc_to: the words of a
    document that a slot takes.

    A null text has no words. Sources are told apart as they are; null is a source of its own, last in order.
    Documents without words are in no span. Equal rows are documents of their own; rows of one id go by size and then
    by a hash of what they hold, so reruns agree. An empty table gives no rows. The table of sources goes through the
    driver: one row each, whatever the number of documents.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("_source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.col(text_col), *[F.col(c).cast("string") for c in keep if c != text_col]).alias("_tie"),
        *[F.col(c).alias(f"kept_{c}") for c in keep],
    )
    summed = running_sums(rows, ["doc_id", "size", "_tie"], "size", group="_source").drop("_tie")
    sizes = [(r[0], r[1]) for r in summed.groupBy("_source").agg(F.sum("size")).collect()]
    made = plan(sizes, block, shards, seed)
    table = spark.createDataFrame(
        [(s["sid"], s["source"], s["source_size"], float(s["target"])) for s in made["sources"]],
        "sid int, _name string, source_size long, target double",
    )
    documents = summed.join(counted(table), F.col("_source").eqNullSafe(F.col("_name"))).drop("_name", "_source", "_part")

    ranges = []
    if made["draws"] is not None:
        firsts = np.vstack([np.zeros(len(made["sources"]), np.int64), np.cumsum(made["draws"], axis=0)])
        for h in range(shards):
            at, width = 0, int(made["draws"][h].sum())
            for s in made["sources"]:
                n = int(made["draws"][h, s["sid"]])
                if n:
                    ranges.append((s["sid"], s["source_size"], s["blocks"], s["slots"], s["last"], h, width, at, int(firsts[h, s["sid"]]), n))
                at += n
    drawn = spark.createDataFrame(
        ranges, "sid int, words long, blocks long, slots long, last long, shard int, width long, at long, first long, n long"
    )
    permuted = F.pandas_udf(_permuted, "long")
    pieces = drawn.withColumn("piece", F.explode(F.expr("sequence(0L, n - 1, 4096L)"))).repartition(shuffle_parts(spark), "sid", "shard", "piece")
    slots = (
        pieces.withColumn("_i", F.explode(F.expr("sequence(piece, least(piece + 4096, n) - 1)")))
        .withColumn("_j", F.col("first") + F.col("_i"))
        .withColumn("epoch", F.expr("_j div blocks"))
        .withColumn("block", permuted(F.expr("_j % blocks"), F.col("blocks"), (F.lit(seed * 1_000_003) + F.col("sid")) * 64 + F.col("epoch")))
        .withColumn("slot", permuted(F.col("at") + F.col("_i"), F.col("width"), F.lit(seed * 1_000_003 - 1) - F.col("shard")))
        .withColumn("_full", F.least(F.lit(block).cast("long"), F.col("words") - F.col("block") * block))
        .withColumn("take", F.when((F.col("_j") == F.col("slots") - 1) & (F.col("last") > 0), F.col("last")).otherwise(F.col("_full")))
        .select("sid", "block", "epoch", "shard", "slot", "take")
    )
    pieces_of = (
        documents.filter("size > 0")
        .select("sid", "_row", "doc_id", "_before", "size")
        .withColumn("block", F.explode(F.expr(f"sequence(_before div {block}, (_before + size - 1) div {block})")))
        .withColumn("_lo", F.greatest(F.col("_before"), F.col("block") * block))
        .withColumn("_hi", F.least(F.col("_before") + F.col("size"), (F.col("block") + 1) * block))
    )
    spans = (
        pieces_of.join(slots.hint("merge"), ["sid", "block"])  # the planner cannot see how many slots the ranges hold
        .withColumn("doc_from", F.col("_lo") - F.col("_before"))
        .withColumn("doc_to", F.least(F.col("_hi"), F.col("block") * block + F.col("take")) - F.col("_before"))
        .filter("doc_to > doc_from")
        .select("sid", "_row", "doc_id", "epoch", "shard", "slot", "doc_from", "doc_to")
    )
    return documents, slots, spans


def taken(docs: DataFrame, **how) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words, repeats counted)."""
    documents, _, spans = mix(docs, **how)
    sums = spans.groupBy("sid", "_row").agg(F.sum(F.col("doc_to") - F.col("doc_from")).alias("_taken"))
    return documents.join(sums, ["sid", "_row"], "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("_taken", F.lit(0)).cast("long").alias("taken")
    )


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The documents that the mix is made of, with the columns of docs: a document comes once for each pass
    that takes words of it, with the words taken, in their order. One that a pass takes whole keeps its text as it is;
    of one taken in part the words come joined by single blanks."""
    columns = docs.columns
    documents, _, spans = mix(docs, keep=tuple(columns), **how)
    parts = spans.groupBy("sid", "_row", "epoch").agg(F.array_sort(F.collect_list(F.struct("doc_from", "doc_to"))).alias("parts"))
    found = documents.join(parts, ["sid", "_row"])
    whole = (F.size("parts") > 0) & (F.expr("aggregate(parts, 0L, (n, p) -> n + p.doc_to - p.doc_from)") == F.col("size"))
    words = F.regexp_extract_all(F.col("kept_text"), F.lit(f"({WORD})"), F.lit(1))
    cut_text = F.array_join(F.flatten(F.transform("parts", lambda p: F.slice(words, (p["doc_from"] + 1).cast("int"), (p["doc_to"] - p["doc_from"]).cast("int")))), " ")
    text = F.when(whole, F.col("kept_text")).otherwise(cut_text)
    out = {c: F.col(f"kept_{c}") for c in columns} | {"text": text}
    if "n_chars" in columns:
        out["n_chars"] = F.length(text).cast("long")
    return found.select(*[out[c].alias(c) for c in columns])
