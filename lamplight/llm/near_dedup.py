"""Near-duplicate documents by an LSH forest over MinHash signatures.

Every text's set of distinct four-word shingles gets a pool of MinHash values. A tree is an order of all texts: by a label
of LABEL values, taken from the pool at the tree's own place on, 16 bits of each. Rows that follow one another in a
tree's order are neighbours, and the values that their labels share from the beginning are their common prefix. A
region is a run of rows that share a prefix. How deep its prefix is adapts to it: a region of SHALLOW values stays
whole while it has at most SPARSE rows; one that is more crowded is split by its next value, and so on to DEPTH values.

Candidates are neighbours inside a region. Each text tries the neighbour with the longest common prefix of all trees,
and the one in the region that its copies would choose as well; most groups hang together after that. Where the texts
of a region still fall into several components, its sets meet once, in blocks of bounded bytes, and every pair
between components is counted there exactly; no pair is sent anywhere. All links are confirmed on full sets. Texts
with equal sets are one class throughout, so copies are never expanded into pairs.

A pair of similarity s shares a region of DEPTH values in one of the 40 trees with probability 1 - (1 - s^6)^40 at least:
0.999995 at 0.8.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamplight.llm.common import cut, join_groups, pieces

SHINGLE, TREES = 4, 40
#: Values of a label; of the least and the greatest common prefix that makes a region; rows of a region that is not crowded.
LABEL, SHALLOW, DEPTH, SPARSE = 8, 4, 6, 8
POOL = TREES * DEPTH
#: Shingles of a region that one task holds (8 bytes each); larger regions are split, and their blocks meet two by two.
REGION_BLOCK = 500_000
NO_ID = -(2**63)  # stands for a null id inside
U = np.uint64


def _odd(seed: int, n: int, kind: type) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, np.iinfo(kind).max, n, dtype=kind) | kind(1)


#: An odd base and its inverse modulo 2^64: a word's hash is the sum of its bytes times powers of the base, taken from
#: running sums over the text, so hashing needs neither strings nor a dictionary.
BASE = 0x9E6C63D0876A9A47
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]
#: Bytes hashed at a time; a longer word is hashed whole.
PIECE = 1 << 20


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers 0..n of the base and of its inverse."""
    if len(_powers[0]) <= n:
        size = max(2 * n, 1 << 16) + 1
        with np.errstate(over="ignore"):
            for i, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
                steps = np.full(size, base, U)
                steps[0] = 1
                _powers[i] = np.cumprod(steps, dtype=U)
    return _powers


def _word_hashes(text: bytes) -> np.ndarray:
    data = np.frombuffer(text, np.uint8)
    inside = (data != 32) & ((data < 9) | (data > 13))
    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    starts, ends = edge[::2], edge[1::2]
    there, back = _power_tables(len(data))
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, U), np.cumsum((data.astype(U) + U(1)) * there[: len(data)], dtype=U)])
        h = (sums[ends] - sums[starts]) * back[starts]
        h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(29))


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the four-word shingles of lower-case words (A-Z; ASCII white space). A text of
    fewer than four words is one shingle, one of none has none."""
    text = text.lower()
    if len(text) <= PIECE:
        h = _word_hashes(text)
    else:
        parts, at = [], 0
        while at < len(text):
            end = at + PIECE
            while end < len(text) and text[end] not in b" \t\n\r\v\f":
                end += 1
            parts.append(_word_hashes(text[at:end]))
            at = end
        h = np.concatenate(parts)
    if not len(h):
        return h
    n = min(SHINGLE, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - n + 1, n, U)
        for i in range(n):
            out = (out ^ h[i : len(h) - n + 1 + i]) * U(0x9E3779B97F4A7C15)
            out ^= out >> U(29)
        out *= U(0xBF58476D1CE4E5B9)
        out ^= out >> U(32)
    return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """POOL MinHash values."""
    flips, factors = _odd(11, POOL, np.uint32), _odd(12, POOL, np.uint32)
    low = (shingles >> U(32)).astype(np.uint32)
    best = np.full(POOL, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 256):
        values = (low[at : at + 256, None] ^ flips[None, :]) * factors[None, :]
        np.minimum(best, values.min(axis=0), out=best)
    return best


#: Places in the pool of each tree's label, and constants that keep the trees apart (they rename a tree's values).
_PLACES = (np.arange(TREES)[:, None] * DEPTH + np.arange(LABEL)[None, :]) % POOL
_TREE = np.random.default_rng(13).integers(0, 2**64, (2, TREES), dtype=U)


def labels(pools: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of pools and each tree the label, as two numbers of four values of 16 bits, first value highest."""
    values = (pools[:, _PLACES] & np.uint32(0xFFFF)).astype(U)
    halves = [values[:, :, h] << U(48) | values[:, :, h + 1] << U(32) | values[:, :, h + 2] << U(16) | values[:, :, h + 3] for h in (0, 4)]
    return halves[0] ^ _TREE[0], halves[1] ^ _TREE[1]


def _shared(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Common values of two labels from the beginning, by the bits in which their halves differ."""
    of = lambda x: (x < U(1 << 48)).astype(np.int8) + (x < U(1 << 32)) + (x < U(1 << 16)) + (x == 0)
    return np.where(high == 0, 4 + of(low), of(high)).astype(np.int8)


MARKS = "id long, n_shingles long, digest string, pool binary, nameless boolean"


def _digest(found: np.ndarray) -> str | None:
    return hashlib.blake2b(found.tobytes(), digest_size=16).hexdigest() if len(found) else None


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in pieces(whole, 1)):
        sizes, digests, pools = [], [], []
        for text in batch.column(1).cast(pa.large_binary()):
            found = shingle_set(text.as_py() or b"")
            sizes.append(len(found))
            digests.append(_digest(found))
            pools.append(signature(found).tobytes() if len(found) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(pools, pa.binary()), batch.column(2)], MARKS.replace(",", "").split()[::2])


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each class once for each tree, with its label there."""
    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            part = batch.slice(start, 500)
            high, low = labels(np.array([np.frombuffer(p.as_py(), np.uint32) for p in part.column(1)]))
            ids = np.repeat(part.column(0).to_numpy(zero_copy_only=False), TREES)
            yield pa.RecordBatch.from_arrays([pa.array(high.ravel().view(np.int64)), pa.array(low.ravel().view(np.int64)), pa.array(ids, pa.int64())], ["high", "low", "id"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of label -> the rows of regions of two or more: key of the region, id, neighbour before (the row's
    own id where it is the first) and the length of their common prefix. What is held from batch to batch is SPARSE
    rows on either side of a row, which tell whether its region is crowded."""
    held = [np.zeros(0, np.int64)] * 3
    done = 0  # rows of those held that have been told already

    def tell(last: bool) -> pa.RecordBatch | None:
        nonlocal held, done
        n = len(held[0])
        upto = n if last else n - SPARSE
        if upto <= done:
            return None
        high, low, ids = held[0].view(U), held[1].view(U), held[2]
        common = np.zeros(n + 1, np.int8)  # with the row before; none at the borders
        common[1:n] = _shared(high[1:] ^ high[:-1], low[1:] ^ low[:-1])
        depth = np.full(n, SHALLOW, np.int8)
        for d in range(SHALLOW, DEPTH):
            run = np.cumsum(common[:n] < d)
            depth[(np.bincount(run)[run] > SPARSE) & (depth == d)] = d + 1
        after = common[:n] >= depth  # it follows a row of its region
        at = np.flatnonzero(after | (common[1:] >= depth))
        at = at[at >= done]
        at = at[at < upto]
        with np.errstate(over="ignore"):
            kept = np.where(depth == 4, U(0), low >> (U(16) * (U(LABEL) - np.maximum(depth, 5).astype(U))))
            key = (high * U(0x9E3779B97F4A7C15)) ^ ((kept << U(3) | depth.astype(U)) * U(0xBF58476D1CE4E5B9))
            key ^= key >> U(31)
        before = np.where(after, np.concatenate([ids[:1], ids[:-1]]), ids)
        out = pa.RecordBatch.from_arrays([pa.array(key[at].view(np.int64)), pa.array(ids[at]), pa.array(before[at]), pa.array(common[at].astype(np.int32))], ["key", "id", "before", "common"])
        left = max(0, upto - SPARSE)
        held, done = [c[left:] for c in held], upto - left
        return out

    for batch in batches:
        if batch.num_rows:
            held = [np.concatenate([old, new.to_numpy(zero_copy_only=False)]) for old, new in zip(held, batch.columns, strict=True)]
            found = tell(False)
            if found is not None:
                yield found
    found = tell(True)
    if found is not None:
        yield found


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in pieces(whole, 1)):
        sets = [shingle_set(t.as_py() or b"").tobytes() for t in batch.column(1).cast(pa.large_binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.large_binary())], ["id", "shingles"])


def _confirm(per_cent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(a.as_buffer(), U), np.frombuffer(b.as_buffer(), U)
                small = min(len(x), len(y)) * 100 >= per_cent * max(len(x), len(y))
                inter = len(np.intersect1d(x, y, assume_unique=True)) if small else 0
                linked.append(small and 100 * inter >= per_cent * (len(x) + len(y) - inter))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_()), batch.column(4)], ["a", "b", "linked", "key"])

    return run


def _link_region(per_cent: int):
    """The documents of a region (or of two blocks of one) -> links between different components, as many as join
    them. All pairs are counted exactly, through lists of the documents that hold a shingle; none is sent."""

    def run(table: pa.Table) -> pa.Table:
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        ids, part = table.column("id").to_numpy(), table.column("block").to_numpy()
        known = table.column("component").to_numpy()
        sets = [np.frombuffer(x.as_buffer(), U) for x in table.column("shingles").combine_chunks()] if table.num_rows else []
        sizes = np.array([len(x) for x in sets], np.int64)
        _, number = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(number, kind="stable")
        lists, edges = owner[order], np.concatenate([[0], np.cumsum(np.bincount(number))])
        ends = np.concatenate([[0], np.cumsum(sizes)])
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while root.get(x, x) != x:
                root[x] = root.get(root[x], root[x])
                x = root[x]
            return x

        a, b = [], []
        for i in range(len(sets)):
            if low != high and part[i] != low:
                continue  # pairs inside a block are that block's own matter
            mine = number[ends[i] : ends[i + 1]]
            longs = edges[mine + 1] - edges[mine]
            holders = lists[np.repeat(edges[mine] - np.cumsum(longs) + longs, longs) + np.arange(int(longs.sum()))]
            inter = np.bincount(holders, minlength=len(sets))
            linked = 100 * inter >= per_cent * (sizes[i] + sizes - inter)
            linked &= (part == high) if low != high else (np.arange(len(sets)) > i)
            for j in np.flatnonzero(linked).tolist():
                x, y = top(int(known[i])), top(int(known[j]))
                if x != y:
                    root[max(x, y)] = min(x, y)
                    a.append(min(ids[i], ids[j])), b.append(max(ids[i], ids[j]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _pairs(pairs: DataFrame) -> DataFrame:
    """Distinct unordered pairs (a < b) of the columns x and y, each with the least key of a region that it comes from."""
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "key").filter("a < b").groupBy("a", "b").agg(F.min("key").alias("key"))


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a batch -> as many stars as they have components, each around its smallest id. What is connected stays so."""
    for batch in batches:
        root: dict[int, int] = {}

        def top(x: int, root: dict[int, int] = root) -> int:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
        ends = [(top(x), x) for x in list(root)]
        stars = [(t, x) for t, x in ends if t != x]
        yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in stars], pa.int64()) for i in (0, 1)], ["a", "b"])


def components(edges: DataFrame, by: str) -> DataFrame:
    """(id, component): the smallest id reachable, for all ids on the edges (a, b). Edges of one value of `by` come together in
    order and are contracted batch by batch, so a chain along a region is a star at once. Then, round by round, every id
    points to its smallest neighbour, and edges are lifted to what their ends point to; only ids smaller than all
    their neighbours go on, so the graph shrinks by a factor in each round. The pointers of all rounds make the labels."""
    keyed = edges.withColumn("_by", F.col(by)).repartition("_by").sortWithinPartitions("_by", "a", "b")
    left = cut(keyed.select("a", "b").mapInArrow(_contracted, "a long, b long").distinct())
    rounds: list[DataFrame] = []
    while not left.isEmpty():
        ends = left.select(F.col("b").alias("id"), F.col("a").alias("to")).unionByName(left.select(F.col("a").alias("id"), F.col("b").alias("to")))
        up = ends.groupBy("id").agg(F.min("to").alias("to")).select("id", F.least("id", "to").alias("to"))
        step = cut(up.join(up.select(F.col("id").alias("_id"), F.col("to").alias("_far")), F.col("to") == F.col("_id")).select("id", F.col("_far").alias("to")))
        rounds.append(step)
        lifted = left.join(step.select(F.col("id").alias("a"), F.col("to").alias("x")), "a").join(step.select(F.col("id").alias("b"), F.col("to").alias("y")), "b")
        pairs = lifted.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        left = cut(pairs.repartition("a").mapInArrow(_contracted, "a long, b long").distinct())
    if not rounds:
        return left.select(F.col("a").alias("id"), F.col("b").alias("component"))
    found = rounds[-1]
    for step in reversed(rounds[:-1]):
        found = step.join(found.select(F.col("id").alias("to"), F.col("to").alias("_up")), "to", "left").select("id", F.coalesce("_up", "to").alias("to"))
    return cut(found.select("id", F.col("to").alias("component")))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_cent: int = 80, block: int = REGION_BLOCK) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Two texts are linked when 100 * intersection >= per_cent * union of their sets of distinct four-word
    shingles. component_id is the smallest doc_id reachable over links, itself included; kept marks that one. A
    null text counts as empty; texts without words have no shingles and no links; texts of one to three words
    are one shingle. Rows that share a doc_id are one document for linking; a null doc_id is smaller than
    any (where one stands, it is one document with the least long). An empty table gives no rows. Other columns are
    not read. Shingles are compared by 64-bit hashes.
    """
    known_id = F.col(id_col).cast("long")
    rows = docs.select(F.coalesce(known_id, F.lit(NO_ID)).alias("id"), F.col(text_col).cast("string").alias("text"), known_id.isNull().alias("nameless"))
    marks = cut(rows.mapInArrow(_mark, MARKS))
    total, nameless = marks.agg(F.count(F.lit(1)), F.max("nameless")).first()
    classes = cut(marks.filter("digest IS NOT NULL").groupBy("digest", "pool").agg(F.min("id").alias("id"), F.min("n_shingles").alias("shingles_in"), F.count(F.lit(1)).alias("size")))
    trees = classes.select("id", "pool").mapInArrow(_trees, "high long, low long, id long")
    runs = cut(trees.repartition("high").sortWithinPartitions("high", "low", "id").mapInArrow(_near, "key long, id long, before long, common int"))
    members = runs.select("id").distinct()
    sets = cut(rows.select("id", "text").join(members, "id", "left_semi").mapInArrow(_sets, "id long, shingles binary").distinct())

    # each text with the neighbour of the longest common prefix, and with its neighbour in the region of the least key
    tried = runs.filter("before <> id").groupBy("id").agg(F.max(F.struct("common", "before", "key")).alias("near"), F.min(F.struct("key", "before")).alias("chain"))
    pairs = _pairs(tried.select(F.col("id").alias("x"), F.explode(F.array(*[F.struct(F.col(f"{c}.before").alias("y"), F.col(f"{c}.key").alias("key")) for c in ("near", "chain")])).alias("p")).select("x", "p.y", "p.key"))
    one = sets.select(F.col("id").alias("a"), F.col("shingles").alias("s"))
    two = sets.select(F.col("id").alias("b"), F.col("shingles").alias("t"))
    tried = pairs.join(one, "a").join(two, "b").select("a", "b", "s", "t", "key").mapInArrow(_confirm(per_cent), "a long, b long, linked boolean, key long")
    found = components(tried.filter("linked").select("a", "b", "key"), "key")

    # then the regions that still fall apart: components that share one are joined, and their sets meet once
    marked = runs.select("key", "id").join(found, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component")).distinct()
    split = marked.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("key", "lo")
    apart = cut(marked.join(split, "key").select("id", "component", "lo").distinct())
    regions = components(apart.filter("component <> lo").select(F.col("component").alias("a"), F.col("lo").alias("b")).distinct(), "b").select(F.col("id").alias("component"), F.col("component").alias("region"))
    held = apart.select("id", "component").distinct().join(regions, "component").join(classes.groupBy("id").agg(F.sum("shingles_in").alias("n")), "id")
    sizes = held.groupBy("region").agg(F.ceil(F.sum("n") / block).cast("int").alias("blocks"))
    placed = held.join(sizes, "region").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    sent = (
        placed.join(sets, "id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("region", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "id", "block", "component", "shingles")
    )
    more = sent.groupBy("region", "low", "high").applyInArrow(_link_region(per_cent), "a long, b long")
    joined = found.filter("id <> component").select(F.col("component").alias("a"), F.col("id").alias("b"))
    found = components(joined.unionByName(more), "a")

    known = classes.join(found, "id", "left").select("digest", F.coalesce("component", "id").alias("component"), "size")
    out = join_groups(marks.select("id", "n_shingles", "nameless", F.coalesce("digest", F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string"))).alias("digest")), known, "digest", "size", "id", total)
    component = F.coalesce("component", "id")
    return out.select(
        F.when(~F.col("nameless"), F.col("id")).alias("doc_id"),
        "n_shingles",
        F.when(component != NO_ID, component).alias("component_id") if nameless else component.alias("component_id"),
        (F.col("id") == component).alias("kept"),
    )
