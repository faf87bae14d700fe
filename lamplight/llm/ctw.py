"""Language-model scoring by context-tree weighting.

A text is a string of bytes: its words, lower case, each followed by a blank, then one end byte. Each byte is eight
binary decisions; each of the 255 decision points has a context tree over the DEPTH bytes before, in which every
node holds a Krichevsky-Trofimov estimate from the training counts, and a node's weighted probability is the mean
of its own estimate and of the product of its children's. A byte's probability mixes the estimates of all depths
along its context, each with the weight that the training text leaves it.

How it is spread out. All that matters of a text are its grams: a byte with its context. Documents are dealt into
blocks of about BLOCK_BYTES; a block sends its distinct grams, with their training counts, to buckets, which are
chosen by the two nearest context bytes, so a bucket holds whole subtrees. Contexts of two bytes that hold more than
a bucket's share of the corpus (at most HOT of them) are dealt out by three bytes instead. Buckets sum the counts and
build the subtrees; the top of the trees, of at most (257 + HOT) * 255 nodes, is built from the buckets' sums. Each
bucket then answers each block with the log probabilities of that block's grams, and the block adds them up by
document. The words of the base model travel the same way. Nothing that grows with the corpus is broadcast or collected.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamplight.llm.common import cut, is_fold

DEPTH = 5
END = 0xFF  # no byte of UTF-8
#: Text of a block, but for its last document, and most contexts of two bytes that are dealt out by three.
BLOCK_BYTES, HOT = 24_000_000, 256
LN10 = float(np.log(10.0))
U = np.uint64


# --- grams -----------------------------------------------------------------------------------------------------

def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all bytes of the texts and where each text's begin (one more for the end).

    A key is the context, nearest byte first, then the byte itself in the lowest place. Before a text stands
    nothing but end bytes.
    """
    gap = bytes([END]) * DEPTH
    data = np.frombuffer(gap + gap.join(texts) + gap[:1], np.uint8)
    key = data[DEPTH:].astype(U)
    for d in range(1, DEPTH + 1):
        key |= data[DEPTH - d : len(data) - d].astype(U) << U(8 * (DEPTH - d + 1))
    sizes = np.array([len(t) for t in texts], np.int64) + 1
    starts = np.concatenate([[0], np.cumsum(sizes + DEPTH - 1)])[:-1]
    where = np.arange(int(sizes.sum())) + np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)])[:-1], sizes)
    return key[where], np.concatenate([[0], np.cumsum(sizes)])


def stream(text: bytes) -> tuple[list[bytes], bytes]:
    """Words, and the bytes that are scored but for the end."""
    words = text.lower().split()  # bytes: only A-Z and ASCII white space count
    return words, b"".join([b" ".join(words), b" "]) if words else b""


# --- trees -----------------------------------------------------------------------------------------------------

def _log_gamma(x: np.ndarray) -> np.ndarray:
    """ln gamma for x > 0: Stirling's series at x + 8, brought back by the recurrence."""
    shift = np.ones_like(x)
    for i in range(8):
        shift *= x + i
    z = x + 8
    inverse = 1 / z
    square = inverse * inverse
    series = inverse * (1 / 12 - square * (1 / 360 - square * (1 / 1260 - square / 1680)))
    return (z - 0.5) * np.log(z) - z + 0.9189385332046727 + series - np.log(shift)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return _log_gamma(n0 + 0.5) + _log_gamma(n1 + 0.5) - _log_gamma(n0 + n1 + 1.0) - np.log(np.pi)


def _nodes(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Decision nodes (context and node number), sorted, with their zeros and ones."""
    found, zeros, ones = [], [], []
    context, value = keys >> U(8), keys & U(255)
    for k in range(8):
        node = (context << U(8)) | (U(1) << U(k)) | (value >> U(8 - k))
        bit = ((value >> U(7 - k)) & U(1)).astype(bool)
        first = np.concatenate([[True], node[1:] != node[:-1]]) if len(node) else np.zeros(0, bool)  # keys are sorted
        at = np.flatnonzero(first)
        if len(at):
            found.append(node[at])
            zeros.append(np.add.reduceat(np.where(bit, 0, counts), at))
            ones.append(np.add.reduceat(np.where(bit, counts, 0), at))
    if not found:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    node, zero, one = np.concatenate(found), np.concatenate(zeros), np.concatenate(ones)
    order = np.argsort(node)
    return node[order], zero[order].astype(np.float64), one[order].astype(np.float64)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts[:0]


def shorter(keys: np.ndarray) -> np.ndarray:
    """Keys without the farthest context byte."""
    return ((keys >> U(16)) << U(8)) | (keys & U(255))


class Subtree:
    """Trees from depth `top` down to DEPTH: at each depth the nodes, their estimates of a one, the weights of the
    estimates and the ln of the weighted probabilities."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int = DEPTH, top: int = 2) -> None:
        self.top, self.depth = top, depth
        self.levels: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        seen = counts > 0
        keys, counts = keys[seen], counts[seen]
        below: tuple[np.ndarray, np.ndarray] | None = None
        for d in range(depth, top - 1, -1):
            node, zero, one = _nodes(keys, counts)
            own = log_kt(zero, one)
            if below is None:
                weighted, weight = own, np.ones(len(node))
            else:
                parent = ((below[0] >> U(16)) << U(8)) | (below[0] & U(255))
                product = np.bincount(np.searchsorted(node, parent), weights=below[1], minlength=len(node))
                weighted = np.logaddexp(own, product) - np.log(2.0)
                weight = np.exp(np.minimum(own - np.log(2.0) - weighted, 0.0))
            self.levels[d] = (node, (one + 0.5) / (zero + one + 1.0), weight)
            below = (node, weighted)
            self.zero, self.one, self.weighted = zero, one, weighted
            if d > top:
                keys, counts = _summed(shorter(keys), counts)

    def ones(self, d: int, node: np.ndarray, deeper: np.ndarray) -> np.ndarray:
        return _ones(self.levels[d], node, deeper)


def _ones(level: tuple[np.ndarray, np.ndarray, np.ndarray], node: np.ndarray, deeper: np.ndarray) -> np.ndarray:
    """Probability of a one at a depth, given that of the child. A node never seen knows nothing: one half,
    mixed evenly with the child's, which is one half too."""
    known, estimate, weight = level
    if not len(known):
        return np.full(len(node), 0.5)
    at = np.minimum(np.searchsorted(known, node), len(known) - 1)
    hit = known[at] == node
    w = weight[at]
    return np.where(hit, w * estimate[at] + (1.0 - w) * deeper, 0.5)


def predict(keys: np.ndarray, tree: Subtree, roof: np.ndarray, eaves: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """log10 probability of each gram. roof[d]: for depths 0 and 1 the (estimate, weight) of each (byte, node). eaves:
    the nodes of depth 2, with estimates and weights, for trees that begin at depth 3."""
    out = np.zeros(len(keys))
    value = keys & U(255)
    for k in range(8):
        number = (U(1) << U(k)) | (value >> U(8 - k))
        bit = ((value >> U(7 - k)) & U(1)).astype(bool)
        one = np.full(len(keys), 0.5)
        context = keys >> U(8)
        for d in range(tree.depth, tree.top - 1, -1):
            one = tree.ones(d, (context << U(8)) | number, one)
            context = context >> U(8)
        if tree.top == 3:
            one = _ones(eaves, (context << U(8)) | number, one)
            context = context >> U(8)
        if roof is not None:
            for d in (1, 0):  # context now holds the nearest byte, then nothing
                at = (context.astype(np.int64) if d else np.zeros(len(keys), np.int64), number.astype(np.int64))
                estimate, weight = roof[d][0][at], roof[d][1][at]
                one = weight * estimate + (1.0 - weight) * one
                context = context >> U(8)
        out += np.log(np.where(bit, one, 1.0 - one))
    return out / LN10


def build_roof(near: np.ndarray, number: np.ndarray, zero: np.ndarray, one: np.ndarray, product: np.ndarray) -> np.ndarray:
    """Depths 0 and 1 from sums over depth 2: by nearest byte and node number, the counts and the product of the
    children. Result [depth, (estimate, weight), byte, node]; unseen nodes know nothing."""
    n0, n1, inner = (np.zeros((256, 256)) for _ in range(3))
    np.add.at(n0, (near, number), zero)
    np.add.at(n1, (near, number), one)
    np.add.at(inner, (near, number), product)
    out = np.full((2, 2, 256, 256), 0.5)
    own = log_kt(n0, n1)
    weighted = np.logaddexp(own, inner) - np.log(2.0)
    out[1, 0], out[1, 1] = (n1 + 0.5) / (n0 + n1 + 1.0), np.exp(np.minimum(own - np.log(2.0) - weighted, 0.0))
    z0, z1, product0 = n0.sum(axis=0), n1.sum(axis=0), weighted.sum(axis=0)
    own0 = log_kt(z0, z1)
    weighted0 = np.logaddexp(own0, product0) - np.log(2.0)
    out[0, 0, 0], out[0, 1, 0] = (z1 + 0.5) / (z0 + z1 + 1.0), np.exp(np.minimum(own0 - np.log(2.0) - weighted0, 0.0))
    return out


def build_eaves(context: np.ndarray, number: np.ndarray, zero: np.ndarray, one: np.ndarray, product: np.ndarray):
    """Nodes of depth 2 from sums over depth 3, one row for each context and node number -> the sorted nodes with their
    estimates and weights, and the rows that they are for build_roof."""
    node = (context.astype(U) << U(8)) | number.astype(U)
    order = np.argsort(node)
    node, zero, one, product = node[order], zero[order], one[order], product[order]
    own = log_kt(zero, one)
    weighted = np.logaddexp(own, product) - np.log(2.0)
    level = (node, (one + 0.5) / (zero + one + 1.0), np.exp(np.minimum(own - np.log(2.0) - weighted, 0.0)))
    return level, ((node >> U(16)).astype(np.int64), (node & U(255)).astype(np.int64), zero, one, weighted)


# --- packing ---------------------------------------------------------------------------------------------------

def _pack(numbers: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(numbers).tobytes(), 1)


def _pack_sorted(keys: np.ndarray) -> bytes:
    steps = np.diff(keys, prepend=U(0))
    small = steps[1:].max(initial=0) < 2**32
    return (b"4" if small else b"8") + keys[:1].tobytes() + _pack(steps[1:].astype(np.uint32) if small else steps[1:])


def _unpack_sorted(packed: bytes) -> np.ndarray:
    if len(packed) < 9:
        return np.zeros(0, U)
    steps = np.frombuffer(zlib.decompress(packed[9:]), np.uint32 if packed[:1] == b"4" else U).astype(U)
    return np.cumsum(np.concatenate([np.frombuffer(packed[1:9], U), steps]), dtype=U)


def _unpack(packed: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), kind)


def _hot(keys: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Which grams are dealt out by three context bytes."""
    return np.isin((keys >> U(8 * DEPTH - 8)).astype(np.int64), hot)


def _buckets(keys: np.ndarray, n: int, hot: np.ndarray) -> np.ndarray:
    near = np.where(_hot(keys, hot), (keys >> U(8 * DEPTH - 16)) | U(1 << 32), keys >> U(8 * DEPTH - 8))
    with np.errstate(over="ignore"):
        return (((near * U(0x9E3779B97F4A7C15)) >> U(33)) % U(n)).astype(np.int64)


def _two_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each two bytes follow each other in a partition's texts, nearer byte first."""
    counts = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for text in batch.column(0).cast(pa.large_binary()):
            data = np.frombuffer((text.as_py() or b"").lower() + b" ", np.uint8).astype(np.uint16)
            counts += np.bincount(data[1:] << np.uint16(8) | data[:-1], minlength=1 << 16)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at])], ["context", "n"])


# --- the three steps -------------------------------------------------------------------------------------------

def _runs(texts: list[bytes], most: int = 8_000_000) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of bounded size, with the number of the first (a longer text stands alone)."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > most:
            yield start, texts[start:i]
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, texts[start:]


_SENT = "block int, bucket int, kind string, keys binary, counts binary, total long"


def _send(buckets: int, hot: np.ndarray):
    def run(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        train = np.array(table.column("train").to_pylist(), bool)
        texts = [b"" if t is None else t for t in table.column("text").cast(pa.large_binary()).to_pylist()]
        taught, others, keys_of, counts_of, ends = Counter(), set(), [], [], 0
        for start, run_ in _runs(texts):
            streams = []
            for i, t in enumerate(run_, start):
                words, data = stream(t)
                taught.update(words) if train[i] else others.update(words)
                streams.append(data)
            keys, starts = grams(streams)
            mine = np.repeat(train[start : start + len(run_)], np.diff(starts))
            seen, number = np.unique(keys[mine], return_counts=True)
            rest = np.unique(keys[~mine])
            more = rest[~np.isin(rest, seen, assume_unique=True)]
            keys_of += [seen, more]
            counts_of += [number.astype(np.int64), np.zeros(len(more), np.int64)]
            if len(keys_of) > 8:
                k, c = _summed(np.concatenate(keys_of), np.concatenate(counts_of))
                keys_of, counts_of = [k], [c]
        ends = int(train.sum())
        keys, counts = _summed(np.concatenate(keys_of), np.concatenate(counts_of)) if keys_of else (np.zeros(0, U), np.zeros(0, np.int64))
        rows = []
        place = _buckets(keys, buckets, hot)
        order = np.argsort(place, kind="stable")
        edges = np.searchsorted(place[order], np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(edges)).tolist():
            at = order[edges[b] : edges[b + 1]]
            rows.append((block, b, "gram", _pack_sorted(keys[at]), _pack(counts[at].astype(np.uint32)), 0))
        words: dict[int, list[bytes]] = {}
        for w in [*taught, *(others - taught.keys())]:
            words.setdefault(zlib.crc32(w) % buckets, []).append(w)
        for b, found in words.items():
            found.sort()
            rows.append((block, b, "word", zlib.compress(b" ".join(found), 1), _pack(np.array([taught.get(w, 0) for w in found], np.uint32)), sum(taught.get(w, 0) for w in found)))
        rows.append((block, 0, "ends", b"", b"", ends))
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.int64()]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in _SENT.split(", ")])

    return run


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    parts = [_unpack_sorted(k) for k in table.column("keys").to_pylist()]
    keys, counts = np.zeros(0, U), np.zeros(0, np.int64)
    held = [[], []]
    for i, (k, c) in enumerate(zip(parts, table.column("counts").to_pylist(), strict=True)):
        held[0].append(k), held[1].append(_unpack(c, np.uint32).astype(np.int64))
        if i % 16 == 15 or i == len(parts) - 1:
            keys, counts = _summed(np.concatenate([keys, *held[0]]), np.concatenate([counts, *held[1]]))
            held = [[], []]
    return keys, counts, parts


TOPS = "depth int, near int, number int, zero double, one double, product double"


def _tops(hot: np.ndarray):
    """Of a bucket's subtrees, by the context above and node number: counts, and the product of the top nodes."""

    def run(table: pa.Table) -> pa.Table:
        keys, counts, _ = _merged(table)
        split, out = _hot(keys, hot), []
        for top, mine in ((2, ~split), (3, split)):
            tree = Subtree(keys[mine], counts[mine], top=top)
            node = tree.levels[top][0]
            ids, inverse = np.unique(shorter(node), return_inverse=True)
            sums = [np.bincount(inverse, weights=v, minlength=len(ids)).astype(np.float64) for v in (tree.zero, tree.one, tree.weighted)]
            out.append(pa.table({"depth": pa.array(np.full(len(ids), top - 1, np.int32)), "near": pa.array((ids >> U(8)).astype(np.int32)), "number": pa.array((ids & U(255)).astype(np.int32)), "zero": sums[0], "one": sums[1], "product": sums[2]}))
        return pa.concat_tables(out)

    return run


_ANSWER = "block int, bucket int, kind string, keys binary, found binary, total long"


def _answers(roof: np.ndarray, eaves: tuple, hot: np.ndarray):
    names = [x.split()[0] for x in _ANSWER.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.int64()]

    def run(table: pa.Table) -> pa.Table:
        rows = []
        kind, bucket, blocks = table.column("kind")[0].as_py(), table.column("bucket")[0].as_py(), table.column("block").to_pylist()
        asked = table.column("keys").to_pylist()
        if kind == "gram":
            keys, counts, parts = _merged(table)
            value, split = np.zeros(len(keys), np.float32), _hot(keys, hot)
            for top, mine in ((2, ~split), (3, split)):
                value[mine] = predict(keys[mine], Subtree(keys[mine], counts[mine], top=top), roof, eaves)
            for block, packed, part in zip(blocks, asked, parts, strict=True):
                rows.append((block, bucket, kind, packed, value[np.searchsorted(keys, part)].tobytes(), 0))
        else:
            taught: Counter = Counter()
            lists = [zlib.decompress(p).split(b" ") if p else [] for p in asked]
            for words, c in zip(lists, table.column("counts").to_pylist(), strict=True):
                for w, n in zip(words, _unpack(c, np.uint32).tolist(), strict=True):
                    if n:
                        taught[w] += n
            for block, packed, words in zip(blocks, asked, lists, strict=True):
                rows.append((block, bucket, kind, packed, _pack(np.array([taught.get(w, 0) for w in words], np.int64)), len(taught)))
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long"


def _score(known_words: int, train_tokens: int, ends: int):
    """Blocks of documents with their answers -> scores."""
    floor = np.log10(train_tokens + 0.5 * (known_words + 1))

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.Table.from_arrays([pa.array([], t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())], [x.split()[0] for x in SCORED.split(", ")])
        keys_of, value_of, number = [], [], {}
        counts_of = []
        for kind, keys, found in zip(answers.column("kind").to_pylist(), answers.column("keys").to_pylist(), answers.column("found").to_pylist(), strict=True):
            if kind == "gram":
                keys_of.append(_unpack_sorted(keys))
                value_of.append(np.frombuffer(found, np.float32))
            else:
                for w in zlib.decompress(keys).split(b" ") if keys else []:
                    number[w] = len(number)
                counts_of.append(_unpack(found, np.int64))
        keys = np.concatenate(keys_of) if keys_of else np.zeros(0, U)
        value = np.concatenate(value_of).astype(np.float64) if value_of else np.zeros(0)
        order = np.argsort(keys)
        keys, value = keys[order], value[order]
        counts = np.concatenate(counts_of) if counts_of else np.zeros(0, np.int64)
        weight = np.log10(counts + 0.5) - floor
        end_weight, end_known = np.log10(ends + 0.5) - floor, int(ends > 0)
        texts = [b"" if t is None else t for t in docs.column("text").cast(pa.large_binary()).to_pylist()]
        tokens, known, base, score, size = [], [], [], [], []
        for _, run_ in _runs(texts, 4_000_000):
            streams = []
            for t in run_:
                words, data = stream(t)
                at = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
                tokens.append(len(words) + 1)
                known.append(int((counts[at] > 0).sum()) + end_known if len(words) else end_known)
                base.append((float(weight[at].sum()) if len(words) else 0.0) + end_weight)
                streams.append(data)
                size.append(len(data) + 1)
            mine, starts = grams(streams)
            distinct, at = np.unique(mine, return_inverse=True)  # in order, so the search runs along the keys
            score += np.add.reduceat(value[np.searchsorted(keys, distinct)][at], starts[:-1]).tolist()
        columns = [docs.column("doc_id"), docs.column("held_out"), pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64()), pa.array(size, pa.int64())]
        return pa.Table.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], [x.split()[0] for x in SCORED.split(", ")])

    return run


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes,
    bits_per_byte.

    The model learns from the documents whose crc32 of the id as text, modulo 5, is not 1; all are scored, over
    their whole texts. A null text counts as empty and is its end alone. score is the log10 probability that
    the tree mixture gives to the bytes of the words, lower case, each followed by one blank, and the end. Rows
    that repeat count and are scored each; equal texts score alike. With no training rows every bit has
    probability one half. An empty table gives no rows. Other columns are not read.
    """
    pairs = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_two_bytes, "context int, n long").groupBy("context").agg(F.sum("n").alias("n")).toPandas()  # 65,536 rows at most
    blocks = max(1, -(-int(pairs["n"].sum()) // block_bytes))
    buckets = max(16, blocks)
    often = pairs[pairs["n"] * buckets > pairs["n"].sum()].sort_values(["n", "context"], ascending=[False, True])
    hot = np.sort(often["context"].to_numpy(np.int64)[:HOT])
    held = is_fold(id_col, 5, 1)
    # documents of one id are spread as well, by the text's own checksum
    block = F.pmod(F.xxhash64(F.col(id_col), F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))), F.lit(blocks)).cast("int")
    rows = docs.select(block.alias("block"), F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), (~held).alias("train"), F.col(text_col).cast("string").alias("text"))
    sent = cut(rows.select("block", "train", "text").groupBy("block").applyInArrow(_send(buckets, hot), _SENT))
    tops = sent.filter("kind = 'gram'").groupBy("bucket").applyInArrow(_tops(hot), TOPS)
    # at most (256 + HOT) * 255 rows, whatever the input
    top = tops.groupBy("depth", "near", "number").agg(*[F.sum(c).alias(c) for c in ("zero", "one", "product")]).orderBy("depth", "near", "number").toPandas()
    of = lambda d: [top.loc[top["depth"] == d, c].to_numpy(t) for c, t in (("near", np.int64), ("number", np.int64), ("zero", None), ("one", None), ("product", None))]
    eaves, above = build_eaves(*of(2))
    roof = build_roof(*[np.concatenate(c) for c in zip(of(1), above, strict=True)])
    answers = cut(sent.filter("kind <> 'ends'").groupBy("kind", "bucket").applyInArrow(_answers(roof, eaves, hot), _ANSWER))
    told = {r["kind"]: int(r["n"] or 0) for r in sent.groupBy("kind").agg(F.sum("total").alias("n")).collect()}
    distinct = answers.filter("kind = 'word'").select("bucket", "total").distinct().agg(F.sum("total")).first()[0] or 0
    ends = told.get("ends", 0)
    train_tokens, known_words = told.get("word", 0) + ends, int(distinct) + (1 if ends else 0)
    scored = rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(known_words, train_tokens, ends), SCORED)
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), "base_score", "score", "n_bytes",
        (-F.col("score") / F.lit(np.log10(2.0).item()) / F.col("n_bytes")).alias("bits_per_byte"),
    )
