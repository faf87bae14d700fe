"""Exact top-k inner products by a three-phase uniform threshold.

A vector's components are cut into lists (groups of dimensions); a candidate's score is the sum of its entries (partial
scores) in the lists. Phase one: every list of a block gives its k best entries, and the sums of the candidates found
so are resolved; the k-th best sum over all blocks that a task has seen is a score that k candidates reach, so the
largest such sum is a safe cutoff for the query. Phase two: the cutoffs go to all blocks. A candidate that reaches the
cutoff must, in one list at least, be above that list's mean by an equal share of what the cutoff is above the sum of
the means (any centres would do, the shares being of their sum). Only such entries are collected, and a list's entries
are computed only for candidates long enough to have one (Cauchy and Schwarz). Phase three: of each collected
candidate the missing entries alone are computed and added to the known one, and the k best of each block go on.

Queries and candidates meet as blocks, dealt out by (query block, slice of the candidates), so a task holds one block of
queries and a bounded number of blocks of candidates, and there are as many tasks as pairs of these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamplight.llm.common import cut

K, LISTS, ROWS, QUERIES = 5, 4, 4096, 512
#: Blocks of candidates that one task holds.
SLICE = 8
SCALE = 256
_EXACT = 2.0**52


def _packed(most: int):
    """Rows (id, vector) -> blocks of at most `most` vectors of one dimension: dim, ids, matrix of whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, np.ndarray]]] = {}

        def block(dim: int) -> pa.RecordBatch:
            rows = held.pop(dim)
            ids = np.array([i for i, _ in rows], np.int64)
            matrix = np.array([v for _, v in rows], np.float64).reshape(len(rows), dim)
            return pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([matrix.tobytes()], pa.binary())], ["dim", "ids", "matrix"]
            )

        for batch in batches:
            for i, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if i is None or vector is None or None in vector:
                    continue
                values = np.floor(np.array(vector, np.float64) * SCALE)
                if not np.isfinite(values).all():
                    continue
                held.setdefault(len(values), []).append((i, values))
                if len(held[len(values)]) >= most:
                    yield block(len(values))
        for dim in list(held):
            yield block(dim)

    return run


def _lists(dim: int) -> list[slice]:
    edges = [dim * g // LISTS for g in range(LISTS + 1)]
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a] or [slice(0, 0)]


def _matrix(row: dict) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], np.int64)
    return ids, np.frombuffer(row["matrix"], np.float64).reshape(len(ids), row["dim"])


def _exact(q: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The matrices, as whole numbers of any size where products would leave the exact doubles."""
    if q.shape[1] and np.abs(q).max(initial=0) * np.abs(r).max(initial=0) * q.shape[1] >= _EXACT:
        return tuple(np.vectorize(int, otypes=[object])(x) for x in (q, r))
    return q, r


def _paired(q: np.ndarray, r: np.ndarray, qs: np.ndarray, rs: np.ndarray, s: slice) -> np.ndarray:
    """Entries of single pairs in one list, a bounded number at a time."""
    parts = [(q[qs[i : i + 65536], s] * r[rs[i : i + 65536], s]).sum(axis=1) for i in range(0, len(qs), 65536)]
    return np.concatenate(parts) if parts else np.zeros(0, q.dtype)


def _best(qs: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best, ties to the smaller id, in order."""
    down = [-int(x) for x in scores] if scores.dtype == object else -scores
    order = np.lexsort((ids, down, qs)) if scores.dtype != object else np.array(sorted(range(len(qs)), key=lambda i: (qs[i], down[i], ids[i])), np.int64)
    starts = np.searchsorted(qs[order], qs[order], side="left")
    return order[np.arange(len(order)) - starts < k]


FIRST = "dim int, qb long, at int, cutoff double"


def _first(k: int):
    """A block of queries and a slice of the candidates -> a cutoff for each query that has k candidates there."""

    def run(asked: pa.Table, blocks: pa.Table) -> pa.Table:
        found: list[tuple[int, int, int, float]] = []
        for row in asked.to_pylist():
            q_ids, q_all = _matrix(row)
            top = np.full((len(q_ids), 0), -np.inf)
            for i in range(blocks.num_rows):
                r_ids, r = _matrix(blocks.slice(i, 1).to_pylist()[0])
                q, r = _exact(q_all, r)
                most = min(k + 1, len(r_ids))  # one more, as the query's own row may be among them
                picks = []
                for s in _lists(row["dim"]):
                    entries = (q[:, s] @ r[:, s].T).astype(np.float64)
                    picks.append(np.argpartition(-entries, most - 1, axis=1)[:, :most])
                picks = np.sort(np.concatenate(picks, axis=1), axis=1)
                qs, rs = np.repeat(np.arange(len(q_ids)), picks.shape[1]), picks.ravel()
                sums = sum(_paired(q, r, qs, rs, s) for s in _lists(row["dim"])).astype(np.float64)
                twice = np.concatenate([np.zeros((len(q_ids), 1), bool), picks[:, 1:] == picks[:, :-1]], axis=1).ravel()
                sums[twice | (q_ids[qs] == r_ids[rs])] = -np.inf
                top = -np.sort(-np.concatenate([top, sums.reshape(picks.shape)], axis=1), axis=1)[:, :k]
            if top.shape[1] == k:
                found += [(row["dim"], row["qb"], i, float(x)) for i, x in enumerate(top[:, k - 1].tolist()) if x > -np.inf]
        columns = list(zip(*found, strict=True)) or [[]] * 4
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int32(), pa.float64()), strict=True)], ["dim", "qb", "at", "cutoff"])

    return run


def _collected(q: np.ndarray, r: np.ndarray, cutoff: np.ndarray, lists: list[slice]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (query, candidate) with an entry above its list's threshold, and their whole scores."""
    sizes = [(np.sqrt((q[:, s].astype(np.float64) ** 2).sum(axis=1)), np.sqrt((r[:, s].astype(np.float64) ** 2).sum(axis=1))) for s in lists]
    centres = [q[:, s].astype(np.float64) @ r[:, s].astype(np.float64).mean(axis=0) for s in lists]
    share = (cutoff - sum(centres)) / len(lists)
    known = np.zeros((len(q), len(r)), bool)
    out = []
    for n, (s, centre, (q_size, r_size)) in enumerate(zip(lists, centres, sizes, strict=True)):
        least = centre + share
        least = least - 1e-6 * (1 + np.abs(least))
        least[~np.isfinite(least)] = -np.inf
        # rows of which no query can have an entry here, by their lengths, are left out
        reach = np.flatnonzero((np.outer(q_size, r_size) * (1 + 1e-9) >= least[:, None]).any(axis=0)) if np.isfinite(least).all() else np.arange(len(r))
        if not len(reach):
            continue
        entries = q[:, s] @ r[reach][:, s].T
        qs, at = np.nonzero((entries.astype(np.float64) >= least[:, None]) & ~known[:, reach])
        rs = reach[at]
        known[qs, rs] = True
        rest = [_paired(q, r, qs, rs, t) for m, t in enumerate(lists) if m != n]
        out.append((qs, rs, sum(rest, entries[qs, at])))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, q.dtype)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


FOUND = "query_id long, vec_id long, score long"


def _rest(k: int):
    """A block of queries with their cutoffs and a slice of the candidates -> each query's k best there."""

    def run(asked: pa.Table, blocks: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, list[int]]] = []
        for row in asked.to_pylist():
            q_ids, q_all = _matrix(row)
            cutoff = np.full(len(q_ids), -np.inf)
            for c in row["cutoffs"] or []:
                cutoff[c["at"]] = c["cutoff"] * (1 - np.sign(c["cutoff"]) * 1e-12)  # never above the whole number
            for i in range(blocks.num_rows):
                r_ids, r = _matrix(blocks.slice(i, 1).to_pylist()[0])
                q, r = _exact(q_all, r)
                qs, rs, scores = _collected(q, r, cutoff, _lists(row["dim"]))
                good = (scores.astype(np.float64) >= cutoff[qs]) & (q_ids[qs] != r_ids[rs])
                qs, rs, scores = qs[good], rs[good], scores[good]
                best = _best(qs, r_ids[rs], scores, k)
                out.append((q_ids[qs[best]], r_ids[rs[best]], [max(-(2**63), min(2**63 - 1, int(x))) for x in scores[best]]))
        columns = [np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out]), [x for o in out for x in o[2]]] if out else [[], [], []]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    return run


def _numbered(table: pa.Table) -> pa.Table:
    """The queries of one block and dimension -> the block."""
    dim, qb = table.column("dim")[0].as_py(), table.column("qb")[0].as_py()
    ids = table.column("id").to_numpy()
    values = np.floor(np.array(table.column("v").to_pylist(), np.float64).reshape(len(ids), dim) * SCALE)
    return pa.table({"dim": pa.array([dim], pa.int32()), "qb": pa.array([qb], pa.int64()), "ids": pa.array([ids.tobytes()], pa.binary()), "matrix": pa.array([values.tobytes()], pa.binary())})


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest integer inner products of floor(256 * x),
    ties to the smaller vec_id; fewer if there are fewer candidates.

    A vector that is null, or holds a null or non-finite component, takes no part, nor does one whose id is null.
    Rows with the query's id are its own and no candidates. Vectors meet only those of their dimension. Of
    query rows that share an id the smallest vector is asked; repeated candidate rows are candidates each.
    Scores beyond 64 bits come as the nearest long. Empty tables give no rows.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    sound = F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double") * SCALE) < float("inf")))
    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).filter(sound).groupBy("id").agg(F.min("v").alias("v"))
    n, m = rows.count(), asked.count()
    query_blocks, slices = max(1, -(-m // QUERIES)), max(1, -(-n // (ROWS * SLICE)))
    blocks = cut(rows.repartition(max(1, -(-n // ROWS))).mapInArrow(_packed(ROWS), "dim int, ids binary, matrix binary").withColumn("slice", F.pmod(F.xxhash64("ids"), F.lit(slices)).cast("int")))
    dealt = asked.select("id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(query_blocks)).alias("qb"))
    numbered = cut(dealt.groupBy("dim", "qb").applyInArrow(_numbered, "dim int, qb long, ids binary, matrix binary"))

    every = [F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice")]
    meeting = blocks.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long"))).alias("qb")).groupBy("dim", "qb", "slice")
    firsts = numbered.select("*", *every).groupBy("dim", "qb", "slice").cogroup(meeting).applyInArrow(_first(k), FIRST)
    cutoffs = firsts.groupBy("dim", "qb", "at").agg(F.max("cutoff").alias("cutoff")).groupBy("dim", "qb").agg(F.collect_list(F.struct("at", "cutoff")).alias("cutoffs"))
    told = cut(numbered.join(cutoffs, ["dim", "qb"], "left"))
    found = told.select("*", *every).groupBy("dim", "qb", "slice").cogroup(meeting).applyInArrow(_rest(k), FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
