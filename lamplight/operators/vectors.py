"""Nearest vectors (V02, O15): blocks of questions against blocks of all vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS, QUESTIONS = 4096, 256


def _packed(most: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows (vec_id, embedding) as blocks of at most `most` vectors of one length."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[tuple[int, np.ndarray]]] = {}

        def block(dim: int) -> pd.DataFrame:
            ids, rows = zip(*held.pop(dim), strict=True)
            return pd.DataFrame({"dim": [dim], "ids": [np.array(ids, np.int64).tobytes()], "matrix": [np.array(rows, np.float64).tobytes()]})

        for b in batches:
            for i, v in zip(b["vec_id"], b["embedding"], strict=True):
                held.setdefault(len(v), []).append((i, v))
                if len(held[len(v)]) == most:
                    yield block(len(v))
        for dim in list(held):
            yield block(dim)

    return run


def nearest(vectors: DataFrame, questions: DataFrame, k: int = 5) -> DataFrame:
    """q_id, vec_id, distance (squared, nine decimals), rank: the k nearest of all vectors to each question, ties by
    vec_id. Each pair of blocks keeps k a question, and a window keeps k of those. A null vector has no distance."""
    shape = "dim int, ids binary, matrix binary"
    pack = lambda df, most: df.filter("embedding IS NOT NULL").select("vec_id", "embedding").mapInPandas(_packed(most), shape)
    asked = pack(questions, QUESTIONS).select(F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"))

    def kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                if r.dim != r.q_dim or not r.dim:
                    continue
                ids, q_ids = np.frombuffer(r.ids, np.int64), np.frombuffer(r.q_ids, np.int64)
                x, q = np.frombuffer(r.matrix).reshape(-1, r.dim), np.frombuffer(r.q_matrix).reshape(-1, r.dim)
                far = np.zeros((len(q), len(x)))
                for j in range(r.dim):
                    far += (q[:, j, None] - x[None, :, j]) ** 2
                far = np.round(far, 9)
                least = min(k, len(x)) - 1
                edge = np.partition(far, least, axis=1)[:, least]
                found = []
                for n, row in enumerate(far):
                    near = np.flatnonzero(~(row > edge[n]))
                    near = near[np.lexsort((ids[near], row[near]))][:k]
                    found.append(pd.DataFrame({"q_id": q_ids[n], "vec_id": ids[near], "distance": row[near]}))
                yield pd.concat(found)

    rows = pack(vectors, ROWS).crossJoin(asked).mapInPandas(kept, "q_id long, vec_id long, distance double")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("q_id").orderBy("distance", "vec_id"))).filter(F.col("rank") <= k)
