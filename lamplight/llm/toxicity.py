"""Toxicity by a linear-chain conditional random field.

Document labels become token labels: in toxic documents, the words (or word beginnings) that a bounded sample of
labelled rows ties to toxic documents. A two-state chain is trained on windows of labelled tokens. Over a whole
text, forward-backward gives each word's probability of being toxic: words without features all have the same
potentials, so the chain crosses a run of them in one step, by a power of the transition matrix, and the result
is that of the full recursion. The probabilities add up to a document's score, through a logistic layer fitted on
the same sample; the offending offsets are the words that are more likely toxic than not.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamplight.llm.common import cut, is_fold, pieces

LETTERS = re.compile(r"[^\W\d_]+")
#: Most labelled rows of either class that training takes: those whose ids hash lowest.
SAMPLE_ROWS = 3000
#: Most bytes of their texts, of either class; a text over an eighth of it is passed over in training.
SAMPLE_BYTES = 12_000_000
PREFIXES = (4, 5, 6, 7, 8)
LEAST_DOCS, LEAST_SHARE, LEAST_ODDS, REACH = 4, 0.006, 1.5, 6
THRESHOLD = 0.7


def features(word: str) -> list[str]:
    """The word, and its beginnings marked by a star."""
    return [word, *[word[:k] + "*" for k in PREFIXES if len(word) > k]]


@dataclass
class Chain:
    """Emission weights of state 1 by feature, its bias, transitions [from, to], and the document layer."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    layer: np.ndarray = field(default_factory=lambda: np.array([-4.0, 0.0, 0.0, 0.0]))

    def __post_init__(self) -> None:
        self.heads = {f[:4] for f in self.weights}
        step = np.exp(self.trans + np.array([0.0, self.bias])[None, :])  # one word without features
        values, vectors = np.linalg.eig(step)
        order = np.argsort(-np.abs(values))
        self.ratio = float(np.real(values[order[1]] / values[order[0]]))
        v = np.real(vectors[:, order])
        back = np.linalg.inv(v)
        self.first, self.second = np.outer(v[:, 0], back[0]), np.outer(v[:, 1], back[1])

    def power(self, n: int) -> np.ndarray:
        """The step matrix to the n, but for scale."""
        return self.first + self.second * self.ratio**n if n else np.eye(2)

    def emission(self, word: str) -> float | None:
        """None for a word without features."""
        if word[:4] not in self.heads:
            return None
        found = [self.weights[f] for f in features(word) if f in self.weights]
        return sum(found) if found else None

    def marginals(self, n: int, at: list[int], scores: list[float]) -> list[float]:
        """Probability of state 1 at the words `at` of a text of n words, whose emission scores are given."""
        k = len(at)
        ahead, gate = np.array([0.5, 0.5]), []
        before = -1
        for p, s in zip(at, scores, strict=True):
            ahead = (ahead @ self.power(p - before)) * np.array([1.0, math.exp(min(s, 50.0))])
            ahead = np.maximum(ahead / ahead.sum(), 1e-300)
            gate.append(ahead)
            before = p
        out, behind = [0.0] * k, self.power(n - 1 - at[-1]) @ np.ones(2) if k else None
        for i in range(k - 1, -1, -1):
            both = gate[i] * np.maximum(behind, 1e-300)
            out[i] = float(both[1] / both.sum())
            if i:
                behind = self.power(at[i] - at[i - 1]) @ (np.array([1.0, math.exp(min(scores[i], 50.0))]) * behind)
                behind = behind / behind.sum()
        return out

    def inputs(self, n: int, probabilities: list[float]) -> list[float]:
        total = sum(probabilities)
        return [1.0, math.log1p(total), max(probabilities, default=0.0), math.log1p(100.0 * total / max(n, 20))]

    def score(self, n: int, probabilities: list[float]) -> float:
        z = float(np.dot(self.layer, self.inputs(n, probabilities)))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))

    def read(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """Score of a text and (start, end, probability) of its offending words."""
        words = LETTERS.findall(text.lower())
        heads = self.heads
        if not any(w[:4] in heads for w in words):
            return self.score(len(words), []), []
        spots = list(LETTERS.finditer(text))
        marked = [(i, s) for i, m in enumerate(spots) if (s := self.emission(m[0].lower())) is not None]
        found = self.marginals(len(spots), [i for i, _ in marked], [s for _, s in marked])
        spans = [(*spots[i].span(), p) for (i, _), p in zip(marked, found, strict=True) if p >= 0.5]
        return self.score(len(spots), found), spans


def _distinct(sample: list[tuple[str, int]], edge: int = 8) -> list[tuple[str, int]]:
    """Without copies, exact or near: of texts that share their first or their last words one is kept, lest the
    words of a text that was copied often look typical."""
    seen, kept = set(), []
    for text, label in sample:
        words = text.lower().split()
        ends = {("first", *words[:edge]), ("last", *words[-edge:])} if len(words) >= edge else {("all", *words)}
        if not ends & seen:
            kept.append((text, label))
        seen |= ends
    return kept


def _select(docs: list[tuple[list[str], int]]) -> dict[str, float]:
    """Features that toxic documents have far more often, with their log odds."""
    toxic, clean, sums = Counter(), Counter(), [0, 0]
    for words, label in docs:
        found = {f for w in set(words) for f in features(w)}
        (toxic if label else clean).update(found)
        sums[label] += 1
    least = max(LEAST_DOCS, math.ceil(LEAST_SHARE * sums[1]))
    odds = {f: math.log((n + 0.5) / (sums[1] + 1) * (sums[0] + 1) / (clean[f] + 0.5)) for f, n in toxic.items() if n >= least}
    return {f: v for f, v in odds.items() if v >= LEAST_ODDS}


def _fit_chain(docs: list[tuple[list[str], int]], odds: dict[str, float], rounds: int = 120) -> Chain:
    """Maximum likelihood with a ridge, by adaptive gradient steps, on windows around words with features (and
    one window of other words for each document)."""
    names = sorted(odds)
    index = {f: i for i, f in enumerate(names)}
    width = 2 * REACH + 1
    tokens, labels, lengths = [], [], []
    for words, label in docs:
        marked = [i for i, w in enumerate(words) if any(f in index for f in features(w))]
        covered = -1
        for i in marked or ([len(words) // 2] if words else []):
            if i <= covered:
                continue
            window = words[max(0, i - REACH) : i + REACH + 1]
            covered = i + REACH
            rows = [[index[f] for f in features(w) if f in index] for w in window]
            tokens.append(rows)
            labels.append([int(bool(label and r)) for r in rows])
            lengths.append(len(window))
    n = len(tokens)
    y = np.zeros((n, width), np.int64)
    mask = np.arange(width)[None, :] < np.array(lengths)[:, None]
    where, feats = [], []
    for i, rows in enumerate(tokens):
        y[i, : len(rows)] = labels[i]
        for t, r in enumerate(rows):
            where += [i * width + t] * len(r)
            feats += r
    where, feats = np.array(where, np.int64), np.array(feats, np.int64)
    theta = np.zeros(len(names) + 5)  # features, bias, transitions
    theta[len(names)] = -2.0
    moment, second = np.zeros_like(theta), np.zeros_like(theta)
    pair_seen = np.zeros(4)
    for a in (0, 1):
        for b in (0, 1):
            pair_seen[2 * a + b] = ((y[:, :-1] == a) & (y[:, 1:] == b) & mask[:, 1:]).sum()
    for step in range(1, rounds + 1):
        w, bias, trans = theta[: len(names)], theta[len(names)], theta[len(names) + 1 :].reshape(2, 2)
        emit = np.bincount(where, weights=w[feats], minlength=n * width).reshape(n, width) + bias if len(where) else np.full((n, width), bias)
        psi = np.stack([np.ones_like(emit), np.exp(np.clip(emit, -30, 30))], axis=2)
        move = np.exp(np.clip(trans, -15, 15))
        ahead = np.zeros((n, width, 2))
        ahead[:, 0] = psi[:, 0] / psi[:, 0].sum(axis=1, keepdims=True)
        for t in range(1, width):
            x = (ahead[:, t - 1] @ move) * psi[:, t]
            ahead[:, t] = np.where(mask[:, t, None], x / x.sum(axis=1, keepdims=True), ahead[:, t - 1])
        behind = np.ones(ahead.shape)
        pairs = np.zeros((2, 2))
        for t in range(width - 2, -1, -1):
            x = psi[:, t + 1] * behind[:, t + 1]
            joint = ahead[:, t, :, None] * move[None] * x[:, None, :]
            joint /= joint.sum(axis=(1, 2), keepdims=True)
            pairs += joint[mask[:, t + 1]].sum(axis=0)
            x = x @ move.T
            behind[:, t] = np.where(mask[:, t + 1, None], x / x.sum(axis=1, keepdims=True), 1.0)
        p = ahead * behind
        p = p[:, :, 1] / p.sum(axis=2)
        gap = np.where(mask, y - p, 0.0)
        gradient = np.concatenate([np.bincount(feats, weights=gap.ravel()[where], minlength=len(names)), [gap.sum()], pair_seen - pairs.ravel()])
        gradient -= 0.1 * theta
        moment, second = 0.9 * moment + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
        theta = theta + 0.15 * (moment / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Chain(dict(zip(names, theta[: len(names)].tolist(), strict=True)), float(theta[len(names)]), theta[len(names) + 1 :].reshape(2, 2).copy())


def _fit_layer(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression with a small ridge, by Newton steps."""
    beta = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 0.05 * np.eye(x.shape[1])
        beta = beta + np.linalg.solve(hessian, x.T @ (weight * (y - p)) - 0.05 * beta)
    return beta


def train(sample: list[tuple[str, int]], totals: tuple[int, int]) -> Chain:
    """The model of a sample of (text, label) and the numbers of all labelled rows, clean and toxic. Without
    both labels there is nothing to tell apart: no word has features and all scores are one small constant."""
    docs = [(LETTERS.findall(text.lower()), label) for text, label in _distinct(sample)]
    have = Counter(label for _, label in docs)
    if not have[0] or not have[1]:
        return Chain()
    odds = _select(docs)
    chain = _fit_chain(docs, odds)
    x = []
    for words, _ in docs:
        marked = [(i, s) for i, w in enumerate(words) if (s := chain.emission(w)) is not None]
        x.append(chain.inputs(len(words), chain.marginals(len(words), [i for i, _ in marked], [s for _, s in marked])))
    y = np.array([label for _, label in docs], np.float64)
    weight = np.where(y == 1, totals[1] / have[1], totals[0] / have[0])
    chain.layer = _fit_layer(np.array(x), y, weight * len(docs) / weight.sum())
    return chain


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Chain:
    """Train on at most sample_rows labelled rows, and sample_bytes of text, of either class, none of them held out (crc32
    of the id as text, modulo 3, being 1). The ids are chosen from the labels alone, by a hash; of them those come first
    whose texts fit, and only these whole texts are fetched."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.filter(~is_fold("doc_id", 3, 1))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    parts = [known.filter(F.col("toxic") == y).orderBy(*order).limit(sample_rows) for y in (0, 1)]
    picked = parts[0].unionByName(parts[1]).select(F.col("doc_id").alias("_id"), "toxic")  # 2 * sample_rows ids at most
    held = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size")).join(F.broadcast(picked), F.col("doc_id") == F.col("_id"))
    sizes = held.groupBy("doc_id").agg(F.max("size").alias("size"), F.max("toxic").alias("toxic"))
    upto = F.sum("size").over(Window.partitionBy("toxic").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    few = cut(sizes.filter(F.col("size") <= sample_bytes // 8).withColumn("upto", upto).filter(F.col("upto") <= sample_bytes).select(F.col("doc_id").alias("_id"), "toxic"))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(few), F.col("doc_id") == F.col("_id"))
    rows = texts.groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return train([(r["text"], int(r["toxic"])) for r in rows], (counts.get(0, 0), counts.get(1, 0)))


SCORED = "doc_id long, score double, spans array<struct<start:int,end:int,p:double>>"


def _scored(chain: Chain):
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in pieces(whole, 1)):
            scores, spans = [], []
            for text in batch.column(1):
                score, found = chain.read(text.as_py() or "")
                scores.append(score)
                spans.append([{"start": a, "end": b, "p": p} for a, b, p in found])
            columns = [pa.array(scores, pa.float64()), pa.array(spans, kind)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, *batch.columns[2:]], ["doc_id", "score", "spans", *batch.schema.names[2:]])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, spans (character offsets of offending words).

    Only the text is an input of a score. A null text counts as empty; an empty text scores by the constant of
    the document layer. Whole texts are read. Equal texts have equal scores; repeated rows repeat theirs. An
    empty table gives no rows; without labels of both kinds every score is the same and low.
    """
    chain = fit(docs, labels, sample_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_scored(chain), SCORED).select(
        "doc_id", is_fold("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans"
    )


def clean_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that are not rejected, with their columns."""
    chain = fit(docs, labels, sample_rows)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            at = whole.schema.get_field_index("text")
            for batch in pieces(whole, at):
                yield batch.filter(pa.array([chain.read(t.as_py() or "")[0] < threshold for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
