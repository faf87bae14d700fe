"""Repetition: TF-IDF, openings, monotony, attribution, near-repeated sentences."""

from __future__ import annotations

import hashlib
import heapq
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lamplight.functions import lexicons as L
from lamplight.functions.likeness import Texts
from lamplight.functions.scratch import cut


def terms(texts: DataFrame, keys: list[str], content: str = "content", stop: list[str] | None = None) -> DataFrame:
    """Lower-case words of ASCII letters, two or more, that stand between other characters than letters and digits;
    stop words go. keys, pos (among the kept), term."""
    stop = L.REPORT_STOP_WORDS if stop is None else stop
    found = F.regexp_extract_all(F.lower(content), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    kept = F.filter(found, lambda t: t.rlike("^[a-z]{2,}$") & ~t.isin(stop))
    return texts.select(*keys, F.posexplode(kept).alias("pos", "term"))


def ngrams(terms_: DataFrame, keys: list[str], widths: tuple[int, ...] = (2, 3)) -> DataFrame:
    """N-grams of the kept terms."""
    w = Window.partitionBy(*keys).orderBy("pos")
    rows = terms_.withColumns({f"t{k}": F.lead("term", k).over(w) for k in range(1, max(widths))})
    grams = [F.when(F.col(f"t{n - 1}").isNotNull(), F.concat_ws(" ", "term", *[f"t{k}" for k in range(1, n)])) for n in widths]
    return rows.select(*keys, F.explode(F.array_compact(F.array(*grams))).alias("term"))


def tfidf(terms_: DataFrame, book: str, chapter: str, top_terms: int = 5000) -> DataFrame:
    """Book, term, tfidf (mean over the book's chapters of the L2-normalised weights), total. The vocabulary is
    the book's top_terms terms by count; inverse document frequencies are smoothed."""
    counts = terms_.groupBy(book, chapter, "term").agg(F.count(F.lit(1)).alias("tf"))
    return weighed(counts, terms_.groupBy(book).agg(F.countDistinct(chapter).alias("chapters")), book, chapter, top_terms)


def weighed(counts: DataFrame, chapters: DataFrame, book: str, chapter: str, top_terms: int = 5000) -> DataFrame:
    """tfidf() of counts (book, chapter, term, tf), where books have so many chapters."""
    totals = counts.groupBy(book, "term").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df"))
    order = Window.partitionBy(book).orderBy(F.desc("total"), "term")
    vocabulary = totals.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= top_terms).drop("_n")
    weighted = counts.join(vocabulary, [book, "term"]).join(F.broadcast(chapters), book)
    weighted = weighted.withColumn("w", F.col("tf") * (F.log((1 + F.col("chapters")) / (1 + F.col("df"))) + 1))
    norms = weighted.groupBy(book, chapter).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    scaled = weighted.join(norms, [book, chapter])
    return scaled.groupBy(book, "term").agg(F.round(F.sum(F.col("w") / F.col("norm")) / F.first("chapters"), 6).alias("tfidf"), F.first("total").alias("total"))


#: N-grams that a worker counts before it sends their counts on, and n-grams and words that all workers may be told of.
RUN_GRAMS, TOLD, TOLD_WORDS = 2_000_000, 4_000_000, 500_000
_TERM = re.compile(r"(?<!\w)[a-z]{2,}(?!\w)")
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def kept_terms(text: str | None, stop: frozenset[str] = frozenset(L.REPORT_STOP_WORDS)) -> list[str]:
    """The terms() of one text."""
    return [t for t in _TERM.findall((text or "").lower()) if t not in stop]


class Grams:
    """The kept terms of a text and 64-bit hashes of its n-grams."""

    def __init__(self, stop: list[str], widths: tuple[int, ...]) -> None:
        self.stop, self.widths, self.memo = frozenset(stop), widths, {}

    def _hash(self, term: str) -> int:
        if len(self.memo) > 200_000:
            self.memo.clear()
        found = self.memo[term] = int.from_bytes(hashlib.blake2b(term.encode(), digest_size=8).digest(), "little")
        return found

    def read(self, text: str | None) -> tuple[list[str], list[np.ndarray]]:
        """Terms, and for each width the hashes of the n-grams by their first term."""
        kept = kept_terms(text, self.stop)
        known = self.memo.get
        h = np.array([self._hash(t) if (x := known(t)) is None else x for t in kept], np.uint64)
        out = []
        for n in self.widths:
            x = np.full(max(0, len(h) - n + 1), n, np.uint64)
            for k in range(n):
                x = (x ^ (x >> np.uint64(31))) * _ODD[k % 4] + h[k : k + len(x)]
            x = (x ^ (x >> np.uint64(29))) * _ODD[3]
            out.append(x ^ (x >> np.uint64(32)))
        return kept, out


def gram_tfidf(texts: DataFrame, book: str, chapter: str, content: str = "content", widths: tuple[int, ...] = (2, 3), top_terms: int = 5000, stop: list[str] | None = None) -> DataFrame:
    """tfidf() of the n-grams of texts, one row for each chapter, where only what may be among a book's top_terms is
    spelled out."""
    rows = gram_counts(texts, book, chapter, content, widths, top_terms, stop)
    chapters = rows.filter("term IS NULL").groupBy(book).agg(F.countDistinct(chapter).alias("chapters"))
    return weighed(rows.filter("term IS NOT NULL"), chapters, book, chapter, top_terms)


def gram_counts(texts: DataFrame, book: str, chapter: str, content: str = "content", widths: tuple[int, ...] = (2, 3), top_terms: int = 5000, stop: list[str] | None = None) -> DataFrame:
    """book, chapter, term, tf of the n-grams that may be among a book's top_terms, and a row without a term for each chapter
    with n-grams. First all n-grams are counted by their 64-bit hashes, in packed runs, so that each book's least count that
    matters is known; then the n-grams that reach it, ties and all, are counted as words. Books with fewer repeated n-grams
    than that, and all books where the n-grams to tell of are too many, have every n-gram counted as words."""
    stop = L.REPORT_STOP_WORDS if stop is None else stop
    kind = texts.schema[book].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, held, size = Grams(stop, widths), {}, 0

        def send() -> Iterator[pa.RecordBatch]:
            for name, parts in held.items():
                h, n = np.unique(np.concatenate(parts), return_counts=True)
                edges = np.searchsorted(h >> np.uint64(56), np.arange(257, dtype=np.uint64))
                rows = [(s, h[i:j].tobytes(), n[i:j].astype(np.int64).tobytes()) for s, (i, j) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)) if i < j]
                if rows:
                    s, a, b = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(s), names), pa.array(s, pa.int32()), pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["book", "slot", "h", "n"])

        names = pa.string()
        for batch in batches:
            names = batch.schema.field(0).type
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for x in grams.read(text.as_py())[1]:
                    held.setdefault(name, []).append(x)
                    size += len(x)
                if size >= RUN_GRAMS:
                    yield from send()
                    held, size = {}, 0
        yield from send()

    def merge(table: pa.Table) -> pa.Table:
        """Of a book's slot the repeated hashes, one row for each count, as far as they may be among the first."""
        h = np.concatenate([np.frombuffer(x, np.uint64) for x in table["h"].to_pylist()])
        n = np.concatenate([np.frombuffer(x, np.int64) for x in table["n"].to_pylist()])
        order = np.argsort(h, kind="stable")
        h, n = h[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        h, n = h[first], np.add.reduceat(n, first)
        least = 2 if len(n) <= top_terms else max(2, int(np.partition(n, -top_terms)[-top_terms]))
        values = np.unique(n[n >= least]).tolist()
        each = [h[n == v] for v in values]
        name = table["book"].slice(0, 1).to_pylist() * len(values)
        return pa.table([pa.array(name, table["book"].type), pa.array(values, pa.int64()), pa.array([len(x) for x in each], pa.int64()), pa.array([x.tobytes() for x in each], pa.binary())], ["book", "n", "grams", "h"])

    packed = texts.select(F.col(book).alias("book"), content).mapInArrow(count, f"book {kind}, slot int, h binary, n binary")
    repeated = cut(packed.groupBy("book", "slot").applyInArrow(merge, f"book {kind}, n long, grams long, h binary"))
    sums = repeated.groupBy("book", "n").agg(F.sum("grams").alias("grams")).withColumn("upto", F.sum("grams").over(Window.partitionBy("book").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)))
    least = sums.filter(F.col("upto") >= top_terms).groupBy(F.col("book").alias("_book")).agg(F.max("n").alias("_least"), F.min("upto").alias("_grams"))
    told: dict = {}
    if (least.agg(F.sum("_grams")).first()[0] or 0) <= TOLD:
        for r in repeated.join(least, F.col("book").eqNullSafe(F.col("_book")) & (F.col("n") >= F.col("_least"))).select("book", "h").toLocalIterator():
            told.setdefault(r["book"], []).append(np.frombuffer(bytes(r["h"]), np.uint64))
    told = {name: np.sort(np.concatenate(parts)) for name, parts in told.items()}

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(stop, widths)
        for batch in batches:
            at, said, tf = [], [], []
            send = lambda: pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), batch.column(1).take(pa.array(at, pa.int64())), pa.array(said, pa.string()), pa.array(tf, pa.int64())], [book, chapter, "term", "tf"])  # noqa: E731, B023
            for i, (name, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2), strict=True)):
                kept, hashes = grams.read(text.as_py())
                mine, found = told.get(name), Counter()
                for n, x in zip(widths, hashes, strict=True):
                    places = range(len(x)) if mine is None else np.flatnonzero(mine[np.minimum(np.searchsorted(mine, x), len(mine) - 1)] == x).tolist()
                    found.update(" ".join(kept[j : j + n]) for j in places)
                if any(len(x) for x in hashes):  # a chapter with n-grams, whether or not they matter
                    found[None] = 0
                at += [i] * len(found)
                said += found.keys()
                tf += found.values()
                if len(at) >= 50_000:
                    yield send()
                    at, said, tf = [], [], []
            yield send()

    other = texts.schema[chapter].dataType.simpleString()
    return cut(texts.select(book, chapter, content).mapInArrow(spell, f"`{book}` {kind}, `{chapter}` {other}, term string, tf long"))


def word_counts(texts: DataFrame, book: str, chapter: str, content: str = "content", stop: list[str] | None = None) -> DataFrame:
    """book, chapter, terms, tfs: the distinct kept terms of each chapter that has any, in one row; read once."""
    stop = L.REPORT_STOP_WORDS if stop is None else stop
    kind, other = (texts.schema[c].dataType.simpleString() for c in (book, chapter))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gone = frozenset(stop)
        for batch in batches:
            at, ends, said, tf = [], [0], [], []

            def send(batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                keys, edges = pa.array(at, pa.int64()), pa.array(ends, pa.int32())  # noqa: B023
                lists = (pa.ListArray.from_arrays(edges, pa.array(x, k)) for x, k in ((said, pa.string()), (tf, pa.int64())))  # noqa: B023
                return pa.RecordBatch.from_arrays([batch.column(0).take(keys), batch.column(1).take(keys), *lists], [book, chapter, "terms", "tfs"])

            for i, text in enumerate(batch.column(2)):
                found = Counter(kept_terms(text.as_py(), gone))
                if found:
                    at.append(i)
                    said += found.keys()
                    tf += found.values()
                    ends.append(len(said))
                if len(said) >= 200_000:
                    yield send()
                    at, ends, said, tf = [], [0], [], []
            yield send()

    return cut(texts.select(book, chapter, content).mapInArrow(count, f"`{book}` {kind}, `{chapter}` {other}, terms array<string>, tfs array<long>"))


def each_count(counts: DataFrame, book: str, chapter: str) -> DataFrame:
    """book, chapter, term, tf of word_counts()."""
    return counts.select(book, chapter, F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select(book, chapter, F.col("x.terms").alias("term"), F.col("x.tfs").alias("tf"))


def _by_book(batch: pa.RecordBatch) -> Iterator[tuple[object, np.ndarray, pa.Array, pa.Array]]:
    """Of a batch of book, terms, tfs: each book with the row of each of its terms, the terms, and their counts."""
    names = batch.column(0).dictionary_encode()
    codes = names.indices.to_numpy(zero_copy_only=False)
    for code, name in enumerate(names.dictionary.to_pylist()):
        at = pa.array(np.flatnonzero(codes == code))
        terms_, tfs = batch.column(1).take(at), batch.column(2).take(at)
        yield name, np.repeat(np.arange(len(at)), pc.list_value_length(terms_).to_numpy(zero_copy_only=False)), terms_.flatten(), tfs.flatten()


def word_tfidf(counts: DataFrame, book: str, chapter: str, top_terms: int = 5000) -> DataFrame:
    """A01 from word_counts(), one row for each chapter: workers are told the vocabularies and add up each chapter's weights;
    no count is shuffled by chapter. Where the vocabularies of all books are too many to tell, tables are joined instead."""
    kind, names = counts.schema[book].dataType.simpleString(), to_arrow_type(counts.schema[book].dataType)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, _, said, tfs in _by_book(batch):
                found = pa.table([said, tfs], ["term", "tf"]).group_by("term").aggregate([("tf", "sum"), ("tf", "count")]).combine_chunks()
                for part in found.select(["term", "tf_sum", "tf_count"]).to_batches():
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part), names), *part.columns], [book, "term", "total", "df"])

    known = counts.filter(F.col(book).isNotNull())
    chapters = known.groupBy(book).agg(F.count(F.lit(1)).alias("chapters"))
    sums = known.select(book, "terms", "tfs").mapInArrow(add, f"`{book}` {kind}, term string, total long, df long")
    totals = sums.groupBy(book, "term").agg(F.sum("total").alias("total"), F.sum("df").alias("df"))
    order = Window.partitionBy(book).orderBy(F.desc("total"), "term")
    vocabulary = cut(totals.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= top_terms).join(chapters, book))
    if vocabulary.count() > TOLD_WORDS:
        return weighed(each_count(known, book, chapter), chapters, book, chapter, top_terms)
    table = vocabulary.select(book, "term", "_n", (F.log((1 + F.col("chapters")) / (1 + F.col("df"))) + 1).alias("w")).orderBy(book, "_n").toArrow().combine_chunks()
    told = {}
    for name in pc.unique(table[book]).to_pylist():
        mine = table.filter(pc.equal(table[book], pa.scalar(name, names))).combine_chunks()
        told[name] = (mine["term"].combine_chunks(), mine["w"].to_numpy())

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict = {}
        for batch in batches:
            for name, rows, said, tfs in _by_book(batch):
                vocabulary_, idf = told[name]
                at = pc.fill_null(pc.index_in(said, value_set=vocabulary_), -1).to_numpy(zero_copy_only=False)
                rows, w, at = rows[at >= 0], tfs.to_numpy(zero_copy_only=False)[at >= 0], at[at >= 0]
                w = w * idf[at]
                norms = np.sqrt(np.bincount(rows, w * w))
                part = np.bincount(at, w / norms[rows], len(idf))
                parts[name] = parts[name] + part if name in parts else part
        for name, part in parts.items():
            at = np.flatnonzero(part)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), names), pa.array(at + 1, pa.int32()), pa.array(part[at])], [book, "_n", "part"])

    sums = known.select(book, "terms", "tfs").mapInArrow(weigh, f"`{book}` {kind}, _n int, part double").groupBy(book, "_n").agg(F.sum("part").alias("sum"))
    return vocabulary.join(sums, [book, "_n"]).select(book, "term", F.round(F.col("sum") / F.col("chapters"), 6).alias("tfidf"), "total")


def top(rows: DataFrame, book: str, n: int = 50) -> DataFrame:
    """The n best terms of a book, ties by term."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(book).orderBy(F.desc("tfidf"), "term"))).filter(F.col("rank") <= n)


def openings(sentences: DataFrame, key: str, least: int = 3) -> DataFrame:
    """Sentences of a text that begin with the same three words, with five examples."""
    words = F.filter(F.split(F.lower("sentence"), r"[ \n]+"), lambda w: w != "")
    rows = sentences.withColumn("w", words).filter(F.size("w") >= 3).withColumn("opening", F.array_join(F.slice("w", 1, 3), " "))
    found = rows.groupBy(key, "opening").agg(F.count(F.lit(1)).alias("count"), F.array_sort(F.collect_list(F.struct("pos", "sentence"))).alias("l"))
    return found.filter(F.col("count") >= least).select(key, "opening", "count", F.transform(F.slice("l", 1, 5), lambda x: x["sentence"]).alias("examples"))


def monotony(sentences: DataFrame, key: str) -> DataFrame:
    """Every run of five sentences of three words or more on average, all within a fifth of their mean."""
    rows = sentences.withColumn("n", F.size(F.filter(F.split("sentence", r"[ \n]+"), lambda w: w != "")))
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(0, 4)
    rows = rows.select(key, "pos", F.avg("n").over(w).alias("mean"), F.min("n").over(w).alias("lo"), F.max("n").over(w).alias("hi"), F.count("n").over(w).alias("rows"))
    spread = F.greatest(F.col("hi") - F.col("mean"), F.col("mean") - F.col("lo")) / F.col("mean")
    return rows.filter((F.col("rows") == 5) & (F.col("mean") >= 3)).withColumn("score", F.round(1 - spread, 4)).filter(spread <= 0.2).select(key, "pos", F.round("mean", 4).alias("mean"), "score")


def attribution(texts: DataFrame, key: str, forms: DataFrame, content: str = "content") -> DataFrame:
    """Speech verbs after a closing quote, by their counted form, with how often an adverb follows."""
    pattern = r'["”’\']\s*[,.]?\s+(?:(?:he|she|they|[A-Z][a-z]+)\s+)?([a-z]+)(?: +[a-z]+ly)?'
    adverb = r'["”’\']\s*[,.]?\s+(?:(?:he|she|they|[A-Z][a-z]+)\s+)?[a-z]+( +[a-z]+ly)?'
    verbs, adverbs = F.regexp_extract_all(content, F.lit(pattern), F.lit(1)), F.regexp_extract_all(content, F.lit(adverb), F.lit(1))
    rows = texts.select(key, F.explode(F.arrays_zip(verbs.alias("v"), adverbs.alias("a"))).alias("x")).select(key, "x.v", "x.a")
    found = rows.join(F.broadcast(forms), F.col("v") == F.col("form"))
    return found.groupBy(key, F.col("counted").alias("tag")).agg(F.count(F.lit(1)).alias("count"), F.count_if(F.col("a") != "").alias("adverbs")).withColumn("adverb_heavy", F.col("adverbs") > 0.3 * F.col("count"))


def near_frames(batches: Iterator[pd.DataFrame], key: str, width: int = 19, ratio: float = 0.70, examples: bool = False, least: Callable | None = None) -> Iterator[pd.DataFrame]:
    """The pairs of band_pairs() in sentences (key, pos, sentence) that come in order; those below least(keys) may be left out."""
    from difflib import SequenceMatcher

    columns = [key, "pos_a", "pos_b", "similarity", *(["a", "b"] if examples else [])]

    held = None
    for batch in batches:
        batch = batch[[len(t.split()) >= 4 for t in batch["sentence"]]]
        old = 0 if held is None else len(held)
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        if rows.empty:
            continue
        keys, pos, said = rows[key].to_numpy(), rows["pos"].to_numpy(), rows["sentence"].tolist()
        low = [t.lower() for t in said]
        size, same, pairs = np.array([len(t) for t in low]), pd.factorize(np.array(low, object))[0], []
        for k in range(1, len(rows)):
            b = np.arange(max(k, old), len(rows))
            b = b[(keys[b] == keys[b - k]).astype(bool) & (pos[b] - pos[b - k] <= width)]
            if not len(b):
                break
            pairs.append((b - k, b))
        a, b = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 2
        want = np.full(len(b), ratio) if least is None else np.maximum(ratio, least(keys[b]))
        fit = 2 * np.minimum(size[a], size[b]) >= want * (size[a] + size[b]) - 1e-6
        fit &= (same[a] == same[b]) | (size[a] + size[b] - 1 >= want * (size[a] + size[b]) - 1e-6)  # what differs lacks a letter
        a, b, want = a[fit], b[fit], want[fit]
        used = np.unique(np.concatenate([a, b]))
        texts = Texts([low[i] for i in used.tolist()])
        for bound in (texts.shared, texts.common):
            fit = 2.0 * bound(np.searchsorted(used, a), np.searchsorted(used, b)) >= want * (size[a] + size[b]) - 1e-6
            a, b, want = a[fit], b[fit], want[fit]
        out = []
        for j in np.lexsort((a, b)):
            x, y = low[a[j]], low[b[j]]
            r = 1.0 if x == y and len(y) < 200 else SequenceMatcher(None, x, y).ratio()  # from 200 on it may know no letters
            if r >= ratio:
                out.append((keys[b[j]], pos[a[j]], pos[b[j]], round(r, 4), *((said[a[j]], said[b[j]]) if examples else ())))
        yield pd.DataFrame(out, columns=columns)
        last = len(rows) - 1
        held = rows[(keys == keys[last]).astype(bool) & (pos[last] - pos <= width)]


def band_pairs(sentences: DataFrame, key: str, width: int = 19, ratio: float = 0.70, examples: bool = False) -> DataFrame:
    """Sentences of four words or more that are much like one of the `width` that follow; with examples, both
    sentences too. Sentences of a text stream by in order with the last `width` held, so nothing is joined. Lengths, letters
    and common subsequences, for a batch at a time, rule out most pairs; what is left is compared."""
    kind = sentences.schema[key].dataType.simpleString()
    ordered = sentences.select(key, "pos", "sentence").repartition(key).sortWithinPartitions(key, "pos")
    return ordered.mapInPandas(lambda batches: near_frames(batches, key, width, ratio, examples), f"{key} {kind}, pos_a int, pos_b int, similarity double" + ", a string, b string" * examples)


#: Sentences that are compared at once, and rows of patterns that are sent on at once.
SENTENCES = 10_000
PATTERNS = "pattern_type string, opening string, count long, score double, examples array<string>"
_SENTENCE_ENDS, _BLANKS = re.compile(r"(?<=[.!?])[ \n]+"), re.compile(r"[ \n]+")


def split_sentences(text: str) -> list[str]:
    """T06 for one text, as the query splits it."""
    for a in L.ABBREVIATIONS:
        text = text.replace(a, a[:-1] + "\x02")
    return [s for p in _SENTENCE_ENDS.split(text) if (s := p.replace("\x02", ".").strip(" "))]


def sentence_patterns(texts: DataFrame, keys: list[str], content: str = "content", best: int | None = None) -> DataFrame:
    """A04, W01 and J07 in one pass over whole texts: keys, pattern_type, opening, count, score, examples. A text's sentences
    are never told apart from it, so none is sorted or shuffled. With `best`, rows whose score is below that of so many
    others of the first key are left out, as they cannot be among its best; all that tie with the last of these are there."""
    types = [texts.schema[k].dataType for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out, n = {}, [], 0
        scores: dict = {}  # the best scores of each first key

        def least(i: int) -> float:
            mine = scores.get(held[i][0])
            return mine[0] - 2e-4 if mine and len(mine) == best else 0.0  # scores are rounded to 4 places

        def add(i: int, kind: str, opening: str | None, count: int, score: float, examples: list[str]) -> None:
            if best is not None:
                if score < least(i):
                    return
                mine = scores.setdefault(held[i][0], [])
                (heapq.heappush if len(mine) < best else heapq.heappushpop)(mine, score)
            out.append((i, kind, opening, count, score, examples))

        def send() -> Iterator[pa.RecordBatch]:
            if out:
                rows = list(zip(*out, strict=True))
                made = [pa.array([held[i][j] for i in rows[0]], to_arrow_type(k)) for j, k in enumerate(types)]
                made += [pa.array(x, k) for x, k in zip(rows[1:], (pa.string(), pa.string(), pa.int64(), pa.float64(), pa.list_(pa.string())), strict=True)]
                out.clear()
                yield pa.RecordBatch.from_arrays(made, [*keys, "pattern_type", "opening", "count", "score", "examples"])

        def one(i: int, said: list[str]) -> None:
            words = [[w for w in _BLANKS.split(s) if w] for s in said]
            first: dict[str, list[int]] = {}
            for pos, w in enumerate(words):
                if len(w) >= 3:
                    first.setdefault(" ".join(w[:3]).lower(), []).append(pos)
            for o, at in first.items():
                if len(at) >= 3:
                    add(i, "repeated_opening", o, len(at), min(1.0, len(at) / 10), [said[p] for p in at[:5]])
            size = np.array([len(w) for w in words], np.int64)
            if len(size) >= 5:
                run_ = np.lib.stride_tricks.sliding_window_view(size, 5)
                mean = run_.sum(1) / 5
                spread = np.maximum(run_.max(1) - mean, mean - run_.min(1)) / mean
                for x in spread[(mean >= 3) & (spread <= 0.2)].tolist():
                    add(i, "length_monotony", None, 5, 1 - x, [])

        def frames() -> Iterator[pd.DataFrame]:
            nonlocal n
            at, pos, said = [], [], []
            for batch in batches:
                names = list(zip(*(batch.column(j).to_pylist() for j in range(len(keys))), strict=True))
                for name, text in zip(names, batch.column(len(keys)), strict=True):
                    if not text.is_valid:
                        continue
                    found = split_sentences(text.as_py())
                    held[n] = name
                    one(n, found)
                    for i in range(0, len(found), SENTENCES):  # a long text goes on in parts
                        at += [n] * len(found[i : i + SENTENCES])
                        pos += range(i, min(i + SENTENCES, len(found)))
                        said += found[i : i + SENTENCES]
                        if len(at) >= SENTENCES:
                            yield pd.DataFrame({"i": at, "pos": pos, "sentence": said})
                            at, pos, said = [], [], []
                    n += 1
            if at:
                yield pd.DataFrame({"i": at, "pos": pos, "sentence": said})

        def of_keys(at: np.ndarray) -> np.ndarray:
            values, where = np.unique(at, return_inverse=True)
            return np.array([least(i) for i in values.tolist()])[where]

        for near in near_frames(frames(), "i", examples=True, least=of_keys if best is not None else None):
            for i, r, a, b in zip(near["i"], near["similarity"], near["a"], near["b"], strict=True):
                add(i, "near_duplicate", None, 2, r, [a, b])
            yield from send()
            for i in [i for i in held if i < n]:
                del held[i]
        yield from send()

    named = ", ".join(f"`{k}` {t.simpleString()}" for k, t in zip(keys, types, strict=True))
    rows = texts.select(*keys, content).mapInArrow(run, f"{named}, {PATTERNS}")
    return rows.withColumn("score", F.when(F.col("pattern_type") == "length_monotony", F.round("score", 4)).otherwise(F.col("score")))
