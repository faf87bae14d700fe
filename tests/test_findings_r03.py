"""Tests of what was left of round 2's findings."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from lamplight.llm import bpe
from lamplight.llm.queries import word_bpe_path
from lamplight.operators import detectors, quotes, repetition, thrash


def _odd_texts(rnd, n):
    words = ["Anna", "Bo", "firn", "FIRN", "ridge-line", "glass", "glasses", "two", "miles", "said", "ponies", "Boss's", "the", "river", "Rivers", "rimes", "x1", "ö", "it's"]
    stops = [" ", " ", " ", ". ", "\n", "\n\n", "! ", " - ", ", ", " ", ".\n", " \x0b"]
    return [(i, "".join(rnd.choice(words) + rnd.choice(stops) for _ in range(rnd.choice([0, 1, 30, 400])))) for i in range(n)] + [(n, None), (n + 1, "Anna\nx\nx\nx\nx. Anna\nBo x\nAnna")]


def test_rows_of_all_detectors_are_those_of_each_detector_over_tokens(spark):
    docs = spark.createDataFrame(_odd_texts(random.Random(3), 40), "doc_id long, content string")
    numbers = docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, "even").alias("manuscript"), F.col("doc_id").cast("int").alias("chapter_number"))
    numbers = numbers.fillna("odd", ["manuscript"])
    key, texts = ["manuscript", "chapter_number"], numbers.join(docs, "doc_id")
    lines = texts.select(*key, F.posexplode(F.split("content", "\n")).alias("n", "line"))
    parts = lines.groupBy(*key, F.expr("n div 5").alias("scene")).agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("l"))
    scenes = parts.select(*key, "scene", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("content"))
    hits, shits = (thrash.content_hits(thrash.tokens(t, k)) for t, k in ((texts, key), (scenes, [*key, "scene"])))
    counts = thrash.lemma_counts(hits, key)
    lexicon = thrash.lexicon(counts)
    # in so few words every lemma is frequent; what is below a share of a twentieth counts as rare instead
    below, thrash.RARE_BELOW = thrash.RARE_BELOW, 7.7
    try:
        rare = thrash.uncommon(lexicon, below=7.7)
        within, chapter = thrash.rare_rows(shits, rare, [*key, "scene"]), thrash.rare_rows(hits, rare, key)
        want = [("within_scene", r.severity, r["count"], f"{r.manuscript}|{r.chapter_number}|{r.scene}|{r.lemma}") for r in within.collect()]
        want += [("cross_chapter", r.severity, r["count"], f"{r.manuscript}|{r.lemma}") for r in thrash.cross_chapter(within, chapter).collect()]
        want += [("chapter_rare", r.severity, r["count"], f"{r.manuscript}|{r.chapter_number}|{r.lemma}") for r in chapter.join(within, [*key, "lemma"], "left_anti").collect()]
        want += [("common_word", r.severity, r["count"], f"{r.manuscript}|{r.chapter_number}|{r.lemma}") for r in thrash.common_words(counts, rare, key).collect()]
        want += [("phrase", r.severity, r["count"], f"{r.manuscript}|{r.chapter_number}|{r.phrase}") for r in thrash.phrase_rows(thrash.phrases(thrash.tokens(texts, key), key), key).collect()]
        rows = detectors.all_rows(docs, numbers, "doc_id")
        got = [(r.kind, r.severity, r["count"], r.key) for r in rows.collect()]
    finally:
        thrash.RARE_BELOW = below
    assert sorted(got) == sorted(want)
    assert {k for k, *_ in want} == {"within_scene", "cross_chapter", "chapter_rare", "common_word", "phrase"}
    assert "Window" not in rows.drop("key")._jdf.queryExecution().optimizedPlan().toString()  # no token is sorted or shuffled


def test_whole_quotes_of_every_length_are_found(spark):
    rnd = random.Random(5)
    body = ["".join(rnd.choice("ab é\n😀*") for _ in range(rnd.choice([0, 1, 7, 60, 300]))) for _ in range(60)] + [None, "*** x"]
    said = [t[i : i + n] for t in body[:40] if t for n in (1, 2, 3, 5, 8, 15, 16, 17, 40, 90) for i in [rnd.randrange(len(t))]] + ["", "***", "nowhere to be found at all", None]
    docs, asked = (spark.createDataFrame(list(enumerate(x)), f"{k} long, text string") for x, k in ((body, "doc_id"), (said, "item_id")))
    want = {(i, j, t.find(q) + 1) for i, t in enumerate(body) for j, q in enumerate(said) if t is not None and q is not None and q in t}
    got = [tuple(r) for r in quotes.whole(asked, docs, "item_id", "doc_id").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    most, quotes.PASS_BYTES = quotes.PASS_BYTES, 500  # several passes
    try:
        assert set(map(tuple, quotes.whole(asked, docs, "item_id", "doc_id").collect())) == want
    finally:
        quotes.PASS_BYTES = most


def test_the_pipeline_decodes_what_it_encodes(spark):
    docs = spark.createDataFrame([(1, "One glass, TWO glasses!"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in corpus_pipeline.encode(spark, docs, "").collect()}
    tokens = bpe.load(word_bpe_path())
    assert got[2].n_tokens == 0 and bytes(got[2].decoded) == b""
    assert got[1].n_tokens == len(got[1].ids) // 4 > 0 and bytes(got[1].decoded) == tokens.decode(bytes(got[1].ids))


def test_phrases_told_by_their_hashes_are_those_of_all_phrases(spark):
    rnd = random.Random(9)
    words = ["firn", "ridge", "glass", "the", "River", "x1", "é", "été", "sand", "a", "ſun", "K", "İce", "moon", "_low", "tide"]
    texts = [(i, rnd.choice(["b", "c", None]), " ".join(rnd.choice(words) for _ in range(rnd.choice([0, 1, 2, 60])))) for i in range(60)] + [(60, "b", None), (61, "few", "sand moon tide")]
    docs = spark.createDataFrame(texts, "k long, book string, content string")
    for most in (5, 40, 5000):
        want = repetition.tfidf(repetition.ngrams(repetition.terms(docs, ["book", "k"]), ["book", "k"]).filter("book IS NOT NULL"), "book", "k", top_terms=most)
        want = sorted((r.book, r.term, r.tfidf, r.total) for r in want.collect())
        told = repetition.TOLD
        for repetition.TOLD in (told, 0):  # by hashes, and where there are too many of them
            got = repetition.gram_tfidf(docs, "book", "k", top_terms=most).filter("book IS NOT NULL")
            assert sorted((r.book, r.term, r.tfidf, r.total) for r in got.collect()) == want
        repetition.TOLD = told
