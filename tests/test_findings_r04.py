"""Tests of the repetition reports (F9, F11, F12, F13) and of verified findings."""

import random

from lamplight.operators import quotes, repetition, reports
from lamplight.plans.scalar_queries import sentences


def _prose(seed, n):
    rnd = random.Random(seed)
    words = ["Anna", "Bo", "firn", "FIRN", "ridge", "glass", "sand", "été", "Mr. Fox", "the", "river", "x1", "moon", "tide", "e.g. K"]
    said = lambda: " ".join(rnd.choice(words) for _ in range(rnd.choice([1, 3, 4, 5, 5, 5, 9, 12])))
    lines = [said() for _ in range(12)]
    return [(i, rnd.choice(["b", "c", None]), "".join((rnd.choice(lines) if rnd.random() < 0.5 else said()) + rnd.choice([". ", "! ", ".\n", "?  "]) for _ in range(rnd.choice([0, 1, 8, 40])))) for i in range(n)] + [(n, "b", None)]


def test_patterns_of_one_pass_are_those_of_each_operator(spark, monkeypatch):
    monkeypatch.setattr(repetition, "SENTENCES", 50)
    docs = spark.createDataFrame(_prose(4, 50), "doc_id long, manuscript string, content string")
    text = sentences(docs, text="content")
    want = [(r.doc_id, "repeated_opening", r.opening, r["count"], min(1.0, r["count"] / 10), tuple(r.examples)) for r in repetition.openings(text, "doc_id").collect()]
    want += [(r.doc_id, "near_duplicate", "", 2, r.similarity, (r.a, r.b)) for r in repetition.band_pairs(text, "doc_id", examples=True).collect()]
    want += [(r.doc_id, "length_monotony", "", 5, r.score, ()) for r in repetition.monotony(text, "doc_id").collect()]
    one = lambda best: repetition.sentence_patterns(docs, ["manuscript", "doc_id"], best=best)
    rows = lambda df: sorted((r.doc_id, r.pattern_type, r.opening or "", r["count"], r.score, tuple(r.examples)) for r in df.collect())
    assert rows(one(None)) == sorted(want) and len({x[1] for x in want}) == 3
    first = lambda df: reports.first_rows(reports.told_patterns(df), "manuscript", reports.pattern_order("doc_id"), 6)
    pick = lambda df: sorted(str(r) for r in first(df).collect())
    assert pick(one(6)) == pick(one(None))
    assert "Exchange" not in one(None)._jdf.queryExecution().executedPlan().toString()  # no sentence is shuffled


def test_words_weighed_by_chapter_are_those_of_the_joins(spark):
    docs = spark.createDataFrame(_prose(6, 60), "doc_id long, manuscript string, content string").filter("manuscript IS NOT NULL")
    key = ["manuscript", "doc_id"]
    for most in (4, 5000):
        want = sorted(map(tuple, repetition.tfidf(repetition.terms(docs, key), *key, top_terms=most).collect()))
        told = repetition.TOLD_WORDS
        for repetition.TOLD_WORDS in (told, 0):
            assert sorted(map(tuple, repetition.word_tfidf(repetition.word_counts(docs, *key), *key, top_terms=most).collect())) == want
        repetition.TOLD_WORDS = told


def test_quotes_of_rows_come_from_the_first_chapter_that_yields_one(spark):
    docs = spark.createDataFrame([(3, "b", "A red moon rose."), (1, "b", "Red, the moon."), (2, "b", "No. A Red Moon set. It did."), (0, "c", "Red moon.")], "doc_id long, manuscript string, content string")
    asked = [("b", "phrase", "red moon", [1, 2, 3]), ("b", "word", "moon", [1, 2, 3]), ("b", "word", "sun", [1]), ("b", "sentence_pattern", "moon", [1])]
    rows = spark.createDataFrame(asked, "manuscript string, kind string, phrase string, chapters array<int>")
    found = reports.row_quotes(rows, docs)
    assert {tuple(r) for r in found.collect()} == {("b", "phrase", "red moon", "A Red Moon set."), ("b", "word", "moon", "Red, the moon.")}
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()  # a text is not repeated for each row


def test_quotes_are_verified_without_pairs_of_quotes_and_texts(spark, monkeypatch):
    rnd = random.Random(8)
    words = ["anna", "firn", "ridge", "glass", "sand", "été", "river", "moon", "tide", "no", "such"]
    body = [" ".join(rnd.choice(words) for _ in range(40)) for _ in range(12)]
    said = [" ".join(t.split()[i : i + 8]) for t in body for i in (0, 9)]
    said = [s if i % 3 else s.upper() if i % 2 else s.replace("a", "e", 1) for i, s in enumerate(said)] + ["no such words are here"] * 2
    monkeypatch.setattr(quotes, "MANY", 3)
    finder = quotes.Loose(said)
    for text in body:
        assert list(finder.find(text)) == [(i, r) for i, q in enumerate(said) if (r := quotes.best_window(q, text)) >= quotes.RATIO]
    texts = spark.createDataFrame(list(enumerate(body)), "chapter_number int, norm string")
    found = quotes.first_whole(spark.createDataFrame([(body[0][5:30], 0), (body[0][5:30], 7)], "nq string, cited int"), texts, "nq", "norm")
    assert {(r.chapter_number, r.own) for r in found.collect()} == {(0, True), (0, False)}
