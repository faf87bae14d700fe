"""Audit, quotes, attribution, reports, parsed answers, state block and index against cases worked out by hand."""

import json

import pytest

from lamplight.operators import audit, canon_block, judging, quotes, reports, retrieval, voice
from lamplight.streaming import incremental


def test_names_and_drift(spark):
    prose = "Your hand. We met at St. Mary's gate on Harbor Street and saw Luis Auto Body there. Then Cole's Syrian friend came; your bag."
    texts = spark.createDataFrame([("m", 1, prose), ("m", 2, "Ann walked. Lila Cole sang.")], "manuscript string, chapter_number int, content string")
    got = {r.name for r in audit.names(texts, audit.vocabulary(texts)).collect()}
    assert got == {"St. Mary", "Harbor Street", "Luis Auto Body", "Lila Cole"}
    facts = spark.createDataFrame([("m", "Shop: Morales Auto Body is shut"), ("m", "Church: St. Augustine gate"), ("m", "Street: Harbor Street"), ("m", "Siena Cole is her cousin")], "manuscript string, fact string")
    drift = {(r.entity, r.summary) for r in audit.name_drift(facts, texts).collect()}
    assert {e for e, _ in drift} == {"Morales Auto Body", "St. Augustine"}
    assert ("Morales Auto Body", "Key facts say 'Morales Auto Body'; the prose says 'Luis Auto Body'") in drift
    cast = spark.createDataFrame([("m", "ann", "Dr. Ann Zed", 1), ("m", "bo", "Father Bo", 1), ("m", "zed", "Mr. Zedd", 2), ("m", "late", "Nobody Here", 9)], "manuscript string, slug string, name string, introduced int")
    through = spark.createDataFrame([("m", 2)], "manuscript string, last int")
    assert [r.entity for r in audit.absent_characters(cast, texts, through).collect()] == ["zed"]


def test_dates_and_records(spark):
    cast = spark.createDataFrame([("m", "a", "A", "deceased", None, 5), ("m", "b", "B", "deceased", 3, 5), ("m", "c", "C", "active", 3, 5), ("m", "d", "D", "deceased", 5, 5)], "manuscript string, slug string, name string, status string, died int, last_seen int")
    assert {(r.kind, r.entity) for r in audit.cast_dates(cast).collect()} == {("death_chapter_missing", "a"), ("seen_after_death", "b")}
    records = spark.createDataFrame([("m", "f", c) for c in (2, 4)], "manuscript string, file string, chapter int")
    row = audit.unrecorded(records, spark.createDataFrame([("m", 14)], "manuscript string, last int")).first()
    assert (row.chapter, row.summary) == (14, "f has no row for chapter(s) 1, 3, 5, 6, 7, 8, 9, 10 …")


def test_whole_findings(spark):
    chapters = spark.createDataFrame([(1, "One day.\n\nThe river ran cold that night, she said."), (2, "Nothing else is in here at all. The boat came home.")], "chapter_number int, content string")
    rows = [
        (1, "consistency.timeline", "concern", "s", "Ch 1: 'The river ran cold' ... 'she said'", "", ""),
        (2, "consistency.timeline", "concern", "s", "Ch 2: 'no such words anywhere'", "", "2"),
        (3, "prose.repetition", "concern", "s", "Ch 2: 'no such words anywhere'", "", "2"),
        (4, "consistency.timeline", "concern", "", "Ch 1: 'The RIVER ran “cold”'", "Ch 2: 'was never there'", ""),
        (5, "consistency.timeline", "strength", "s", "Ch 2: 'came'", "Canon C1", ""),
        (6, "consistency.timeline", "concern", "s", "Ch 1: 'the river ran cold that'", "Canon C1", ""),
    ]
    found = spark.createDataFrame(rows, "finding_id int, dimension string, severity string, summary string, evidence string, counter_evidence string, chapter_ref string")
    got = {r.finding_id: r for r in quotes.check_findings(found, chapters).collect()}
    assert {i: (r.quote_verified, r.severity, r.match) for i, r in got.items()} == {
        1: (True, "concern", "exact"), 2: (False, "neutral", None), 3: (False, "concern", None), 4: (False, "neutral", None), 5: (False, "strength", None), 6: (True, "concern", "normalized"),
    }
    assert got[2].summary == "Unverified quote: s" and got[4].summary == "Unverified quote"
    spot = got[1].location
    assert (spot.chapter_number, spot.paragraph, spot.line, spot.start, spot.end) == (1, 2, 3, 10, 28)
    assert len(got[1].id) == 12 and got[1].id != got[6].id
    ref = spark.createDataFrame([("scene 3, chapters 4 and 7; line 12", "Ch. 9: x", "chapter 4")], "r string, e string, c string")
    assert ref.select(quotes.cited_chapters(*(ref[c] for c in "rec"))).first()[0] == [4, 7, 9]


def test_attribution(spark):
    text = 'Ann said, "Well, I will not go there."\n\n"Stay," said Dr. Bo Ray, and the "dead silence" of it grew.\n\nRay waited.\nA line.\n"Never!"\n\n\n\n\n"Whose is this?"'
    chapters = spark.createDataFrame([("m", 1, "---\ntitle: x\n---\n" + text)], "manuscript string, chapter_number int, content string")
    cards = spark.createDataFrame([("m", "ann", "Ann", "terse"), ("m", "bo", "Dr. Bo Ray", "formal"), ("m", "bo2", "Bo Hale", "formal!"), ("m", "ray", "Ray", "sermon")], "manuscript string, slug string, name string, dialogue_voice string")
    assert {(r.called, r.slug) for r in voice.aliases(cards).collect()} == {("ann", "ann"), ("dr. bo ray", "bo"), ("bo hale", "bo2"), ("ray", "ray")}
    got = {(r.slug, r.quote) for r in voice.attributed(chapters, cards).collect()}
    assert got == {("ann", "Well, I will not go there."), ("bo", "Stay,"), ("ray", "Never!")}
    many = spark.createDataFrame([("m", i, 'Ann said, "I will go out there now."\n\n\n\n"We can go there now too," said Hale.') for i in range(5)], "manuscript string, chapter_number int, content string")
    pair = spark.createDataFrame([("m", "ann", "Ann", "dry"), ("m", "hale", "Hale", "biting")], "manuscript string, slug string, name string, dialogue_voice string")
    rows = voice.card_issues(many, pair).collect()
    assert [(r.kind, r.speaker, r.speaker_b, r.chapters) for r in rows] == [("card_collapse", "ann", "hale", [0, 1, 2, 3, 4])]


def test_quotes_around_and_homes(spark):
    text = "First one. The cat sat on a mat! And then more."
    assert reports.quote_around("CAT", text) == "The cat sat on a mat!" and reports.quote_around("at", text) is None and reports.quote_around("", text) is None
    long = "word " * 100 + "needle " + "word " * 100
    assert len(reports.quote_around("needle", long)) <= 160 and "needle" in reports.quote_around("needle", long)
    findings = spark.createDataFrame([("m", 1, 1, "prose.repetition", "concern", "She uses Blue  Ice a lot", ""), ("m", 2, 2, "prose.repetition", "concern", "the firns", ""), ("m", 3, 3, "prose.rhythm", "concern", "blue ice", "")], "manuscript string, finding_id int, rank int, dimension string, severity string, summary string, evidence string")
    repetition = spark.createDataFrame([("m", "blue ice")], "manuscript string, phrase string")
    thrash = spark.createDataFrame([("m", "phrase", "Blue ice", None), ("m", "common_word", None, "firn"), ("m", "phrase", "red sea", None)], "manuscript string, kind string, phrase string, lemma string")
    kept, rows = reports.dedupe(findings, repetition, thrash)
    assert sorted((r.finding_id, r.rank) for r in kept.collect()) == [(2, 1), (3, 2)]
    assert sorted(r.kind + (r.phrase or r.lemma) for r in rows.collect()) == ["common_wordfirn", "phrasered sea"]


def test_parsed_answers():
    assert judging.decoded('Sure: {"a": [1]} and {"b": 2}', "{") == {"a": [1]}
    assert judging.decoded('{"items": [1]}', "[") is None and judging.decoded('"[" then [2]', "[") == [2]
    assert judging.decoded("```json\n[]\n```", "[") == [] and judging.decoded(None, "[") is None and judging.decoded("[1", "[") is None
    assert judging.openings('"{" [ { ] } {') [0] == (4, "[")
    sheet = judging.facts_of(json.dumps({"characters": ["Ann", {"details": "tall"}, None, 3], "timeline_markers": "x", "key_objects": [{"name": "cup", "description": "red"}]}))
    assert sheet["characters"][:2] == [{"name": "Ann", "details": ""}, {"name": "?", "details": "tall"}] and sheet["timeline_markers"] == []
    assert sheet["key_objects"] == [{"name": "cup", "details": "red"}] and not sheet["parse_failed"] and judging.facts_of("{}")["parse_failed"]
    assert [r["severity"] for r in judging.findings_of("oops", "consistency")] == ["concern"] and [r["severity"] for r in judging.findings_of('["x"]', "prose")] == ["neutral"]
    assert judging.findings_of("[]", "prose") == [] and judging.enrich_map('{"a": {"summary": 3}, "b": 1}')[0]["summary"] == "3"


def test_secrets_know_no_future(spark):
    kind = "manuscript string, name string, state string, planted int, since int, revealed int, history array<struct<state:string,chapter:int>>, knowers array<string>, known_since map<string,int>"
    rows = [("m", "a", "shared", 1, 9, 8, None, ["x", "y"], {"x": 2}), ("m", "b", "shared", 1, 3, None, [("hidden", 2), ("half", 4), ("full", 9)], ["x"], {}), ("m", "c", "out", 7, None, None, None, None, None), ("m", "d", "out", 1, 9, 2, None, [], {})]
    got = {r.name: (r.state, r.chapter, r.tail) for r in canon_block.secrets(spark.createDataFrame(rows, kind), 5).collect()}
    assert got == {"a": ("hidden", 1, "known by x"), "b": ("half", 4, "known by x"), "d": ("revealed since Ch 2", 2, "knowers before Ch 5 not recorded")}


def test_index_is_built_once(spark, tmp_path):
    chapters = spark.createDataFrame([("m", 1, "The cat sat. It slept."), ("m", 2, "A dog ran far away.")], "manuscript string, chapter_number int, content string")
    path = f"file://{tmp_path}/index"
    assert retrieval.ensure_index(spark, chapters, path) and not retrieval.ensure_index(spark, chapters, path)
    assert retrieval.ensure_index(spark, chapters, path, "other")
    asked = spark.createDataFrame([(1, "A dog ran far away.")], "q_id long, question string")
    top = retrieval.retrieve(asked, retrieval.indexed(chapters), 1).first()
    assert (top.chapter_number, top["rank"]) == (2, 1)
    levels = {(r.level, r.n): r.summary for r in retrieval.hierarchy(chapters).collect()}
    assert levels[("chapter", 1)] == "The cat sat." and levels[("global", 1)] == "The cat sat." and ("act", 1) in levels


def test_versions_appear_whole(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    assert incremental.read_current(spark, path) is None
    for n in (1, 2):
        made = incremental.replace_atomically(spark.range(n), path)
    (tmp_path / "t" / "version=zz").mkdir()  # a writer that was lost
    assert incremental.read_current(spark, path).count() == spark.read.parquet(made).count() == 2
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        spark.range(1).write.parquet(made)
