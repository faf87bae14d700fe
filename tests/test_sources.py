import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lamplight.sources import canon, epub, markdown, sinks


def test_markdown_numbers(spark, tmp_path):
    for name, text in {"chapter-003.md": "# Three\nbody", "CHAPTER-1.MD".lower(): "plain", "notes.md": "  # Kept\nx", "appendix.md": "y", "x.txt": "no"}.items():
        (tmp_path / name).write_text(text)
    rows = {r.source_path.rsplit("/", 1)[1]: (r.chapter_number, r.title) for r in markdown.read_markdown(spark, str(tmp_path)).collect()}
    assert rows == {"chapter-003.md": (3, "Three"), "chapter-1.md": (1, "chapter-1"), "appendix.md": (2, "appendix"), "notes.md": (4, "Kept")}


def test_discover(spark):
    chapters = spark.createDataFrame([(1,), (2,), (5,), (9,)], "chapter_number int")
    found, gaps = markdown.discover(chapters, 6)
    assert sorted(r[0] for r in found.collect()) == [1, 2, 5] and sorted(r[0] for r in gaps.collect()) == [3, 4]
    assert markdown.discover(chapters.limit(0))[1].collect() == []


def test_epub(spark, tmp_path):
    long = "A paragraph of some <i>length</i> that is kept in the book. " * 2
    with zipfile.ZipFile(tmp_path / "b.epub", "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>')
        z.writestr("O/p.opf", '<package><manifest><item id="b" href="b.xhtml" media-type="application/xhtml+xml"/><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/>'
                   '<item id="s" href="s.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="a"/><itemref idref="s"/><itemref idref="b"/></spine></package>')  # fmt: skip
        z.writestr("O/a.xhtml", f"<html><head><title> </title></head><body><h1>First</h1><p>{long}</p></body></html>")
        z.writestr("O/s.xhtml", "<html><body><p>short</p></body></html>")
        z.writestr("O/b.xhtml", f"<html><body><p>broken & {long}</body></html>")
    rows = sorted((r.chapter_number, r.title, r.content) for r in epub.read_epub(spark, str(tmp_path)).collect())
    assert [r[:2] for r in rows] == [(1, "First"), (2, "b")]
    assert rows[0][2].startswith("First\nA paragraph of some length that")


def test_canon(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps({"name": "Bo", "dialogue_voice": "terse", "extra": 1}))
    (tmp_path / "c.json").write_text(json.dumps([{"slug": "b", "name": "B2", "dialogue_voice": "x"}, {"name": " ", "dialogue_voice": ""}]))
    (tmp_path / "d.json").write_text("{broken")
    assert sorted((r.slug, r.name) for r in canon.read_characters(spark, str(tmp_path)).collect()) == [("b", "B2"), ("b", "Bo")]
    assert [(r.slug, r.name) for r in canon.read_voice_cards(spark, str(tmp_path)).collect()] == [("b", "Bo")]
    (tmp_path / "z").mkdir()
    (tmp_path / "z" / "zipf.json").write_text('{"Word": 2.5, "bad": "x"}')
    assert [tuple(r) for r in canon.read_lexicon(spark, str(tmp_path / "z")).collect()] == [("word", 2.5)]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", i, f"row {i}") for i in range(4)] + [("b", 0, "only")], "kind string, n int, text string")
    docs = {r.kind: json.loads(r.document) for r in sinks.as_json(rows, "1.0", "kind").collect()}
    assert docs["b"] == {"contract_version": "1.0", "kind": "b", "rows": [{"n": 0, "text": "only"}]} and len(docs["a"]["rows"]) == 4
    text = {r.kind: r.section for r in sinks.as_markdown(rows, "kind", F.col("text"), "n", 2).collect()}
    assert text["a"] == "## a\n- row 0\n- row 1\n… 2 more" and text["b"] == "## b\n- only"
    for _ in range(2):
        sinks.replace_table(rows, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 5


@pytest.mark.parametrize("html, want", [("<p>a <b>b</b> c</p><p>d</p>", "a b c d"), ("<html><p>a</p><p>d</p></html>", "a\nd")])
def test_xhtml(html, want):
    assert " ".join(epub.xhtml_text(html).split(" ")) == want


def test_yaml_cards_meta_and_folders(spark, tmp_path):
    (tmp_path / "canon").mkdir()
    cards = tmp_path / "canon" / "characters"
    cards.mkdir()
    (cards / "ann.json").write_text(json.dumps({"name": "Ann", "dialogue_voice": "terse"}))
    (cards / "ann.yaml").write_text("slug: ann\nname: Other\ndialogue_voice: loud\n")
    (cards / "bo.yml").write_text("name: 'Bo'\ndialogue_voice: >\n  slow and\n  formal\nvoice_wildcards:\n  - one\n  - two\n")
    (cards / "cy.yaml").write_text("name: Cy\n")
    got = {r.slug: r for r in canon.read_voice_cards(spark, str(cards)).collect()}
    assert {k: (r.name, r.dialogue_voice, r.voice_wildcards) for k, r in got.items()} == {"ann": ("Ann", "terse", None), "bo": ("Bo", "slow and formal", ["one", "two"])}
    assert {(r.stem, r.reason) for r in canon.voice_card_warnings(spark, str(cards)).collect()} == {("ann", "slug already taken"), ("cy", "no dialogue_voice")}
    (tmp_path / "seed.yaml").write_text("title: x\nmeta:\n  genre: crime\n  tags: [a, b]\nmore: y\n")
    assert canon.read_meta(spark, f"file://{cards}") == {"genre": "crime", "tags": ["a", "b"]}
    assert canon.find_canon(spark, None, f"file://{tmp_path}/chapters", chapter=2).endswith(f"{tmp_path}/canon")
    (tmp_path / "checkpoints" / "chapter-002" / "canon").mkdir(parents=True)
    (tmp_path / "checkpoints" / "chapter-002" / "canon" / "a.json").write_text("{}")
    assert canon.find_canon(spark, f"file://{tmp_path}", chapter=2).endswith("chapter-002/canon")
    assert not canon.has_table(spark, f"file://{tmp_path}/vectors") and not canon.has_table(spark, "no_such_table")


def test_story_chapters_and_dispatch(spark, tmp_path):
    (tmp_path / "chapter-002.md").write_bytes(b"two \xff end")
    (tmp_path / "chapter-1000000.md").write_text("far")
    (tmp_path / "notes.md").write_text("n")
    rows = {r.chapter_number: r.content for r in markdown.read_story(spark, str(tmp_path)).collect()}
    assert set(rows) == {2, 1_000_000} and rows[2].startswith("two ") and rows[2].endswith(" end")
    assert {r.chapter_number for r in markdown.read_chapters(spark, str(tmp_path)).collect()} == {1, 2, 1_000_000}
    with pytest.raises(ValueError):
        markdown.read_chapters(spark, f"{tmp_path}/x.pdf")


def test_documents_names_and_briefs(spark, tmp_path):
    rows = spark.createDataFrame([("s", "gate", i, "a.b", f"row {i}") for i in (2, 1)], "story string, band string, rank int, dimension string, summary string")
    assert sinks.brief(rows, "story", ["gate", "craft"], 1).first().brief == "## gate\n- **a.b**: row 1\n… 1 more\n\n## craft\n(none)"
    assert [(r.prefix, [f.rank for f in r.findings]) for r in sinks.by_dimension(rows, "story").collect()] == [("a", [1, 2])]
    path = f"file://{tmp_path}/doc"
    assert sinks.load_document(spark, path) is None
    sinks.save_document(spark.createDataFrame([("k", "{}")], "key string, document string"), path)
    assert [tuple(r) for r in sinks.load_document(spark, path).collect()] == [("k", "{}")]
    assert sinks.free_name(spark, f"file://{tmp_path}", "2024-01-02") == "report-2024-01-02.md"
    (tmp_path / "report-2024-01-02.md").write_text("x")
    assert sinks.free_name(spark, f"file://{tmp_path}", "2024-01-02") == "report-2024-01-02-2.md"
    assert sinks.terminal(rows, "Findings").startswith("Findings\n+")
