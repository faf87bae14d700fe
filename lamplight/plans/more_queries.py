"""Further queries: voices, caps, merges of maps and lists, windows of chapters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lamplight.functions import lexicons as L
from lamplight.operators import chunks, voice
from lamplight.operators import register as coined
from lamplight.plans.registry import register
from lamplight.plans.scalar_queries import _on_docs
from lamplight.plans.state_queries import CHAR, FIND, HIST, INTV, PHYS, characters, finding_rows, history, intervals, physical
from lamplight.plans.views import table

_on_docs("T01_front_matter", lambda: F.regexp_replace(F.concat(F.lit("---\ntitle: x\n---\n"), F.col("text")), r"(?s)\A\s*---\r?\n.*?\r?\n---\r?\n?", ""), "text")
_on_docs("F21_cue_families", lambda: voice.cue_families(F.col("text")),
    "list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(text), '{c}')" for c in cues) + (" THEN CASE WHEN " + " OR ".join(f"contains(lower(text), '{c}')" for c in L.CUES["sermon"]) + " THEN NULL ELSE 'monotone' END END" if k == "monotone" else f" THEN '{k}' END") for k, cues in sorted(L.CUES.items())) + "], lambda x: x IS NOT NULL)")
_on_docs("N26_span", lambda: F.concat(F.array_join(F.slice(F.split("text", " "), 1, 8), " "), F.lit("…")), "array_to_string((string_split(text, ' '))[1:8], ' ') || '…'")
_on_docs("N01_location", lambda: F.regexp_count(F.left("text", F.lit(400)), F.lit("\n")) + 1, "CAST(length(left(text, 400)) - length(replace(left(text, 400), chr(10), '')) + 1 AS INTEGER)")
register("T03_fact_scenes", lambda s, d: chunks.fact_scenes(table(s, d, "documents").select("doc_id", F.replace("text", F.lit(".\n"), F.lit(".\n---\n")).alias("content")), ["doc_id"]),
    r"""WITH c AS (SELECT doc_id, list_filter(list_transform(string_split_regex(replace(text, '.' || chr(10), '.' || chr(10) || '---' || chr(10)), '(?m)^\s*[-*_]{3,}\s*$'), lambda p: trim(p, ' ')), lambda p: length(p) >= 200) AS l FROM documents)
        SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS scene_index, unnest(l) AS scene FROM c""")  # fmt: skip
register("T08_packed_chunks", lambda s, d: chunks.chunked(table(s, d, "documents"), ["doc_id"], content="text"))
register("T09_lossless_chunks", lambda s, d: chunks.chunked(table(s, d, "documents"), ["doc_id"], chunks.lossless, "text").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk"))), lambda x: x["chunk"]), "").alias("text")),
    "SELECT doc_id, text FROM documents WHERE text <> ''")
register("T10_word_windows", lambda s, d: chunks.chunked(table(s, d, "documents"), ["doc_id"], chunks.word_windows, "text").select("doc_id", "chunk_index"))


def said(s, d):
    return table(s, d, "conversations").select(F.concat("role", (F.col("conv_id") % 6).cast("string")).alias("speaker"), F.explode(F.split("text", "\n")).alias("line")).filter("line <> ''")


_SAID = "sa AS (SELECT * FROM (SELECT role || (conv_id % 6) AS speaker, unnest(string_split(text, chr(10))) AS line FROM conversations) WHERE line <> '')"
_MET = f"""{_SAID}, w AS (SELECT *, len(regexp_extract_all(line, '[A-Za-z'']+')) AS n FROM sa), me AS (SELECT speaker, count(*) AS line_count, round(avg(n), 4) AS avg_words,
    round(avg(regexp_matches(line, '[A-Za-z]''[A-Za-z]')::INT), 4) AS contraction_rate, round(avg((n BETWEEN 1 AND 5)::INT), 4) AS fragment_rate, round(avg(regexp_matches(line, '(--|—)$')::INT), 4) AS interruption_rate FROM w GROUP BY 1)"""
register("A15_speaker_metrics", lambda s, d: voice.speaker_metrics(said(s, d), "speaker", "line"), f"WITH {_MET} SELECT * FROM me")
register("J10_collapsed_voices", lambda s, d: voice.collapsed(voice.speaker_metrics(said(s, d), "speaker", "line"), "speaker"),
    f"WITH {_MET} SELECT a.speaker AS a, b.speaker AS b FROM me a JOIN me b ON a.speaker < b.speaker AND abs(a.avg_words - b.avg_words) <= 2.0 AND abs(a.contraction_rate - b.contraction_rate) <= 0.1 AND abs(a.fragment_rate - b.fragment_rate) <= 0.1")
_CARDS = [(f"{r}{i}", v) for i in range(6) for r, v in (("user", "terse and colloquial"), ("assistant", "a sermon, fragmentary"), ("system", "monotone"))]
register("F17_given_name", lambda s, d: table(s, d, "part").select("p_partkey", voice.given_name(F.concat(F.lit("Dr. "), "p_name")).alias("alias")), "SELECT p_partkey, split_part(p_name, ' ', 1) AS alias FROM part")
register("J09_alias_collisions", lambda s, d: table(s, d, "part").select("p_partkey", voice.given_name(F.col("p_name")).alias("alias")).groupBy("alias").agg(F.countDistinct("p_partkey").alias("n")).filter("n > 1"),
    "SELECT split_part(p_name, ' ', 1) AS alias, count(DISTINCT p_partkey) AS n FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey) > 1")


def top(name, cap, order, sql):
    """The first rows of each story in an order of its own; windows stop at the cap."""
    register(name, lambda s, d: finding_rows(s, d).withColumn("rank", F.row_number().over(Window.partitionBy("story").orderBy(*order()))).filter(F.col("rank") <= cap).select("story", "rank", "finding_id"),
        f"WITH {FIND}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY story ORDER BY {sql}) AS INTEGER) AS rank FROM fd) SELECT story, rank, finding_id FROM r WHERE rank <= {cap}")


_S = "CASE severity WHEN 'concern' THEN 0 WHEN 'neutral' THEN 1 ELSE 2 END"
for _name, _cap, _by in [
    ("O05_repetition_cap", 40, "certainty DESC, finding_id"), ("O06_companion_cap", 25, "certainty DESC, verified DESC, finding_id"), ("O07_pattern_cap", 20, "certainty DESC, finding_id"),
    ("O09_voice_cap", 15, "verified DESC, finding_id"), ("O12_location_cap", 8, "finding_id"), ("O16_shape_cap", 3, "finding_id"),
]:
    top(_name, _cap, lambda by=_by: [F.expr(_S), *[F.expr(x.removesuffix(" DESC")).desc() if x.endswith(" DESC") else F.expr(x) for x in by.split(", ")]], f"{_S}, {_by}")
register("R13_order_warnings", lambda s, d: history(s, d).withColumn("mark", F.max("chapter").over(Window.partitionBy("user_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))).select("user_id", "seq", F.when(F.col("mark").isNull() | (F.col("chapter") == F.col("mark") + 1), "next").when(F.col("chapter") <= F.col("mark"), "regression").otherwise("skip").alias("kind")),
    f"WITH {HIST}, m AS (SELECT *, max(chapter) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM hs) SELECT user_id, seq, CASE WHEN mark IS NULL OR chapter = mark + 1 THEN 'next' WHEN chapter <= mark THEN 'regression' ELSE 'skip' END AS kind FROM m")
register("N03_unit_hits", lambda s, d: finding_rows(s, d).select("finding_id", F.explode(F.array_distinct("cited")).alias("chapter")), f"WITH {FIND} SELECT finding_id, unnest(list_distinct(cited)) AS chapter FROM fd")
register("N30_switches", lambda s, d: characters(s, d).select("slug", F.coalesce(F.col("died") > 5, ~(F.col("introduced") > 3)).alias("on")), f"WITH {CHAR} SELECT slug, coalesce(died > 5, NOT introduced > 3) AS \"on\" FROM ch")
register("W07_context_lines", lambda s, d: intervals(s, d).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("chapter").orderBy("s", "e", "weight").rowsBetween(-2, 2))).groupBy("chapter").agg(F.sum("n").alias("n")),
    f"WITH {INTV}, c AS (SELECT chapter, count(*) OVER (PARTITION BY chapter ORDER BY s, e, weight ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS n FROM iv) SELECT chapter, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1")


def _hyphened(s, d):
    return table(s, d, "documents").select("doc_id", F.replace("text", F.lit(" the "), F.lit("-the-")).alias("content"))


_TERMS = rf"""tx AS (SELECT doc_id, replace(text, ' the ', '-the-') AS content FROM documents),
    fo AS (SELECT doc_id, lower(content) AS low, regexp_extract_all(regexp_extract(content, '^\s*(?:\S+\s+){{0,299}}\S+', 0), '[A-Za-z]+(?:-[A-Za-z]+)+') AS l FROM tx),
    ex AS (SELECT doc_id, low, generate_subscripts(l, 1) AS pos, unnest(l) AS term FROM fo),
    fi AS (SELECT doc_id, lower(term) AS term, min(pos) AS pos, any_value(low) AS low FROM ex WHERE NOT regexp_matches(term, '^[A-Z][a-z]*(?:-[A-Z][a-z]*)+$') AND lower(term) NOT IN ({", ".join(f"'{w}'" for w in coined.PLAIN_COMPOUNDS)}) GROUP BY 1, 2),
    rk AS (SELECT doc_id, term, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS rank, CAST((length(low) - length(replace(low, term, ''))) // length(term) AS BIGINT) AS count FROM fi)"""
register("W14_term_rank", lambda s, d: coined.coined_terms(_hyphened(s, d), "doc_id"),
    f"WITH {_TERMS} SELECT doc_id, term, rank, count, CASE WHEN rank < 3 AND count >= 5 THEN 'high' WHEN rank < 5 THEN 'moderate' ELSE 'low' END AS severity FROM rk")
register("Q05_register_overruns", lambda s, d: coined.overruns(coined.coined_terms(_hyphened(s, d), "doc_id"), "doc_id"),
    f"WITH {_TERMS} SELECT doc_id, count(*) AS terms, CASE WHEN count(*) - 3 >= 2 THEN 'high' ELSE 'moderate' END AS severity FROM rk GROUP BY 1 HAVING count(*) > 3")
