"""Queries of parsed answers. The answers are made from the documents: arrays and objects of JSON, in fences, in talk, broken."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamplight.operators import judging as J
from lamplight.plans.registry import register
from lamplight.plans.views import table


def answers(s, d):
    """doc_id, k (of seven kinds), object, findings."""
    docs, k = table(s, d, "documents"), F.col("doc_id") % 7
    item = F.concat(F.lit('{"dimension": "consistency.timeline", "severity": "concern", "summary": "s'), F.col("doc_id").cast("string"), F.lit('", "evidence": "e [", "signal_kind": "Wrong_Place"}'))
    sheet = F.concat(F.lit('{"characters": ["Ann", {"name": "Bo", "details": "tall"}], "location": "'), "source", F.lit('", "established_facts": [" f ", null, ""]}'))
    found = F.when(k == 0, F.concat(F.lit("["), item, F.lit("]"))).when(k == 1, F.concat(F.lit("```json\n["), item, F.lit(", "), item, F.lit("]\n```"))).when(k == 2, F.concat(F.lit('Here "[" it is: ['), item, F.lit("] done"))).when(k == 3, "[]").when(k == 4, '["oops"]').when(k == 5, F.concat(F.lit('{"items": ['), item, F.lit("]}"))).otherwise("nothing")
    made = F.when(k == 0, sheet).when(k == 1, F.concat(F.lit("```json\n"), sheet, F.lit("\n```"))).when(k == 2, F.concat(F.lit("So: "), sheet)).when(k == 3, "{}").when(k == 4, F.concat(F.lit("["), sheet, F.lit("]"))).otherwise("{broken")
    return docs.select("doc_id", k.cast("int").alias("k"), made.alias("object"), found.alias("findings"))


register("N16_findings", lambda s, d: J.parsed(answers(s, d), "findings", J.findings_of, J.FINDINGS, "consistency").select("doc_id", F.posexplode("parsed").alias("n", "f")).select("doc_id", "n", "f.dimension", "f.summary", "f.signal_kind"),
    """WITH a AS (SELECT doc_id, doc_id % 7 AS k FROM documents), n AS (SELECT doc_id, k, unnest(CASE k WHEN 0 THEN [0] WHEN 1 THEN [0, 1] WHEN 2 THEN [0] WHEN 3 THEN [] ELSE [0] END) AS n FROM a)
       SELECT doc_id, CAST(n AS INTEGER) AS n, CASE WHEN k < 3 THEN 'consistency.timeline' ELSE 'consistency.general' END AS dimension,
         CASE WHEN k < 3 THEN 's' || doc_id ELSE 'Consistency check failed to parse structured findings' END AS summary, CASE WHEN k < 3 THEN 'wrong_place' END AS signal_kind FROM n""")  # fmt: skip
register("M15_fact_sheets", lambda s, d: J.parsed(answers(s, d), "object", J.facts_of, J.FACTS).select("doc_id", F.size("parsed.characters").alias("characters"), F.array_join("parsed.established_facts", "|").alias("facts"), F.col("parsed.location").alias("location"), "parsed.parse_failed"),
    """WITH a AS (SELECT doc_id, source, doc_id % 7 < 3 AS ok FROM documents)
       SELECT doc_id, CASE WHEN ok THEN 2 ELSE 0 END AS characters, CASE WHEN ok THEN 'f' ELSE '' END AS facts, CASE WHEN ok THEN source ELSE '' END AS location, NOT ok AS parse_failed FROM a""")  # fmt: skip
register("M14_json_values", lambda s, d: J.parsed(answers(s, d), "object", lambda a: J.decoded(a, "{") is not None, "boolean").select("doc_id", F.col("parsed").alias("is_object")), "SELECT doc_id, doc_id % 7 < 4 AS is_object FROM documents")
register("T23_json_starts", lambda s, d: J.parsed(answers(s, d), "findings", lambda a: [c for _, c in J.openings(a)], "array<string>").select("doc_id", F.array_join("parsed", "").alias("opens")),
    "SELECT doc_id, CASE doc_id % 7 WHEN 5 THEN '{' WHEN 6 THEN '' ELSE '[' END AS opens FROM documents")
register("N17_enrich_map", lambda s, d: J.parsed(table(s, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('{"a": {"summary": "'), F.col("doc_id").cast("string"), F.lit('"}, "b": 3}'))).otherwise("[1]").alias("raw")), "raw", J.enrich_map, J.ENRICHED).select("doc_id", F.explode("parsed").alias("f")).select("doc_id", "f.dimension", "f.summary"),
    "SELECT doc_id, 'a' AS dimension, CAST(doc_id AS VARCHAR) AS summary FROM documents WHERE doc_id % 2 = 0")
register("N19_parse_failed", lambda s, d: J.parsed(answers(s, d), "object", J.facts_of, J.FACTS).agg(F.count_if("parsed.parse_failed").alias("failed")).withColumn("warning", J.failed_text(F.col("failed"))),
    "SELECT count(*) FILTER (doc_id % 7 >= 3) AS failed, (count(*) FILTER (doc_id % 7 >= 3)) || ' fact sheet(s) could not be parsed' AS warning FROM documents")
register("F27_fences", lambda s, d: table(s, d, "documents").select("doc_id", J.without_fences(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" ```json\n"), "text", F.lit("\n```"))).otherwise(F.col("text"))).alias("out")),
    "SELECT doc_id, trim(text, ' ') AS out FROM documents")
_KIND = "CASE doc_id % 5 WHEN 0 THEN ' Wrong_Place ' WHEN 1 THEN 'other' WHEN 2 THEN 'mystery' WHEN 3 THEN '  ' END"
register("F28_signal_kind", lambda s, d: table(s, d, "documents").select("doc_id", J.signal_kind(F.expr(_KIND)).alias("out")), "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'wrong_place' WHEN 1 THEN 'other' WHEN 2 THEN 'other' END AS out FROM documents")
register("N29_dimensions", lambda s, d: J.dimensions(s).groupBy("pack").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("role") == "gate").alias("gates")), "SELECT * FROM (VALUES ('prose', 5, 0), ('narrative', 5, 0), ('consistency', 5, 3)) t(pack, n, gates)")


def findings(s, d):
    return table(s, d, "events").selectExpr("event_id AS finding_id", "CAST(user_id % 10 AS INT) AS story", "concat('dim', event_id % 15) AS dimension", "CASE event_id % 5 WHEN 0 THEN 'concern' WHEN 1 THEN 'strength' WHEN 2 THEN 'neutral' END AS severity",
        "CASE WHEN event_id % 4 > 0 THEN value END AS certainty", "CASE WHEN event_id % 3 > 0 THEN 'Ch 1: x' ELSE ' ' END AS evidence", "'was' AS summary", "'1' AS chapter_ref", "'' AS counter_evidence", "CASE WHEN event_id % 10 = 0 THEN 'Tone_Understatement' END AS signal_kind")


FIND = """jf AS (SELECT event_id AS finding_id, CAST(user_id % 10 AS INTEGER) AS story, 'dim' || (event_id % 15) AS dimension, CASE event_id % 5 WHEN 0 THEN 'concern' WHEN 1 THEN 'strength' WHEN 2 THEN 'neutral' END AS severity,
    CASE WHEN event_id % 4 > 0 THEN value END AS certainty FROM events)"""
_R = "CASE coalesce(severity, 'neutral') WHEN 'concern' THEN 0 WHEN 'neutral' THEN 1 ELSE 2 END"
register("M08_needs_enrich", lambda s, d: findings(s, d).select("finding_id", F.coalesce(J.needs_enrich(F.col("severity"), F.col("certainty") / 10, True), F.lit(False)).alias("needs")),
    f"WITH {FIND} SELECT finding_id, coalesce(severity IN ('concern', 'strength') OR certainty / 10 < 0.55, false) AS needs FROM jf")
register("L10_demoted", lambda s, d: J.demoted(findings(s, d)).select("finding_id", "severity"),
    f"WITH {FIND} SELECT finding_id, CASE WHEN severity = 'concern' AND (finding_id % 3 = 0 OR finding_id % 10 = 0) THEN 'neutral' ELSE severity END AS severity FROM jf")
register("N12_ranked", lambda s, d: J.ranked(findings(s, d), "story").select("finding_id", "rank", "severity"),
    f"WITH {FIND} SELECT finding_id, CAST(row_number() OVER (PARTITION BY story ORDER BY {_R}, coalesce(certainty, 0) DESC, dimension, finding_id) AS INTEGER) AS rank, coalesce(severity, 'neutral') AS severity FROM jf")
register("N11_dropped_dimensions", lambda s, d: J.without_dimensions(findings(s, d), s.createDataFrame([("dim3",), ("dim7",)], "dimension string"), "story").select("finding_id", "rank"),
    f"WITH {FIND} SELECT finding_id, CAST(row_number() OVER (PARTITION BY story ORDER BY {_R}, coalesce(certainty, 0) DESC, dimension, finding_id) AS INTEGER) AS rank FROM jf WHERE dimension NOT IN ('dim3', 'dim7')")


def better(s, d):
    return table(s, d, "part").filter("p_partkey < 15").select(F.concat(F.lit("dim"), F.col("p_partkey").cast("string")).alias("dimension"), F.col("p_name").alias("summary"), F.lit(" ").alias("evidence"), F.lit(None).cast("string").alias("chapter_ref"), F.lit("c").alias("counter_evidence"))


register("J19_enriched", lambda s, d: J.enriched(findings(s, d), better(s, d)).select("finding_id", "severity", "summary", "evidence", "counter_evidence"),
    f"""WITH {FIND} SELECT finding_id, severity, coalesce(p_name, 'was') AS summary, CASE WHEN finding_id % 3 > 0 THEN 'Ch 1: x' ELSE ' ' END AS evidence, CASE WHEN p_name IS NULL THEN '' ELSE 'c' END AS counter_evidence
        FROM jf LEFT JOIN part ON p_partkey < 15 AND dimension = 'dim' || p_partkey""")  # fmt: skip
register("L03_judged", lambda s, d: J.judged(answers(s, d).select("doc_id", F.col("findings").alias("prompt")), "prompt", "prose", lambda c: c).groupBy("dimension").agg(F.count(F.lit(1)).alias("n")),
    "WITH a AS (SELECT doc_id % 7 AS k FROM documents) SELECT CASE WHEN k < 3 THEN 'consistency.timeline' ELSE 'prose.general' END AS dimension, CAST(sum(CASE k WHEN 1 THEN 2 WHEN 3 THEN 0 ELSE 1 END) AS BIGINT) AS n FROM a WHERE k <> 3 GROUP BY 1")
register("L01_fact_sheets", lambda s, d: J.fact_sheets(answers(s, d).select("doc_id", F.col("object").alias("prompt")), "prompt", lambda c: c).agg(F.count(F.lit(1)).alias("sheets"), F.count_if("sheet.parse_failed").alias("failed")), "SELECT count(*) AS sheets, count(*) FILTER (doc_id % 7 >= 3) AS failed FROM documents")


def retries(s, d):
    return table(s, d, "lineitem").select(F.expr("l_orderkey % 50").alias("story"), F.col("l_orderkey").alias("finding_id"), F.col("l_linenumber").cast("int").alias("chapter")).distinct()


register("O14_recovery_order", lambda s, d: J.to_recover(retries(s, d), "story", 4).select("story", "call", "finding_id", "chapter"),
    """WITH c AS (SELECT DISTINCT l_orderkey % 50 AS story, l_orderkey AS finding_id, CAST(l_linenumber AS INTEGER) AS chapter FROM lineitem),
       t AS (SELECT *, row_number() OVER (PARTITION BY story, finding_id ORDER BY chapter <> 4, abs(chapter - 4), chapter) AS try FROM c),
       k AS (SELECT *, CAST(row_number() OVER (PARTITION BY story ORDER BY finding_id, try) AS INTEGER) AS call FROM t WHERE try <= 3) SELECT story, call, finding_id, chapter FROM k WHERE call <= 5""")  # fmt: skip
register("L14_rewrites", lambda s, d: J.to_rewrite(J.ranked(findings(s, d), "story"), "story").select("story", "n", "finding_id"),
    f"""WITH {FIND}, r AS (SELECT *, row_number() OVER (PARTITION BY story ORDER BY coalesce(certainty, 0) DESC, dimension, finding_id) AS o FROM jf WHERE severity = 'concern' AND finding_id % 3 > 0)
        SELECT story, CAST(o AS INTEGER) AS n, finding_id FROM r WHERE o <= 5""")  # fmt: skip
register("N07_predicates", lambda s, d: findings(s, d).select("finding_id", J.without_evidence().alias("empty"), J.repetition_concern().alias("repetition")), "SELECT event_id AS finding_id, event_id % 3 = 0 AS empty, false AS repetition FROM events WHERE event_id % 5 < 3 UNION ALL SELECT event_id, event_id % 3 = 0, CASE WHEN false THEN true ELSE false END FROM events WHERE event_id % 5 >= 3")
register("N13_normal_rows", lambda s, d: J.normal_rows(table(s, d, "part").select("p_partkey", F.expr("CASE p_partkey % 3 WHEN 0 THEN 'card_collapse' WHEN 1 THEN 'odd' END").alias("kind"), F.expr("CASE WHEN p_partkey % 2 = 0 THEN 'high' ELSE 'dire' END").alias("severity"), F.expr("CASE WHEN p_partkey % 5 = 0 THEN '  ' ELSE p_name END").alias("quote")), ["card_collapse"], "card_mismatch", ["quote"]),
    "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'card_collapse' ELSE 'card_mismatch' END AS kind, CASE WHEN p_partkey % 2 = 0 THEN 'high' ELSE 'low' END AS severity, CASE WHEN p_partkey % 5 > 0 THEN p_name END AS quote FROM part")
register("N15_finding_lines", lambda s, d: J.finding_lines(J.ranked(findings(s, d), "story").filter("rank <= 5"), "story"),
    f"""WITH {FIND}, r AS (SELECT *, row_number() OVER (PARTITION BY story ORDER BY {_R}, coalesce(certainty, 0) DESC, dimension, finding_id) AS o FROM jf)
        SELECT story, string_agg('- [' || coalesce(severity, 'neutral') || '] ' || dimension || ': was (ch 1)', chr(10) ORDER BY o) AS block FROM r WHERE o <= 5 GROUP BY 1""")  # fmt: skip
