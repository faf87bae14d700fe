"""Queries of findings: buckets, verdicts, ratings, weights, merges. Findings are made from the events, one each."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamplight.operators import findings as FN
from lamplight.operators import judging as J
from lamplight.plans.registry import register
from lamplight.plans.views import table

N = 5
DIMS = [*J.PROSE, *J.NARRATIVE, *J.CONSISTENCY]


def rows(s, d):
    """finding_id, story, dimension, severity, evidence, counter_evidence, quote_verified, cited, summary, chapter_ref."""
    return table(s, d, "events").selectExpr(
        "event_id AS finding_id", "CAST(user_id % 10 AS INT) AS story", f"element_at(array({', '.join(repr(x) for x in DIMS)}), CAST(event_id % 15 + 1 AS INT)) AS dimension",
        "CASE event_id % 4 WHEN 0 THEN 'strength' WHEN 1 THEN 'neutral' ELSE 'concern' END AS severity", "CASE WHEN event_id % 7 > 0 THEN concat('Ch ', event_id % 9, ': x') ELSE ' ' END AS evidence",
        "CASE event_id % 3 WHEN 0 THEN 'Ch 5:  Y' WHEN 1 THEN concat('ch ', event_id % 9, ':  X') END AS counter_evidence", "CASE event_id % 5 WHEN 0 THEN false WHEN 1 THEN true END AS quote_verified",
        "array_sort(array_distinct(array(CAST(event_id % 9 AS INT), CAST(event_id % 4 AS INT)))) AS cited", "concat('in 3 and ', event_id % 9) AS summary", "CAST(event_id % 6 AS STRING) AS chapter_ref")


V = f"""vf AS (SELECT event_id AS finding_id, CAST(user_id % 10 AS INTEGER) AS story, ([{', '.join(repr(x) for x in DIMS)}])[event_id % 15 + 1] AS dimension, CASE event_id % 4 WHEN 0 THEN 'strength' WHEN 1 THEN 'neutral' ELSE 'concern' END AS severity,
    CASE WHEN event_id % 7 > 0 THEN 'ch ' || event_id % 9 || ': x' ELSE '' END AS ev, CASE event_id % 3 WHEN 0 THEN 'ch 5: y' WHEN 1 THEN 'ch ' || event_id % 9 || ': x' ELSE '' END AS co,
    CASE event_id % 5 WHEN 0 THEN false WHEN 1 THEN true END AS ok, event_id % 9 AS c1, event_id % 4 AS c2 FROM events)"""
_GATE, _INFO = (", ".join(repr(x) for x in q) for q in (J.GATE, J.INFO))
_TWO = "(ev <> '' AND co <> '' AND ev <> co)"
_OLD, _HERE = f"(c1 < {N} AND c2 < {N})", f"(c1 = {N} OR c2 = {N})"
register("Q11_partition", lambda s, d: FN.partitioned(rows(s, d), N, J.GATE).select("finding_id", "bucket"),
    f"WITH {V} SELECT finding_id, CASE WHEN {_OLD} THEN 'preexisting' WHEN coalesce(ok, true) AND {_HERE} AND {_TWO} THEN 'gate' ELSE 'ungrounded' END AS bucket FROM vf WHERE severity = 'concern' AND dimension IN ({_GATE})")
register("Q11_sweep", lambda s, d: FN.partitioned(rows(s, d), N, J.GATE, True).select("finding_id", "bucket"),
    f"WITH {V} SELECT finding_id, CASE WHEN coalesce(ok, true) AND {_TWO} THEN 'gate' ELSE 'ungrounded' END AS bucket FROM vf WHERE severity = 'concern' AND dimension IN ({_GATE})")
register("Q11_informed", lambda s, d: FN.informed(rows(s, d), N, J.INFO).select("finding_id", "grounded"),
    f"WITH {V} SELECT finding_id, coalesce(ok, true) AND ev <> '' AND {_HERE} AS grounded FROM vf WHERE severity = 'concern' AND dimension IN ({_INFO}) AND NOT {_OLD}")
_DRIVE = [*J.GATE, *J.PROSE[1:]]
register("A26_verdict", lambda s, d: FN.verdict(rows(s, d).withColumn("story", F.expr("finding_id div 3")), "story", _DRIVE),
    f"""WITH {V}, f AS (SELECT finding_id // 3 AS story, dimension, severity = 'concern' AND dimension IN ({', '.join(repr(x) for x in _DRIVE)}) AS c FROM vf)
        SELECT story, CASE WHEN bool_or(c) THEN 'watch' ELSE 'ship' END AS verdict, coalesce(string_agg(DISTINCT dimension, ',' ORDER BY dimension) FILTER (c), '') AS drivers FROM f GROUP BY 1""")  # fmt: skip
_ALL = [*J.GATE, *J.INFO]
register("A20_ratings", lambda s, d: FN.ratings(rows(s, d), s.createDataFrame([(x,) for x in [*_ALL, "consistency.none"]], "dimension string")),
    f"""WITH {V}, m AS (SELECT unnest([{', '.join(repr(x) for x in [*_ALL, 'consistency.none'])}]) AS dimension), f AS (SELECT dimension, arg_min(severity, CASE severity WHEN 'concern' THEN 0 WHEN 'neutral' THEN 1 ELSE 2 END * 1000000000 + finding_id) AS severity FROM vf GROUP BY 1)
        SELECT dimension, coalesce(severity, 'neutral') AS severity FROM m LEFT JOIN f USING (dimension)""")  # fmt: skip
_SOME = J.NARRATIVE[:2]
register("A27_grounded_ratings", lambda s, d: FN.grounded_ratings(rows(s, d).withColumn("story", F.expr("finding_id div 20")), _SOME, N, "story"),
    f"""WITH {V}, f AS (SELECT *, finding_id // 20 AS st FROM vf), m AS (SELECT DISTINCT st, unnest(['{_SOME[0]}', '{_SOME[1]}']) AS dimension FROM f),
        g AS (SELECT st, dimension, arg_min(severity, finding_id) AS severity, bool_or(severity = 'concern') AS c, bool_or(severity = 'concern' AND {_HERE} AND ev <> '') AS g FROM f GROUP BY 1, 2)
        SELECT st AS story, dimension, CASE WHEN c AND NOT g THEN 'neutral' ELSE coalesce(severity, 'neutral') END AS severity FROM m LEFT JOIN g USING (st, dimension)""")  # fmt: skip
register("R12_hit_weights", lambda s, d: FN.hit_weights(rows(s, d).select("story", F.explode("cited").alias("chapter_number")), rows(s, d), True),
    f"""WITH {V}, k AS (SELECT DISTINCT story, unnest([c1, c2]) AS chapter_number FROM vf), n AS (SELECT story, unnest([3, c1]) AS chapter_number FROM vf), c AS (SELECT story, chapter_number, count(*) AS n FROM n GROUP BY 1, 2),
        r AS (SELECT DISTINCT story, finding_id % 6 AS chapter_number, 5.0 AS f FROM vf)
        SELECT story, CAST(chapter_number AS INTEGER) AS chapter_number, CAST((1 + 2 * coalesce(n, 0)) * coalesce(f, 1) AS DOUBLE) AS weight FROM k LEFT JOIN c USING (story, chapter_number) LEFT JOIN r USING (story, chapter_number)""")  # fmt: skip
register("W13_ranked_anew", lambda s, d: FN.prioritized(rows(s, d).filter("severity <> 'strength'").withColumn("certainty", F.lit(0.5)), "story").select("finding_id", "rank"),
    f"WITH {V} SELECT finding_id, CAST(row_number() OVER (PARTITION BY story ORDER BY CASE severity WHEN 'concern' THEN 0 ELSE 1 END, dimension, finding_id) AS INTEGER) AS rank FROM vf WHERE severity <> 'strength'")


def rated(s, d, part):
    return rows(s, d).filter(f"finding_id % 3 = {part}").groupBy("story", "dimension").agg(F.min_by("severity", "finding_id").alias("severity"))


register("U06_last_wins", lambda s, d: FN.last_wins(rated(s, d, 0), rated(s, d, 1), ["story", "dimension"]),
    f"""WITH {V}, r AS (SELECT story, dimension, finding_id % 3 AS p, arg_min(severity, finding_id) AS severity FROM vf GROUP BY 1, 2, 3)
        SELECT story, dimension, arg_max(severity, p) AS severity FROM r WHERE p < 2 GROUP BY 1, 2""")  # fmt: skip
register("U07_unique_warnings", lambda s, d: FN.warnings(rows(s, d).select("story", F.col("finding_id").alias("list_no"), F.array("summary", "chapter_ref").alias("warnings")), "story").select("story", F.array_join("warnings", "|").alias("warnings")),
    f"""WITH {V}, w AS (SELECT story, finding_id * 2 AS o, 'in 3 and ' || c1 AS w FROM vf UNION ALL SELECT story, finding_id * 2 + 1, CAST(finding_id % 6 AS VARCHAR) FROM vf), m AS (SELECT story, w, min(o) AS o FROM w GROUP BY 1, 2)
        SELECT story, string_agg(w, '|' ORDER BY o) AS warnings FROM m GROUP BY 1""")  # fmt: skip


def pairs(s, d):
    """Answers of a judge of exchanges and of comedy: one for each turn."""
    k = F.col("turn") * 7 + F.col("conv_id") % 11
    return table(s, d, "conversations").select(F.expr("conv_id % 9").alias("chapter"), F.when(k % 5 == 0, "recast").when(k % 13 == 0, "echo").when(k % 97 == 0, "tag").alias("form"), F.when(k % 8 < 5, "quip").when(k % 8 == 5, F.when(F.col("conv_id") % 3 == 0, "situation")).otherwise("none").alias("source"))


_P = """pa AS (SELECT conv_id % 9 AS chapter, turn * 7 + conv_id % 11 AS k, conv_id FROM conversations), pr AS (SELECT chapter, CASE WHEN k % 5 = 0 THEN 'recast' WHEN k % 13 = 0 THEN 'echo' WHEN k % 97 = 0 THEN 'tag' END AS form,
    CASE WHEN k % 8 < 5 THEN 'quip' WHEN k % 8 = 5 THEN CASE WHEN conv_id % 3 = 0 THEN 'situation' END ELSE 'none' END AS source FROM pa)"""
register("A28_forms", lambda s, d: FN.forms(pairs(s, d), "chapter"),
    f"WITH {_P}, t AS (SELECT chapter, count(*) AS p FROM pr GROUP BY 1), n AS (SELECT chapter, form, count(*) AS n FROM pr WHERE form IS NOT NULL GROUP BY 1, 2) SELECT chapter, form, n, round(n / p, 4) AS share, round(n / p, 4) >= 0.02 AND n >= 2 AS habit FROM n JOIN t USING (chapter)")
register("A29_quip_mix", lambda s, d: FN.quip_mix(pairs(s, d), "chapter"),
    f"WITH {_P}, c AS (SELECT chapter, count(*) FILTER (source IN ('quip', 'situation')) AS comic, count(*) FILTER (source = 'situation') AS g FROM pr GROUP BY 1) SELECT chapter, comic, CASE WHEN g / comic < 0.1 THEN 'high' ELSE 'moderate' END AS severity FROM c WHERE comic >= 4 AND g / comic < 0.25")
register("A14_guarded_shares", lambda s, d: pairs(s, d).groupBy("chapter").agg(F.count_if(F.col("source") == "situation").alias("grown"), F.round(F.try_divide(F.count_if(F.col("source") == "situation"), F.count_if(F.col("form") == "tag")), 4).alias("share")),
    f"WITH {_P} SELECT chapter, count(*) FILTER (source = 'situation') AS grown, round(count(*) FILTER (source = 'situation') / nullif(count(*) FILTER (form = 'tag'), 0), 4) AS share FROM pr GROUP BY 1")


def calls(s, d):
    """Calls of models: the part is the model, its quantity the tokens, the ship mode the kind of cache."""
    return table(s, d, "lineitem").select(F.col("l_linestatus").alias("model"), F.col("l_quantity").cast("long").alias("tokens"), F.col("l_returnflag").alias("kind"), (F.col("l_linenumber") > 3).alias("hit"))


register("A21_usage_rollup", lambda s, d: FN.usage(calls(s, d)), "SELECT l_linestatus AS model, count(*) AS calls, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS tokens FROM lineitem GROUP BY ROLLUP (l_linestatus)")
register("A22_cache_counts", lambda s, d: calls(s, d).groupBy("kind").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses")), "SELECT l_returnflag AS kind, count(*) FILTER (l_linenumber > 3) AS hits, count(*) FILTER (l_linenumber <= 3) AS misses FROM lineitem GROUP BY 1")
register("A23_merged_stats", lambda s, d: FN.merged_stats(rows(s, d).select("story", F.col("dimension").alias("agent"), (F.col("severity") == "concern").cast("long").alias("concerns"), F.coalesce("quote_verified", F.lit(False)).cast("long").alias("verified"), F.size("cited").cast("long").alias("citations")), "story"),
    f"WITH {V} SELECT story, count(*) FILTER (severity = 'concern') AS concerns, count(*) FILTER (ok) AS verified, CAST(sum(CASE WHEN c1 = c2 THEN 1 ELSE 2 END) AS BIGINT) AS citations FROM vf GROUP BY 1")
