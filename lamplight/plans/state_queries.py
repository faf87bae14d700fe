"""Queries of state, audit, interval, finding and vector operators over tables derived from the driver's."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lamplight.operators import findings as FN
from lamplight.operators import state as ST
from lamplight.operators import vectors
from lamplight.plans.registry import register
from lamplight.plans.views import table

N = 12


def characters(s, d):
    return table(s, d, "customer").selectExpr(
        "concat('c', c_custkey) AS slug", "c_name AS name", "CASE WHEN c_custkey % 7 = 0 THEN 'dead' ELSE 'active' END AS status", "CAST(c_custkey % 10 + 1 AS INT) AS introduced",
        "CAST(CASE WHEN c_custkey % 7 = 0 THEN c_custkey % 20 + 1 END AS INT) AS died", "CAST(c_custkey % 25 + 1 AS INT) AS last_seen")


CHAR = """ch AS (SELECT 'c' || c_custkey AS slug, c_name AS name, CASE WHEN c_custkey % 7 = 0 THEN 'dead' ELSE 'active' END AS status, CAST(c_custkey % 10 + 1 AS INTEGER) AS introduced,
    CAST(CASE WHEN c_custkey % 7 = 0 THEN c_custkey % 20 + 1 END AS INTEGER) AS died, CAST(c_custkey % 25 + 1 AS INTEGER) AS last_seen FROM customer)"""


def seeds(s, d):
    return table(s, d, "orders").selectExpr("concat('s', o_orderkey) AS slug", "o_orderpriority AS priority", "month(o_orderdate) AS planted", "CAST(CASE WHEN o_orderkey % 3 > 0 THEN month(o_orderdate) + o_orderkey % 6 - 1 END AS INT) AS resolved")


SEED = "sd AS (SELECT 's' || o_orderkey AS slug, o_orderpriority AS priority, CAST(month(o_orderdate) AS INTEGER) AS planted, CAST(CASE WHEN o_orderkey % 3 > 0 THEN month(o_orderdate) + o_orderkey % 6 - 1 END AS INTEGER) AS resolved FROM orders)"


def physical(s, d):
    return table(s, d, "lineitem").selectExpr("l_partkey AS entity", "CAST(l_suppkey % 10 AS INT) AS attribute", "concat(l_returnflag, l_linestatus) AS value", "month(l_shipdate) AS chapter", "l_orderkey * 10 + l_linenumber AS file_pos")


PHYS = "ps AS (SELECT l_partkey AS entity, CAST(l_suppkey % 10 AS INTEGER) AS attribute, l_returnflag || l_linestatus AS value, CAST(month(l_shipdate) AS INTEGER) AS chapter, l_orderkey * 10 + l_linenumber AS file_pos FROM lineitem)"


def history(s, d):
    return table(s, d, "events").selectExpr("user_id", "event_type AS state", "hour(ts) AS chapter", "event_id AS seq", "value")


HIST = "hs AS (SELECT user_id, event_type AS state, CAST(hour(ts) AS INTEGER) AS chapter, event_id AS seq, value FROM events)"


def finding_rows(s, d):
    return table(s, d, "events").selectExpr(
        "event_id AS finding_id", "CAST(user_id % 10 AS INT) AS story", "concat('dim', event_id % 15) AS dimension",
        "CASE event_id % 5 WHEN 0 THEN 'concern' WHEN 1 THEN 'strength' ELSE 'neutral' END AS severity", "value AS certainty",
        "event_id % 2 = 0 AS verified", "array(CAST(event_id % 20 AS INT), CAST(event_id % 7 AS INT)) AS cited")


FIND = """fd AS (SELECT event_id AS finding_id, CAST(user_id % 10 AS INTEGER) AS story, 'dim' || (event_id % 15) AS dimension,
    CASE event_id % 5 WHEN 0 THEN 'concern' WHEN 1 THEN 'strength' ELSE 'neutral' END AS severity, value AS certainty, event_id % 2 = 0 AS verified,
    [CAST(event_id % 20 AS INTEGER), CAST(event_id % 7 AS INTEGER)] AS cited FROM events)"""
_RANK = "CASE severity WHEN 'concern' THEN 0 WHEN 'neutral' THEN 1 ELSE 2 END"


def dims(s):
    return s.range(18).selectExpr("concat('dim', id) AS dimension")


DIMS = "dm AS (SELECT 'dim' || range AS dimension FROM range(18))"

register("R01_before", lambda s, d: characters(s, d).filter(ST.before(F.col("died"), N)).select("slug"), f"WITH {CHAR} SELECT slug FROM ch WHERE died IS NULL OR died < {N}")
register("R03_secret_as_of", lambda s, d: ST.state_as_of(history(s, d), "user_id", "state", "chapter", N),
    f"WITH {HIST} SELECT user_id, arg_max(state, chapter * 10000000000 + seq) AS state, max(chapter) AS since FROM hs WHERE chapter < {N} GROUP BY 1")
register(
    "R04_knowers_as_of",
    lambda s, d: history(s, d).groupBy("state", "user_id").agg(F.min("chapter").alias("since")).filter(F.col("since") < N).groupBy("state").agg(F.count(F.lit(1)).alias("knowers")),
    f"WITH {HIST}, k AS (SELECT state, user_id, min(chapter) AS since FROM hs GROUP BY 1, 2) SELECT state, count(*) AS knowers FROM k WHERE since < {N} GROUP BY 1",
)
register("R05_open_seeds", lambda s, d: ST.open_seeds(seeds(s, d), 6), f"WITH {SEED} SELECT * FROM sd WHERE planted < 6 AND (resolved IS NULL OR resolved >= 6)")
register("R06_temporal_issues", lambda s, d: ST.temporal_issues(characters(s, d), seeds(s, d)),
    f"""WITH {CHAR}, {SEED} SELECT 'seen_after_death' AS kind, slug AS entity FROM ch WHERE last_seen > died UNION ALL SELECT 'seed_resolved_when_planted', slug FROM sd WHERE resolved = planted
        UNION ALL SELECT 'seed_resolved_before_planted', slug FROM sd WHERE resolved < planted""")  # fmt: skip
register("W10_latest", lambda s, d: ST.latest(physical(s, d), ["entity", "attribute"], ["chapter", "file_pos"], "value"),
    f"WITH {PHYS} SELECT entity, attribute, arg_max(value, chapter * 100000000000 + file_pos) AS value, max(chapter) AS chapter FROM ps GROUP BY 1, 2")
register("W11_last_rows", lambda s, d: ST.last_rows(physical(s, d), ["entity"], [F.desc("chapter"), F.desc("file_pos")]),
    f"WITH {PHYS}, r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY chapter DESC, file_pos DESC) AS n FROM ps) SELECT entity, attribute, value, chapter, file_pos FROM r WHERE n <= 3")
register("W12_sequence_ids", lambda s, d: seeds(s, d).select("slug", F.concat(F.left("priority", F.lit(1)), F.row_number().over(Window.partitionBy(F.left("priority", F.lit(1))).orderBy("slug")).cast("string")).alias("id")),
    f"WITH {SEED} SELECT slug, left(priority, 1) || row_number() OVER (PARTITION BY left(priority, 1) ORDER BY slug) AS id FROM sd")
register("J16_unrecorded", lambda s, d: ST.unrecorded(physical(s, d), "entity", "chapter", 12),
    f"""WITH {PHYS}, e AS (SELECT DISTINCT entity FROM ps), x AS (SELECT entity, CAST(range AS INTEGER) AS c FROM e, range(1, 13)),
        g AS (SELECT entity, c FROM x EXCEPT SELECT entity, chapter FROM ps) SELECT entity, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS missing FROM g GROUP BY 1""")  # fmt: skip
register("S11_discovery_gaps", lambda s, d: ST.unrecorded(physical(s, d).filter("chapter <= 6"), "entity", "chapter", 6),
    f"""WITH {PHYS}, e AS (SELECT DISTINCT entity FROM ps WHERE chapter <= 6), x AS (SELECT entity, CAST(range AS INTEGER) AS c FROM e, range(1, 7)),
        g AS (SELECT entity, c FROM x EXCEPT SELECT entity, chapter FROM ps) SELECT entity, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS missing FROM g GROUP BY 1""")  # fmt: skip
register("J15_missing_files", lambda s, d: characters(s, d).select("slug").join(seeds(s, d).select(F.concat(F.lit("c"), F.substring("slug", 2, 100)).alias("slug")), "slug", "left_anti"),
    f"WITH {CHAR}, {SEED} SELECT slug FROM ch WHERE slug NOT IN (SELECT 'c' || substr(slug, 2) FROM sd)")
register("A16_vague_timeline", lambda s, d: ST.vague_timeline(history(s, d).withColumn("state", F.expr("CASE WHEN seq % 4 > 0 THEN state END")).withColumn("user_id", F.expr("user_id * 10 + chapter div 3")), "user_id", "state").select("user_id", "rows", "share"),
    f"""WITH {HIST}, h AS (SELECT user_id * 10 + chapter // 3 AS user_id, CASE WHEN seq % 4 > 0 THEN state END AS state FROM hs), c AS (SELECT user_id, state, count(*) AS n FROM h GROUP BY 1, 2),
        t AS (SELECT user_id, CAST(sum(n) AS BIGINT) AS rows, (coalesce(max(n) FILTER (state IS NOT NULL), 0) + coalesce(sum(n) FILTER (state IS NULL), 0)) / sum(n) AS share FROM c GROUP BY 1)
        SELECT user_id, rows, round(share, 4) AS share FROM t WHERE rows >= 3 AND share >= 0.75""")  # fmt: skip
_ISS = f"""WITH {CHAR}, {SEED}, i AS (SELECT 'seen_after_death' AS kind, slug AS entity FROM ch WHERE last_seen > died UNION ALL SELECT 'seed_resolved_when_planted', slug FROM sd WHERE resolved = planted
        UNION ALL SELECT 'seed_resolved_before_planted', slug FROM sd WHERE resolved < planted)"""
register("A17_audit_counts", lambda s, d: ST.temporal_issues(characters(s, d), seeds(s, d)).groupBy("kind").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("entity").alias("entities")),
    f"{_ISS} SELECT kind, count(*) AS rows, count(DISTINCT entity) AS entities FROM i GROUP BY 1")
register("K05_audit_report", lambda s, d: ST.last_rows(ST.temporal_issues(characters(s, d), seeds(s, d)), ["kind"], ["entity"], 5).groupBy("kind").agg(F.array_join(F.array_sort(F.collect_list("entity")), ", ").alias("examples")),
    f"{_ISS}, r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY entity) AS n FROM i) SELECT kind, string_agg(entity, ', ' ORDER BY entity) AS examples FROM r WHERE n <= 5 GROUP BY 1")


def intervals(s, d):
    return table(s, d, "events").selectExpr("user_id AS chapter", "CAST(event_id * 7 % 5000 AS INT) AS s", "CAST(event_id * 7 % 5000 + 10 + event_id % 40 AS INT) AS e", "value AS weight")


INTV = "iv AS (SELECT user_id AS chapter, CAST(event_id * 7 % 5000 AS INTEGER) AS s, CAST(event_id * 7 % 5000 + 10 + event_id % 40 AS INTEGER) AS e, value AS weight FROM events)"
register("R07_merge_intervals", lambda s, d: ST.merge_intervals(intervals(s, d), "chapter"),
    f"""WITH {INTV}, m AS (SELECT *, max(e) OVER (PARTITION BY chapter ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv),
        g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY chapter ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM m)
        SELECT chapter, min(s) AS s, max(e) AS e FROM g GROUP BY chapter, i""")  # fmt: skip


def month_weights(s, d):
    return physical(s, d).groupBy("attribute", "chapter").agg(F.count(F.lit(1)).alias("w"))


MW = f"{PHYS}, mw AS (SELECT attribute, chapter, count(*) AS w FROM ps GROUP BY 1, 2)"
register("R09_allocate", lambda s, d: ST.allocate(month_weights(s, d), "attribute", "chapter", "w", 1000),
    f"""WITH {MW}, x AS (SELECT *, w * 1000.0::DOUBLE / sum(w) OVER (PARTITION BY attribute) AS x FROM mw), f AS (SELECT *, floor(x) AS f, round(x - floor(x), 9) AS r FROM x),
        g AS (SELECT *, 1000 - sum(f) OVER (PARTITION BY attribute) AS l, row_number() OVER (PARTITION BY attribute ORDER BY r DESC, chapter) AS n FROM f)
        SELECT attribute, chapter, CAST(f + CASE WHEN n <= l THEN 1 ELSE 0 END AS BIGINT) AS share FROM g""")  # fmt: skip
register("A19_chapter_weights", lambda s, d: intervals(s, d).filter("weight > 0").groupBy("chapter").agg(F.round(F.sum("weight"), 4).alias("weight")), f"WITH {INTV} SELECT chapter, round(sum(weight), 4) AS weight FROM iv WHERE weight > 0 GROUP BY 1")
register("W15_running_budget", lambda s, d: ST.running_budget(month_weights(s, d), "attribute", ["chapter"], "w", 3000),
    f"""WITH {MW} SELECT attribute, chapter, w, CAST(greatest(0, least(w, 3000 - (sum(w) OVER (PARTITION BY attribute ORDER BY chapter) - w))) AS BIGINT) AS taken FROM mw""")
register("W16_acts", lambda s, d: physical(s, d).select("chapter").distinct().withColumn("act", F.expr("CAST((row_number() OVER (ORDER BY chapter) - 1) div 5 + 1 AS INT)")),
    f"WITH {PHYS} SELECT chapter, CAST((row_number() OVER (ORDER BY chapter) - 1) // 5 + 1 AS INTEGER) AS act FROM (SELECT DISTINCT chapter FROM ps)")
register("W17_positions", lambda s, d: intervals(s, d).selectExpr("chapter", "s", "round(s / 5000.0D, 3) AS position"), f"WITH {INTV} SELECT chapter, s, round(s / CAST(5000 AS DOUBLE), 3) AS position FROM iv")

# --- findings -----------------------------------------------------------------------------------------------------
register("O11_prioritized", lambda s, d: FN.prioritized(finding_rows(s, d), "story").filter("rank <= 50").select("story", "rank", "finding_id"),
    f"WITH {FIND}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY story ORDER BY {_RANK}, certainty DESC, dimension, finding_id) AS INTEGER) AS rank FROM fd) SELECT story, rank, finding_id FROM r WHERE rank <= 50")
register("A18_severity_counts", lambda s, d: FN.severity_counts(finding_rows(s, d), "story"),
    f"WITH {FIND} SELECT story, count(*) FILTER (severity = 'strength') AS strengths, count(*) FILTER (severity = 'concern') AS concerns, count(*) AS total FROM fd GROUP BY 1")


def _rep(p):
    return f"(SELECT dimension, arg_min(severity, {_RANK} * 1000000000 + finding_id) AS severity FROM fd WHERE finding_id % 2 = {p} GROUP BY 1)"


_SC = "CASE {0} WHEN 'strength' THEN 1 WHEN 'concern' THEN -1 ELSE 0 END"
register("J20_scorecard", lambda s, d: FN.scorecard(*[finding_rows(s, d).filter(f"finding_id % 2 = {p}").groupBy("dimension").agg(F.min_by("severity", F.struct(FN.rank_of(F.col("severity")), "finding_id")).alias("severity")) for p in (0, 1)], dims(s)),
    f"WITH {FIND}, {DIMS} SELECT dimension, a.severity AS a, b.severity AS b, {_SC.format('b.severity')} - {_SC.format('a.severity')} AS delta FROM dm LEFT JOIN {_rep(0)} a USING (dimension) LEFT JOIN {_rep(1)} b USING (dimension)")
register("J17_canon_refs", lambda s, d: finding_rows(s, d).withColumn("slug", F.concat(F.lit("c"), F.col("finding_id").cast("string"))).join(characters(s, d), "slug", "left").select("finding_id", "name", F.coalesce("name", F.lit("")).alias("counter")),
    f"WITH {FIND}, {CHAR} SELECT finding_id, name, coalesce(name, '') AS counter FROM fd LEFT JOIN ch ON slug = 'c' || finding_id")
register("U02_distinct_chapters", lambda s, d: physical(s, d).groupBy("entity").agg(F.sort_array(F.collect_set("chapter")).alias("chapters")), f"WITH {PHYS} SELECT entity, list_sort(list(DISTINCT chapter)) AS chapters FROM ps GROUP BY 1")
register("U04_intersect", lambda s, d: physical(s, d).filter("chapter <= 3").select("entity").intersect(physical(s, d).filter("chapter >= 10").select("entity")), f"WITH {PHYS} SELECT entity FROM ps WHERE chapter <= 3 INTERSECT SELECT entity FROM ps WHERE chapter >= 10")
register("U05_union_cited", lambda s, d: finding_rows(s, d).select("finding_id", F.array_sort(F.array_union("cited", F.array(F.lit(1), F.lit(2)))).alias("cited")), f"WITH {FIND} SELECT finding_id, list_sort(list_distinct(list_concat(cited, [1, 2]))) AS cited FROM fd")
register("A24_first_seen_order", lambda s, d: history(s, d).groupBy("user_id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("seq", "state"))), lambda x: x["state"])).alias("states")),
    f"WITH {HIST}, f AS (SELECT user_id, state, min(seq) AS q FROM hs GROUP BY 1, 2) SELECT user_id, list(state ORDER BY q) AS states FROM f GROUP BY 1")
register("K11_by_prefix", lambda s, d: table(s, d, "part").groupBy(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("prefix")).agg(F.count(F.lit(1)).alias("n")), "SELECT split_part(p_name, ' ', 1) AS prefix, count(*) AS n FROM part GROUP BY 1")
register("J24_fresh", lambda s, d: table(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha")).alias("now").join(table(s, d, "documents").filter("doc_id % 3 > 0").select("doc_id", F.sha2(F.expr("CASE WHEN doc_id % 3 = 1 THEN text ELSE concat(text, '!') END"), 256).alias("was")), "doc_id", "left").select("doc_id", F.coalesce(F.col("sha") == F.col("was"), F.lit(False)).alias("fresh")),
    "SELECT doc_id, doc_id % 3 = 1 AS fresh FROM documents")
# --- vectors ------------------------------------------------------------------------------------------------------
register("V02_nearest", lambda s, d: nearest(s, d),
    """WITH q AS (SELECT vec_id AS q_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 50 = 0), x AS (SELECT q_id, vec_id, round(list_sum(list_transform(list_zip(q, CAST(embedding AS DOUBLE[])), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9) AS distance FROM embeddings, q),
       r AS (SELECT *, CAST(row_number() OVER (PARTITION BY q_id ORDER BY distance, vec_id) AS INTEGER) AS rank FROM x) SELECT * FROM r WHERE rank <= 5""")  # fmt: skip


def nearest(s, d):
    """Every fiftieth vector is a question to all vectors; five of each are kept."""
    e = table(s, d, "embeddings")
    return vectors.nearest(e, e.filter("vec_id % 50 = 0"), 5)


register("X_tumbling_window", lambda s, d: table(s, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n"),
    "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
