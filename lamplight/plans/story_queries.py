"""Queries of the state block, retrieval, summaries and incremental state."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamplight.operators import canon_block as C
from lamplight.operators import retrieval as RT
from lamplight.plans.registry import register
from lamplight.plans.state_queries import HIST, PHYS, history, physical, seeds
from lamplight.plans.views import CHAPTERS, chapters, table
from lamplight.streaming import incremental as I

N = 7


def people(s, d):
    return table(s, d, "customer").select(
        F.lit("book").alias("manuscript"), F.col("c_name").alias("name"), F.expr("CASE WHEN c_custkey % 4 = 0 THEN 'deceased' WHEN c_custkey % 9 = 1 THEN '' ELSE 'active' END").alias("status"),
        F.expr("CAST(c_custkey % 11 + 1 AS INT)").alias("introduced"), F.expr("CAST(CASE WHEN c_custkey % 8 = 0 THEN c_custkey % 13 + 1 END AS INT)").alias("died"), F.expr("CASE c_custkey % 5 WHEN 0 THEN 'major' WHEN 1 THEN 'protagonist' WHEN 2 THEN 'background' END").alias("weight"))


PEOPLE = """pe AS (SELECT c_name AS name, CASE WHEN c_custkey % 4 = 0 THEN 'deceased' WHEN c_custkey % 9 = 1 THEN '' ELSE 'active' END AS status, CAST(c_custkey % 11 + 1 AS INTEGER) AS introduced,
    CASE WHEN c_custkey % 8 = 0 THEN CAST(c_custkey % 13 + 1 AS INTEGER) END AS died, CASE c_custkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 3 ELSE 2 END AS rank FROM customer)"""
register("R02_cast_as_of", lambda s, d: C.cast(people(s, d), N).select("name", "status", "chapter", "rank"),
    f"""WITH {PEOPLE} SELECT name, CASE WHEN status <> 'deceased' THEN coalesce(nullif(status, ''), 'unknown') WHEN died >= {N} THEN 'active' WHEN died IS NOT NULL THEN 'deceased since Ch ' || died
        ELSE 'deceased (death chapter not recorded; may be this chapter)' END AS status, CASE WHEN died < {N} THEN died ELSE introduced END AS chapter, rank FROM pe WHERE introduced < {N}""")  # fmt: skip


def hidden(s, d):
    """A secret of every user: its states by hour, its knowers with and without a chapter."""
    rows = history(s, d).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("seq", "state", "chapter"))).alias("h"))
    u = F.col("user_id")
    return rows.select(F.lit("book").alias("manuscript"), F.concat(F.lit("secret "), u.cast("string")).alias("name"), F.lit("shared").alias("state"), (u % 5).cast("int").alias("planted"),
        F.when(u % 3 > 0, (u % 10).cast("int")).alias("since"), F.when(u % 4 > 0, (u % 9).cast("int")).alias("revealed"), F.when(u % 2 == 0, F.transform("h", lambda x: F.struct(x["state"].alias("state"), x["chapter"].alias("chapter")))).alias("history"),
        F.array(F.lit("ann"), F.lit("bo")).alias("knowers"), F.create_map(F.lit("ann"), (u % 10).cast("int")).alias("known_since"))


_HID = f"""{HIST}, u AS (SELECT DISTINCT user_id AS u FROM hs), l AS (SELECT user_id, arg_max(state, chapter * 10000000000 + seq) AS state, max(chapter) AS chapter FROM hs WHERE chapter < {N} AND user_id % 2 = 0 GROUP BY 1),
    x AS (SELECT u, l.state AS ls, l.chapter AS lc, u % 5 AS planted, CASE WHEN u % 3 > 0 THEN u % 10 END AS since, CASE WHEN u % 4 > 0 THEN u % 9 END AS revealed, u % 10 AS ann FROM u LEFT JOIN l ON user_id = u),
    y AS (SELECT *, coalesce(since >= {N}, false) AS later FROM x WHERE planted < {N})"""
register("R03_secrets_as_of", lambda s, d: C.secrets(hidden(s, d), N).select("name", "state", F.col("chapter").cast("long").alias("chapter")),
    f"""WITH {_HID} SELECT 'secret ' || u AS name, CASE WHEN ls IS NOT NULL THEN ls WHEN later AND revealed < {N} THEN 'revealed since Ch ' || revealed WHEN later THEN 'hidden' ELSE 'shared' END AS state,
        CAST(CASE WHEN ls IS NOT NULL THEN lc WHEN later AND revealed < {N} THEN revealed WHEN later THEN planted ELSE coalesce(since, planted) END AS BIGINT) AS chapter FROM y""")  # fmt: skip
register("R04_knowers_as_of", lambda s, d: C.secrets(hidden(s, d), N).select("name", "tail"),
    f"""WITH {_HID}, k AS (SELECT *, list_filter([CASE WHEN ann < {N} THEN 'ann' END, CASE WHEN NOT later THEN 'bo' END], lambda q: q IS NOT NULL) AS l FROM y)
        SELECT 'secret ' || u AS name, CASE WHEN len(l) > 0 THEN 'known by ' || array_to_string(l, ', ') WHEN later THEN 'knowers before Ch {N} not recorded' ELSE 'known by no one recorded' END AS tail FROM k""")  # fmt: skip


def _book(df):
    return df.withColumn("manuscript", F.lit("book"))


register("Q09_state_block", lambda s, d: C.state_block(people(s, d), _book(physical(s, d)), hidden(s, d), _book(seeds(s, d)), _book(table(s, d, "benchmark").select(F.col("text").alias("fact"))), N))
register("O12_entry_caps", lambda s, d: C.entries(C.latest_physical(_book(physical(s, d)), N), "P", F.concat_ws(" ", "entity", "attribute", "value"), F.col("chapter"), [F.coalesce("chapter", F.lit(0)).desc(), F.col("entity"), F.col("attribute")]).select(F.col("n").cast("int").alias("n"), "chapter", "text"),
    f"""WITH {PHYS}, l AS (SELECT entity, attribute, arg_max(value, chapter * 100000000000 + file_pos) AS value, max(chapter) AS chapter FROM ps WHERE chapter < {N} GROUP BY 1, 2),
        r AS (SELECT *, CAST(row_number() OVER (ORDER BY chapter DESC, entity, attribute) AS INTEGER) AS n FROM l) SELECT n, chapter, entity || ' ' || attribute || ' ' || value AS text FROM r WHERE n <= 60""")  # fmt: skip

# --- retrieval and summaries ----------------------------------------------------------------------------------------
register("V01_embedded", lambda s, d: table(s, d, "benchmark").select("item_id", F.round(F.get(RT.embed(F.col("text")), F.lit(5)), 6).alias("x")),
    "SELECT item_id, round(CAST('0x' || substr(sha256(text), 11, 2) AS INTEGER) / 255 * 2 - 1, 6) AS x FROM benchmark")


def asked(s, d):
    return table(s, d, "benchmark").filter("item_id % 50 = 0").select(F.col("item_id").alias("q_id"), F.col("text").alias("question"))


def found(s, d):
    return RT.retrieve(asked(s, d), RT.indexed(chapters(s, d)))


register("Q15_retrieval", found)
register("V03_context", lambda s, d: RT.context(found(s, d)))
register("X08_index_stamp", lambda s, d: RT.stamp(chapters(s, d), "stub"),
    f"""WITH {CHAPTERS}, h AS (SELECT manuscript, sha256(string_agg(chapter_number || ':' || sha256(content), chr(10) ORDER BY chapter_number)) AS sha FROM chapters GROUP BY 1)
        SELECT manuscript, sha256('stub' || chr(10) || sha) AS stamp FROM h""")  # fmt: skip


def sizes(s, d):
    return chapters(s, d).filter("chapter_number <= 3").select("manuscript", F.col("chapter_number").alias("act_no"), F.when(F.length("content") % 2 == 0, F.col("chapter_number")).alias("used"), F.lit(2).alias("budget"))


register("J23_act_ranges", lambda s, d: RT.acts(chapters(s, d), sizes(s, d)),
    f"""WITH {CHAPTERS}, z AS (SELECT manuscript, chapter_number AS act_no, CASE WHEN length(content) % 2 = 0 THEN chapter_number END AS used FROM chapters WHERE chapter_number <= 3),
        y AS (SELECT *, max(coalesce(used, 0)) OVER (PARTITION BY manuscript) > 0 AS any_used FROM z), x AS (SELECT *, CASE WHEN any_used THEN coalesce(used, 0) ELSE 2 END AS size FROM y),
        e AS (SELECT *, sum(size) OVER (PARTITION BY manuscript ORDER BY act_no) AS last, row_number() OVER (PARTITION BY manuscript ORDER BY act_no) AS act FROM x WHERE size > 0)
        SELECT manuscript, chapter_number, CAST(coalesce((SELECT min(act) FROM e WHERE e.manuscript = c.manuscript AND last >= chapter_number), (SELECT max(act) FROM e WHERE e.manuscript = c.manuscript)) AS INTEGER) AS act FROM chapters c""")  # fmt: skip
register("W16_acts_of_five", lambda s, d: RT.acts(chapters(s, d)), f"WITH {CHAPTERS} SELECT manuscript, chapter_number, CAST((chapter_number - 1) // 5 + 1 AS INTEGER) AS act FROM chapters")
register("Q16_hierarchy", lambda s, d: RT.hierarchy(chapters(s, d)))

# --- incremental ----------------------------------------------------------------------------------------------------


def saved(s, d):
    return history(s, d).filter("seq % 3 = 0").groupBy(F.col("user_id").alias("story")).agg(F.max("chapter").alias("mark"))


def ran(s, d):
    return history(s, d).filter("seq % 3 > 0").select(F.col("user_id").alias("story"), "chapter").distinct()


register("X01_high_water", lambda s, d: I.high_water(saved(s, d), ran(s, d)), f"WITH {HIST} SELECT user_id AS story, max(chapter) AS mark FROM hs GROUP BY 1")
register("X02_arrivals", lambda s, d: I.arrivals(saved(s, d), ran(s, d)).select("story", "chapter", "kind", F.size("missing").alias("missing")),
    f"""WITH {HIST}, m AS (SELECT user_id AS story, max(chapter) AS mark FROM hs WHERE seq % 3 = 0 GROUP BY 1), a AS (SELECT DISTINCT user_id AS story, chapter FROM hs WHERE seq % 3 > 0), j AS (SELECT story, chapter, coalesce(mark, 0) AS mark FROM a LEFT JOIN m USING (story))
        SELECT story, chapter, CASE WHEN chapter <= mark THEN 'regression' WHEN chapter > mark + 1 THEN 'skip' ELSE 'next' END AS kind, CAST(greatest(0, chapter - mark - 1) AS INTEGER) AS missing FROM j""")  # fmt: skip
register("X05_invalidate_from", lambda s, d: I.invalidate_from(physical(s, d), N).select("entity", "file_pos", "chapter"), f"WITH {PHYS} SELECT entity, file_pos, chapter FROM ps WHERE chapter < {N}")


def sheets(s, d):
    return chapters(s, d).select(F.col("manuscript").alias("story"), F.col("chapter_number").alias("chapter"), F.col("content").alias("sheet"))


register("X06_rolling_prior", lambda s, d: I.rolling_prior(sheets(s, d), 3, 9000),
    f"""WITH {CHAPTERS}, r AS (SELECT manuscript AS story, chapter_number AS chapter, sum(length(content)) OVER (PARTITION BY manuscript) > 9000 AS over, row_number() OVER (PARTITION BY manuscript ORDER BY chapter_number DESC) AS n FROM chapters)
        SELECT story, chapter, over AND (SELECT count(*) FROM chapters c WHERE c.manuscript = r.story) > 3 AS rolling FROM r WHERE NOT over OR n <= 3""")  # fmt: skip
register("X07_sliding_window", lambda s, d: I.sliding(history(s, d).select(F.col("user_id").alias("story"), "chapter").distinct(), 5).select("story", "chapter", F.array_join("seen", ",").alias("seen")),
    f"""WITH {HIST}, c AS (SELECT DISTINCT user_id AS story, chapter FROM hs) SELECT a.story, a.chapter, string_agg(b.chapter::VARCHAR, ',' ORDER BY b.chapter) AS seen FROM c a JOIN c b ON a.story = b.story AND b.chapter BETWEEN a.chapter - 5 AND a.chapter GROUP BY 1, 2""")
register("X09_probe_cache", lambda s, d: I.probes_due(*_probes(s, d)), "SELECT DISTINCT event_type AS model FROM events WHERE event_type NOT IN (SELECT event_type FROM events WHERE value > 99 AND event_id % 2 = 0)")


def _probes(s, d):
    e = table(s, d, "events")
    day = F.lit("2024-01-02").cast("date")
    passed = e.filter("value > 99").select(F.col("event_type").alias("model"), F.when(F.col("event_id") % 2 == 0, day).otherwise(F.date_sub(day, 1)).alias("day"))
    return e.select(F.col("event_type").alias("model")).distinct(), passed, day


