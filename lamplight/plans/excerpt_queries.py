"""Queries of hit-weighted excerpts. The hits are the repeated phrases of a book's own lines, placed where they stand."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamplight.operators import excerpts as E
from lamplight.plans.registry import register
from lamplight.plans.views import CHAPTERS, chapters, table

KEY = ["manuscript", "chapter_number"]


def rows(s, d):
    """Each chapter's first word as a row: its place where it comes again, in this chapter and the next one."""
    return chapters(s, d).select(
        "manuscript", F.array("chapter_number", F.col("chapter_number") + 1).alias("chapters"), F.when(F.col("chapter_number") % 3 == 0, "high").when(F.col("chapter_number") % 3 == 1, "moderate").otherwise("low").alias("severity"),
        (F.length("content") % 97 + 1).alias("count"),
        F.when(F.col("chapter_number") % 2 == 0, F.array(*[F.struct(F.col("chapter_number"), F.lit(p).alias("approximate_position")) for p in (0.25, 0.75)])).alias("locations"),
    )


def hits(s, d):
    return E.hits(rows(s, d), ["manuscript"])


HITS = f"""{CHAPTERS}, hr AS (SELECT manuscript, unnest([chapter_number, chapter_number + 1]) AS chapter_number, chapter_number AS own,
      (CASE chapter_number % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END) * (1 + floor(log10(length(content) % 97 + 1))) AS w FROM chapters),
    hits AS (SELECT manuscript, chapter_number, CASE WHEN own = chapter_number AND own % 2 = 0 THEN w / 2 ELSE w END AS weight,
      unnest(CASE WHEN own = chapter_number AND own % 2 = 0 THEN [0.25, 0.75] ELSE [NULL] END) AS position FROM hr)"""
WIN = f"""{HITS}, wi AS (SELECT h.*, length(content) AS n, greatest(0, least(length(content), CAST(floor(position * length(content)) AS BIGINT))) AS c FROM hits h JOIN chapters USING (manuscript, chapter_number) WHERE position IS NOT NULL),
    win AS (SELECT manuscript, chapter_number, weight, greatest(0, c - 450) AS s, least(n, c + 450) AS e FROM wi)"""

register("J25_hits", hits, f"WITH {HITS} SELECT manuscript, chapter_number, weight, position FROM hits")
register("A19_chapter_weights", lambda s, d: hits(s, d).groupBy(*KEY).agg(F.sum("weight").alias("w")), f"WITH {HITS} SELECT manuscript, chapter_number, sum(weight) AS w FROM hits GROUP BY 1, 2")


def windows(s, d):
    placed = hits(s, d).join(chapters(s, d).select(*KEY, F.length("content").alias("n")), KEY).withColumn("w", E.window(F.col("position"), F.col("n")))
    return placed.filter("w IS NOT NULL").select(*KEY, "weight", "w.s", "w.e")


register("R08_hit_windows", windows, f"WITH {WIN} SELECT * FROM win WHERE e > s")
register("R08_needles", lambda s, d: chapters(s, d).select("doc_id", F.round(E.needle_position(F.lit("the"), F.col("content")), 6).alias("position")))


def ceilings(s, d):
    return chapters(s, d).groupBy("manuscript").agg(F.least(F.lit(100_000), F.count(F.lit(1)) * E.PER_CHAPTER).alias("ceiling"))


register("R09_allocation", lambda s, d: E.budgets(hits(s, d).join(chapters(s, d).select(*KEY), KEY).groupBy(*KEY).agg(F.sum("weight").alias("w")), ceilings(s, d)).select(*KEY, F.col("n").cast("int").alias("n"), "alloc"),
    f"""WITH {HITS}, cw AS (SELECT manuscript, chapter_number, sum(weight) AS w FROM hits JOIN chapters USING (manuscript, chapter_number) GROUP BY 1, 2),
        ce AS (SELECT manuscript, least(100000, count(*) * 4000) AS ceiling FROM chapters GROUP BY 1),
        o AS (SELECT *, row_number() OVER (PARTITION BY manuscript ORDER BY w DESC, chapter_number) AS n FROM cw JOIN ce USING (manuscript)),
        f AS (SELECT *, least(400, ceiling - (n - 1) * 400) AS floor FROM o WHERE n <= ceil(ceiling / 400)),
        r AS (SELECT *, ceiling - sum(floor) OVER (PARTITION BY manuscript) AS rest, sum(w) OVER (PARTITION BY manuscript) AS t FROM f),
        x AS (SELECT *, rest * (w / t) AS x, floor(rest * (w / t)) AS part FROM r),
        p AS (SELECT *, rest - sum(part) OVER (PARTITION BY manuscript) AS l, row_number() OVER (PARTITION BY manuscript ORDER BY round(part - x, 9), n) AS place FROM x)
        SELECT manuscript, chapter_number, CAST(n AS INTEGER) AS n, CAST(floor + part + CASE WHEN place <= l THEN 1 ELSE 0 END AS BIGINT) AS alloc FROM p""")  # fmt: skip
register("R10_chosen_spans", lambda s, d: E.chapter_spans(chapters(s, d), hits(s, d)))
register("R11_blocks", lambda s, d: E.chapter_spans(chapters(s, d), hits(s, d)).groupBy(*KEY).agg(F.sum(F.col("e") - F.col("s")).alias("chars")))
register("Q14_excerpts", lambda s, d: E.excerpts(chapters(s, d), hits(s, d)))

_HT = """CASE WHEN length(text) <= {m} THEN text ELSE
      (CASE WHEN strpos(reverse(left(text, {h})), ' ') > 0 AND {h} - strpos(reverse(left(text, {h})), ' ') > {h} * 0.8 THEN left(text, {h} - strpos(reverse(left(text, {h})), ' ')) ELSE left(text, {h}) END)
      || chr(10) || '[…]' || chr(10) ||
      (CASE WHEN strpos(right(text, {t}), ' ') BETWEEN 1 AND ceil({t} * 0.2) THEN substring(right(text, {t}), strpos(right(text, {t}), ' ') + 1) ELSE right(text, {t}) END) END"""
register("F23_head_tail", lambda s, d: table(s, d, "documents").select("doc_id", E.head_tail(F.col("text"), 500).alias("out")), f"SELECT doc_id, {_HT.format(m=500, h=300, t=200)} AS out FROM documents")
register("N05_whole_chapters", lambda s, d: E.whole_chapters(chapters(s, d), 2000),
    f"""WITH {CHAPTERS}, c AS (SELECT manuscript, chapter_number, title, content AS text FROM chapters)
        SELECT manuscript, chapter_number, '--- Chapter ' || chapter_number || ': ' || coalesce(nullif(title, ''), 'Chapter ' || chapter_number) || ' ---' || chr(10) || {_HT.format(m=2000, h=1200, t=800)} AS block FROM c""")  # fmt: skip
