"""Queries of the rare- and common-word operators. Scenes are runs of five lines; the lexicon is the corpus's own."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamplight.functions import lexicons as L
from lamplight.operators import detectors as D
from lamplight.operators import thrash as T
from lamplight.plans.registry import register
from lamplight.plans.scalar_queries import _list, canonical_tags, d_lemma, d_norm
from lamplight.plans.views import CHAPTERS, DIALOGUE, chapter_numbers, chapters, dialogue, table

KEY = ["manuscript", "chapter_number"]


def scene_texts(spark, sf_dir):
    """manuscript, chapter_number, scene, content: five lines each."""
    lines = chapters(spark, sf_dir).select(*KEY, F.posexplode(F.split("content", "\n")).alias("n", "line"))
    parts = lines.groupBy(*KEY, F.expr("n div 5").alias("scene")).agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("l"))
    return parts.select(*KEY, F.col("scene").cast("int").alias("scene"), F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("content"))


def _hits(s, d):
    return T.content_hits(T.tokens(chapters(s, d), KEY))


def _scene_hits(s, d):
    return T.content_hits(T.tokens(scene_texts(s, d), [*KEY, "scene"]))


def _rare(s, d):
    return T.uncommon(T.lexicon(T.lemma_counts(_hits(s, d), KEY)))


def _within(s, d):
    return T.rare_rows(_scene_hits(s, d), _rare(s, d), [*KEY, "scene"])


def _chapter(s, d):
    return T.rare_rows(_hits(s, d), _rare(s, d), KEY)


def _tok(name: str, source: str, keys: str) -> str:
    return rf"""{name}0 AS (SELECT {keys}, regexp_extract_all(content, '[A-Za-z][A-Za-z\-'']*') AS l, string_split_regex(content, '[A-Za-z][A-Za-z\-'']*') AS s FROM {source}),
    {name} AS (SELECT {keys}, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS tok, unnest(s[1:len(l)]) AS sep, unnest(list_append(l[2:], NULL)) AS nxt FROM {name}0 WHERE len(l) > 0)"""


def _proper(x: str) -> str:
    return f"(regexp_matches({x}, '^[A-Z]') AND {x} <> upper({x}))"


def _hit(name: str, toks: str) -> str:
    return rf"""{name}b AS (SELECT *, regexp_replace(sep, '\s+$', '') AS b FROM {toks}),
    {name} AS (SELECT *, {d_lemma('tok')} AS lemma FROM {name}b
      WHERE NOT ({_proper('tok')} AND (CASE WHEN b = '' THEN pos > 0 ELSE right(b, 1) NOT IN ('.', '!', '?') END OR coalesce({_proper('nxt')}, false))))"""


SCENES = r"""ln AS (SELECT manuscript, chapter_number, generate_subscripts(l, 1) - 1 AS n, unnest(l) AS line FROM (SELECT *, string_split(content, chr(10)) AS l FROM chapters)),
    scenes AS (SELECT manuscript, chapter_number, CAST(n // 5 AS INTEGER) AS scene, string_agg(line, chr(10) ORDER BY n) AS content FROM ln GROUP BY 1, 2, 3)"""
HITS = f"{CHAPTERS}, {_tok('tk', 'chapters', 'manuscript, chapter_number')}, {_hit('hits', 'tk')}"
_CE = _list(L.common_words())
RARE = f"""lex AS (SELECT lemma, round(log10(count(*) * 1e9 / (SELECT count(*) FROM hits)), 6) AS zipf FROM hits GROUP BY 1),
    rare AS (SELECT lemma FROM lex WHERE zipf < 4.0 AND length(lemma) >= 3 AND lemma NOT IN ({_CE}))"""
SHITS = f"{SCENES}, {_tok('stk', 'scenes', 'manuscript, chapter_number, scene')}, {_hit('shits', 'stk')}"


def _rows(name: str, hits: str, keys: str) -> str:
    return f"""{name}0 AS (SELECT {keys}, lemma, count(*) AS count, list(tok ORDER BY pos) AS l FROM {hits} WHERE lemma IN (SELECT lemma FROM rare) GROUP BY {keys}, lemma HAVING count(*) >= 2),
    {name} AS (SELECT {keys}, lemma, count, l[1] AS foothold, list_sort(list_distinct(l[2:])) AS later,
      CASE WHEN count >= 4 THEN 'high' WHEN count >= 2 THEN 'moderate' ELSE 'low' END AS severity FROM {name}0)"""


ALL = f"{HITS}, {RARE}, {SHITS}, {_rows('within', 'shits', 'manuscript, chapter_number, scene')}, {_rows('chap', 'hits', 'manuscript, chapter_number')}"
_ROW = ["lemma", "count", "foothold", "later", "severity"]


def _sorted(df):
    return df.withColumn("later", F.sort_array("later"))


register("F04_content_hits", lambda s, d: _hits(s, d).select(*KEY, "pos", "tok", "lemma"), f"WITH {HITS} SELECT manuscript, chapter_number, CAST(pos AS INTEGER) AS pos, tok, lemma FROM hits")
register("F03_uncommon", _rare, f"WITH {HITS}, {RARE} SELECT lemma FROM rare")
register(
    "J01_rare_hits",
    lambda s, d: _hits(s, d).join(_rare(s, d), "lemma", "left_semi").groupBy(*KEY).agg(F.count(F.lit(1)).alias("rare_hits")),
    f"WITH {HITS}, {RARE} SELECT manuscript, chapter_number, count(*) AS rare_hits FROM hits WHERE lemma IN (SELECT lemma FROM rare) GROUP BY 1, 2",
)
register("T04_scenes", lambda s, d: dialogue(s, d).select("conv_id", F.size(T.scenes(F.col("content"))).alias("scenes")),
    rf"WITH {DIALOGUE} SELECT conv_id, CAST(len(list_filter(string_split_regex(content, '\n\s*\n'), lambda p: trim(p) <> '')) AS INTEGER) AS scenes FROM dialogue")
register("A06_within_scene", lambda s, d: _sorted(_within(s, d)), f"WITH {ALL} SELECT manuscript, chapter_number, scene, {', '.join(_ROW)} FROM within")
register("A07_chapter_rare", lambda s, d: _sorted(_chapter(s, d)), f"WITH {ALL} SELECT manuscript, chapter_number, {', '.join(_ROW)} FROM chap")
register(
    "J03_rare_without_scene",
    lambda s, d: _chapter(s, d).join(_within(s, d), [*KEY, "lemma"], "left_anti").select(*KEY, "lemma", "count"),
    f"WITH {ALL} SELECT manuscript, chapter_number, lemma, count FROM chap c WHERE NOT EXISTS (SELECT 1 FROM within w WHERE w.manuscript = c.manuscript AND w.chapter_number = c.chapter_number AND w.lemma = c.lemma)",
)
_CROSS = """bk AS (SELECT manuscript, chapter_number, lemma, count, 0 AS kind FROM within UNION ALL SELECT manuscript, chapter_number, lemma, count, 1 FROM chap),
    pick AS (SELECT *, row_number() OVER (PARTITION BY manuscript, chapter_number, lemma ORDER BY kind, count DESC) AS r FROM bk),
    den AS (SELECT *, row_number() OVER (PARTITION BY manuscript, lemma ORDER BY count DESC, kind, chapter_number) AS dr FROM pick WHERE r = 1),
    cross_rows AS (SELECT manuscript, lemma, CAST(sum(count) AS BIGINT) AS count, list_sort(list(DISTINCT chapter_number)) AS chapters, max(CASE WHEN dr = 1 THEN chapter_number END) AS densest,
      CASE WHEN sum(count) >= 4 THEN 'high' ELSE 'moderate' END AS severity FROM den GROUP BY 1, 2 HAVING count(DISTINCT chapter_number) >= 2)"""
register("J04_merge_per_chapter",
    lambda s, d: _within(s, d).select(*KEY, "lemma", "count", F.lit(0).alias("k")).unionByName(_chapter(s, d).select(*KEY, "lemma", "count", F.lit(1).alias("k")))
    .groupBy(*KEY, "lemma").agg(F.min_by("count", F.struct("k", -F.col("count"))).alias("count")),
    f"WITH {ALL}, {_CROSS} SELECT manuscript, chapter_number, lemma, count FROM pick WHERE r = 1")
register("A08_cross_chapter", lambda s, d: T.cross_chapter(_within(s, d), _chapter(s, d)), f"WITH {ALL}, {_CROSS} SELECT * FROM cross_rows")
register(
    "O03_chapter_cap",
    lambda s, d: T.capped(_chapter(s, d), KEY, [F.desc("count"), "lemma"], 12).select(*KEY, "lemma", "count"),
    f"WITH {ALL}, k AS (SELECT *, row_number() OVER (PARTITION BY manuscript, chapter_number ORDER BY count DESC, lemma) AS r FROM chap) SELECT manuscript, chapter_number, lemma, count FROM k WHERE r <= 12",
)
_EX = _list(sorted({*L.EXEMPT_WORDS, *L.SI_UNITS, *L.SAID_FAMILY, *L.fancy_tags()}))
_COMMON = f"""cnt AS (SELECT manuscript, chapter_number, lemma, count(*) AS count FROM hits GROUP BY 1, 2, 3),
    cw AS (SELECT *, sum(count) OVER (PARTITION BY manuscript, chapter_number) AS words FROM cnt),
    common AS (SELECT manuscript, chapter_number, lemma, count, CASE WHEN count >= 8 THEN 'high' WHEN count >= 6 THEN 'moderate' ELSE 'low' END AS severity FROM cw
      WHERE length(lemma) >= 3 AND lemma NOT IN ({_EX}) AND lemma NOT IN (SELECT lemma FROM rare) AND (count >= 6 OR (words >= 1000 AND count >= 4 AND count * 1000.0 / words >= 1.2)))"""
register("A09_common_word", lambda s, d: T.common_words(T.lemma_counts(_hits(s, d), KEY), _rare(s, d), KEY), f"WITH {HITS}, {RARE}, {_COMMON} SELECT * FROM common")
register(
    "J02_exempt_anti_join",
    lambda s, d: _hits(s, d).join(F.broadcast(L.words(s, [*L.EXEMPT_WORDS, *L.SI_UNITS])), "lemma", "left_anti").groupBy("manuscript").agg(F.count(F.lit(1)).alias("n")),
    f"WITH {HITS} SELECT manuscript, count(*) AS n FROM hits WHERE lemma NOT IN ({_list(sorted({*L.EXEMPT_WORDS, *L.SI_UNITS}))}) GROUP BY 1",
)
_FORMS = ", ".join(f"('{a}', '{b}')" for a, b in L.speech_forms())
register(
    "A10_tag_carpet",
    lambda s, d: canonical_tags_by(s, d).groupBy("conv_id", "tag").agg(F.count(F.lit(1)).alias("count")).filter("count >= 3"),
    rf"""WITH {DIALOGUE}, dt AS (SELECT conv_id, unnest(regexp_extract_all(content, '[A-Za-z][A-Za-z\-'']*')) AS tok FROM dialogue), forms(form, counted) AS (VALUES {_FORMS}),
        m AS (SELECT conv_id, coalesce(a.counted, b.counted) AS tag FROM dt LEFT JOIN forms a ON a.form = lower(tok) LEFT JOIN forms b ON b.form = {d_lemma('tok')})
        SELECT conv_id, tag, count(*) AS count FROM m WHERE tag IS NOT NULL AND tag NOT IN ({_list(L.BARE_ATTRIBUTION)}) GROUP BY 1, 2 HAVING count(*) >= 3""",
)


def canonical_tags_by(s, d):
    toks = dialogue(s, d).select("conv_id", F.explode(F.regexp_extract_all("content", F.lit(r"([A-Za-z][A-Za-z\-']*)"), F.lit(1))).alias("tok"))
    tags = canonical_tags(s, toks.select("tok").distinct())
    return toks.join(F.broadcast(tags), "tok")  # at most the forms of the speech verbs


_ST = _list(L.STOP_WORDS)
_UN = _list([*L.SI_UNITS, "pace", "paces"])
_NU = _list([*L.NUMBER_WORDS, *L.SI_UNITS, "pace", "paces"])


def _si(cols: list[str]) -> str:
    return f"(({cols[-1]} IN ({_UN}) AND {cols[0]} IN ({_NU})) OR ({' AND '.join(f'{c} IN ({_NU})' for c in cols)}))"


def _good(c: str) -> str:
    return f"length({c}) >= 3 AND {c} NOT IN ({_ST})"


PHRASES = f"""nt AS (SELECT *, {d_norm('tok')} AS norm FROM tk),
    nl AS (SELECT *, lead(norm, 1) OVER w AS n2, lead(norm, 2) OVER w AS n3, lead(sep, 1) OVER w AS s2, lead(sep, 2) OVER w AS s3 FROM nt WINDOW w AS (PARTITION BY manuscript, chapter_number ORDER BY pos)),
    gr AS (SELECT manuscript, chapter_number, pos, tok, norm || ' ' || n2 AS phrase FROM nl WHERE length(s2) <= 2 AND NOT regexp_matches(s2, '[.!?]') AND {_good('norm')} AND {_good('n2')} AND NOT {_si(['norm', 'n2'])}
      UNION ALL SELECT manuscript, chapter_number, pos, tok, norm || ' ' || n2 || ' ' || n3 FROM nl WHERE length(s2) <= 2 AND NOT regexp_matches(s2, '[.!?]') AND length(s3) <= 2 AND NOT regexp_matches(s3, '[.!?]')
        AND {_good('norm')} AND {_good('n2')} AND {_good('n3')} AND NOT {_si(['norm', 'n2', 'n3'])})"""
_TK = f"{CHAPTERS}, {_tok('tk', 'chapters', 'manuscript, chapter_number')}"


def _grams(s, d):
    return T.phrases(T.tokens(chapters(s, d), KEY), KEY)


register("T14_phrases", lambda s, d: _grams(s, d).select(*KEY, "pos", "phrase"), f"WITH {_TK}, {PHRASES} SELECT manuscript, chapter_number, CAST(pos AS INTEGER) AS pos, phrase FROM gr")
register(
    "A11_phrase_rows",
    lambda s, d: T.phrase_rows(_grams(s, d), KEY),
    f"WITH {_TK}, {PHRASES} SELECT manuscript, chapter_number, phrase, count(*) AS count, arg_min(tok, pos) AS first_surface, CASE WHEN count(*) >= 4 THEN 'high' ELSE 'moderate' END AS severity FROM gr GROUP BY 1, 2, 3 HAVING count(*) >= 2",
)


def all_rows(s, d):
    """The rows of all detectors under one schema. A chapter is a document, so texts are read by their ids."""
    texts = table(s, d, "documents").select("doc_id", F.col("text").alias("content"))
    return D.all_rows(texts, chapter_numbers(s, d), "doc_id")


_UNION = f"""{ALL}, {_CROSS}, {_COMMON}, {PHRASES},
    ph AS (SELECT manuscript, chapter_number, phrase, count(*) AS count FROM gr GROUP BY 1, 2, 3 HAVING count(*) >= 2),
    un AS (SELECT 'within_scene' AS kind, 0 AS kind_rank, severity, count, concat_ws('|', manuscript, chapter_number, scene, lemma) AS key FROM within
      UNION ALL SELECT 'cross_chapter', 1, severity, count, concat_ws('|', manuscript, lemma) FROM cross_rows
      UNION ALL SELECT 'chapter_rare', 2, severity, count, concat_ws('|', manuscript, chapter_number, lemma) FROM chap c WHERE NOT EXISTS (SELECT 1 FROM within w WHERE w.manuscript = c.manuscript AND w.chapter_number = c.chapter_number AND w.lemma = c.lemma)
      UNION ALL SELECT 'common_word', 3, severity, count, concat_ws('|', manuscript, chapter_number, lemma) FROM common
      UNION ALL SELECT 'phrase', 4, CASE WHEN count >= 4 THEN 'high' ELSE 'moderate' END, count, concat_ws('|', manuscript, chapter_number, phrase) FROM ph)"""
_SR = "CASE severity WHEN 'high' THEN 0 WHEN 'moderate' THEN 1 WHEN 'low' THEN 2 ELSE 3 END"
register("U01_union_rows", lambda s, d: all_rows(s, d).groupBy("kind", "severity").agg(F.count(F.lit(1)).alias("rows"), F.sum("count").alias("total")),
    f"WITH {_UNION} SELECT kind, severity, count(*) AS rows, CAST(sum(count) AS BIGINT) AS total FROM un GROUP BY 1, 2")
_MERGED = f"""o AS (SELECT *, row_number() OVER (PARTITION BY kind = 'cross_chapter' ORDER BY {_SR}, kind_rank, count DESC, key) AS r FROM un),
    z AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN kind = 'cross_chapter' AND r <= 10 THEN 0 ELSE 1 END, {_SR}, kind_rank, count DESC, key) AS seat FROM o WHERE r <= 40)
    SELECT kind, kind_rank, severity, count, key, CAST(row_number() OVER (ORDER BY {_SR}, kind_rank, count DESC, key) AS INTEGER) AS rank FROM z WHERE seat <= 40"""
register("O04_merged_cap", lambda s, d: T.merged(all_rows(s, d)), f"WITH {_UNION}, {_MERGED}")
register("Q04_thrash_findings", lambda s, d: T.merged(all_rows(s, d)).select("rank", "kind", "severity", "count", "key"), f"SELECT rank, kind, severity, count, key FROM (WITH {_UNION}, {_MERGED})")
