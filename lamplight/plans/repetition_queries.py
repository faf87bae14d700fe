"""Queries of the repetition operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamplight.functions import lexicons as L
from lamplight.operators import repetition as R
from lamplight.plans.registry import register
from lamplight.plans.scalar_queries import _PROTECTED, _list, sentences
from lamplight.plans.views import CHAPTERS, DIALOGUE, chapters, dialogue, table

KEY = ["manuscript", "chapter_number"]
TERMS = rf"""{CHAPTERS}, tm0 AS (SELECT manuscript, chapter_number, list_filter(regexp_extract_all(lower(content), '[\p{{L}}\p{{N}}_]+'),
      lambda t: regexp_full_match(t, '[a-z]{{2,}}') AND t NOT IN ({_list(L.REPORT_STOP_WORDS)})) AS l FROM chapters),
    tm AS (SELECT manuscript, chapter_number, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS term FROM tm0)"""


def _tfidf(src: str) -> str:
    return f"""ct AS (SELECT manuscript, chapter_number, term, count(*) AS tf FROM {src} GROUP BY 1, 2, 3),
    tt AS (SELECT manuscript, term, sum(tf) AS total, count(*) AS df FROM ct GROUP BY 1, 2),
    vo AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY manuscript ORDER BY total DESC, term) AS n FROM tt) WHERE n <= 5000),
    ch AS (SELECT manuscript, count(DISTINCT chapter_number) AS chapters FROM {src} GROUP BY 1),
    we AS (SELECT ct.manuscript, chapter_number, ct.term, total, chapters, tf * (ln((1 + chapters) / (1 + df)) + 1) AS w FROM ct JOIN vo USING (manuscript, term) JOIN ch USING (manuscript)),
    no AS (SELECT manuscript, chapter_number, sqrt(sum(w * w)) AS norm FROM we GROUP BY 1, 2),
    tfidf AS (SELECT manuscript, term, round(sum(w / norm) / any_value(chapters), 6) AS tfidf, CAST(any_value(total) AS BIGINT) AS total FROM we JOIN no USING (manuscript, chapter_number) GROUP BY 1, 2)"""


def _terms(s, d):
    return R.terms(chapters(s, d), KEY)


def _phrases(s, d):
    """A chapter is a document, so its id stands for its number."""
    docs = table(s, d, "documents").select(F.col("source").alias("manuscript"), "doc_id", F.col("text").alias("content"))
    return R.gram_tfidf(docs, "manuscript", "doc_id").filter("total >= 3")


register("A01_word_tfidf", lambda s, d: R.tfidf(_terms(s, d), *KEY), f"WITH {TERMS}, {_tfidf('tm')} SELECT * FROM tfidf")
register(
    "O01_top_words",
    lambda s, d: R.top(R.tfidf(_terms(s, d), *KEY), "manuscript"),
    f"WITH {TERMS}, {_tfidf('tm')}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY manuscript ORDER BY tfidf DESC, term) AS INTEGER) AS rank FROM tfidf) SELECT * FROM r WHERE rank <= 50",
)
_NG = """tl AS (SELECT *, lead(term, 1) OVER w AS t1, lead(term, 2) OVER w AS t2 FROM tm WINDOW w AS (PARTITION BY manuscript, chapter_number ORDER BY pos)),
    ng AS (SELECT manuscript, chapter_number, term || ' ' || t1 AS term FROM tl WHERE t1 IS NOT NULL UNION ALL SELECT manuscript, chapter_number, term || ' ' || t1 || ' ' || t2 FROM tl WHERE t2 IS NOT NULL)"""
register(
    "T15_ngrams",
    lambda s, d: R.ngrams(_terms(s, d), KEY).groupBy("manuscript", "term").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"),
    f"WITH {TERMS}, {_NG} SELECT manuscript, term, count(*) AS n FROM ng GROUP BY 1, 2 HAVING count(*) > 1",
)
register(
    "A03_phrase_frequency",
    lambda s, d: _phrases(s, d).withColumn("score", F.round(F.col("total") * F.col("tfidf") + 1e-9, 4)).select("manuscript", "term", "total", "score"),
    f"WITH {TERMS}, {_NG}, {_tfidf('ng')} SELECT manuscript, term, total, round(total * tfidf + 1e-9, 4) AS score FROM tfidf WHERE total >= 3",
)
register(
    "O02_top_phrases",
    lambda s, d: R.top(_phrases(s, d), "manuscript", 20).select("manuscript", "rank", "term"),
    f"WITH {TERMS}, {_NG}, {_tfidf('ng')}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY manuscript ORDER BY tfidf DESC, term) AS INTEGER) AS rank FROM tfidf WHERE total >= 3) SELECT manuscript, rank, term FROM r WHERE rank <= 20",
)
register(
    "A02_word_totals",
    lambda s, d: table(s, d, "documents").select("source", F.explode(F.split(F.lower("text"), r"[ \t\r\n\f]+")).alias("word")).filter("word <> ''").groupBy("source", "word").agg(F.count(F.lit(1)).alias("n")),
    r"WITH w AS (SELECT source, unnest(string_split_regex(lower(text), '[ \t\r\n\f]+')) AS word FROM documents) SELECT source, word, count(*) AS n FROM w WHERE word <> '' GROUP BY 1, 2",
)
register(
    "A25_total_words",
    lambda s, d: table(s, d, "documents").groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(r"[^ \t\r\n\f]+"))).alias("words")),
    r"SELECT source, CAST(sum(len(regexp_extract_all(text, '[^ \t\r\n\f]+'))) AS BIGINT) AS words FROM documents GROUP BY 1",
)
SENT = rf"""sl AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace({_PROTECTED}, '([.!?])[ \n]+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(replace(x, chr(2), '.'))), lambda x: x <> '') AS l FROM documents),
    se AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS sentence FROM sl)"""


def _sent(s, d):
    return sentences(table(s, d, "documents"))


register(
    "A04_openings",
    lambda s, d: R.openings(_sent(s, d), "doc_id"),
    rf"""WITH {SENT}, w AS (SELECT *, list_filter(string_split_regex(lower(sentence), '[ \n]+'), lambda x: x <> '') AS l FROM se)
        SELECT doc_id, array_to_string(l[1:3], ' ') AS opening, count(*) AS count, (list(sentence ORDER BY pos))[1:5] AS examples FROM w WHERE len(l) >= 3 GROUP BY 1, 2 HAVING count(*) >= 3""",
)
register(
    "W01_monotony",
    lambda s, d: R.monotony(_sent(s, d), "doc_id"),
    rf"""WITH {SENT}, n AS (SELECT doc_id, pos, len(list_filter(string_split_regex(sentence, '[ \n]+'), lambda x: x <> '')) AS n FROM se),
        m AS (SELECT doc_id, pos, avg(n) OVER w AS mean, min(n) OVER w AS lo, max(n) OVER w AS hi, count(n) OVER w AS r FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING))
        SELECT doc_id, CAST(pos AS INTEGER) AS pos, round(mean, 4) AS mean, round(1 - greatest(hi - mean, mean - lo) / mean, 4) AS score FROM m WHERE r = 5 AND mean >= 3 AND greatest(hi - mean, mean - lo) / mean <= 0.2""",
)
_FORMS = ", ".join(f"('{a}', '{b}')" for a, b in L.speech_forms())
register(
    "A05_attribution",
    lambda s, d: R.attribution(dialogue(s, d), "conv_id", s.createDataFrame(L.speech_forms(), "form string, counted string")),
    rf"""WITH {DIALOGUE}, forms(form, counted) AS (VALUES {_FORMS}),
        m0 AS (SELECT conv_id, regexp_extract_all(content, '["”’'']\s*[,.]?\s+(?:(?:he|she|they|[A-Z][a-z]+)\s+)?([a-z]+)(?: +[a-z]+ly)?', 1) AS v,
          regexp_extract_all(content, '["”’'']\s*[,.]?\s+(?:(?:he|she|they|[A-Z][a-z]+)\s+)?[a-z]+( +[a-z]+ly)?', 1) AS a FROM dialogue),
        m AS (SELECT conv_id, unnest(v) AS v, unnest(a) AS a FROM m0)
        SELECT conv_id, counted AS tag, count(*) AS count, count(*) FILTER (a <> '') AS adverbs, count(*) FILTER (a <> '') > 0.3 * count(*) AS adverb_heavy FROM m JOIN forms ON form = v GROUP BY 1, 2""",
)
register("J07_near_sentences", lambda s, d: R.band_pairs(_sent(s, d), "doc_id"))
register(
    "W06_neighbour_sentences",
    lambda s, d: _sent(s, d).withColumn("around", F.expr("array_join(collect_list(sentence) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), '|')")).select("doc_id", "pos", "around"),
    rf"WITH {SENT} SELECT doc_id, CAST(pos AS INTEGER) AS pos, string_agg(sentence, '|') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS around FROM se",
)
