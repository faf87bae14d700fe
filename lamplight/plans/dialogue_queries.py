"""Queries of the dialogue operators over the told conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamplight.operators import dialogue as D
from lamplight.plans.registry import register
from lamplight.plans.views import DIALOGUE, dialogue

WORD = "[A-Za-z0-9]+(?:[''’][A-Za-z]+)*"
BASE = rf"""{DIALOGUE},
    parts AS (SELECT conv_id, list_filter(list_transform(string_split_regex(content, '\n\s*\n'), lambda p: trim(regexp_replace(p, '\s+', ' ', 'g'))),
        lambda p: p <> '' AND NOT starts_with(p, '#') AND NOT regexp_full_match(p, '[*\-_ ]+')) AS l FROM dialogue),
    p AS (SELECT conv_id, unnest(l) AS para, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS para_no FROM parts),
    t0 AS (SELECT *, list_filter(list_transform(regexp_extract_all(para, '["“]([^"“”]*)["”]?', 1), lambda s: trim(s)), lambda s: s <> '') AS said FROM p),
    t1 AS (SELECT conv_id, para_no, para, CASE WHEN len(said) > 0 THEN array_to_string(said, ' ') END AS spoken FROM t0),
    t AS (SELECT *, CAST(len(regexp_extract_all(spoken, '{WORD}')) AS INTEGER) AS spoken_words, CAST(len(regexp_extract_all(para, '{WORD}')) AS INTEGER) AS words FROM t1)"""


def _turned(spark, sf_dir):
    return D.turns(D.paragraphs(dialogue(spark, sf_dir), "conv_id"))


def _plain(spark, sf_dir):
    """Shape statistics without the two markers that DuckDB cannot match."""
    return D.shape(_turned(spark, sf_dir), "conv_id")


register("T05_paragraphs", lambda s, d: D.paragraphs(dialogue(s, d), "conv_id"), f"WITH {BASE} SELECT conv_id, para_no, para FROM p")
register("T13_word_count", lambda s, d: _turned(s, d).select("conv_id", "para_no", "words"), f"WITH {BASE} SELECT conv_id, para_no, words FROM t")
register(
    "T16_turns",
    lambda s, d: _turned(s, d).filter("spoken IS NOT NULL").select("conv_id", "para_no", "spoken", "spoken_words"),
    f"WITH {BASE} SELECT conv_id, para_no, spoken, spoken_words FROM t WHERE spoken IS NOT NULL",
)
_RUNS = """r AS (SELECT *, sum(CASE WHEN spoken IS NULL THEN (words > 30)::INT ELSE (spoken_words > 12)::INT END) OVER (PARTITION BY conv_id ORDER BY para_no) AS run FROM t),
    v AS (SELECT conv_id, count(*) AS turns, min(para_no) AS start_paragraph FROM r WHERE spoken_words <= 12 GROUP BY conv_id, run)"""
register("W02_volleys", lambda s, d: D.volleys(_turned(s, d), "conv_id"), f"WITH {BASE}, {_RUNS} SELECT conv_id, turns, start_paragraph FROM v")
_PAIRS = """n AS (SELECT *, sum(CASE WHEN spoken IS NULL THEN words ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY para_no) AS told FROM t),
    x AS (SELECT conv_id, para_no, spoken, lag(spoken) OVER w AS prev, told - lag(told) OVER w AS gap FROM n WHERE spoken IS NOT NULL WINDOW w AS (PARTITION BY conv_id ORDER BY para_no))"""
register(
    "T17_exchange_pairs",
    lambda s, d: D.exchange_pairs(_turned(s, d), "conv_id"),
    f"WITH {BASE}, {_PAIRS} SELECT conv_id, para_no, prev, spoken, CAST(gap AS BIGINT) AS gap FROM x WHERE prev IS NOT NULL AND NOT ends_with(rtrim(prev), '?') AND gap <= 30",
)
register(
    "W03_adjacent_gap",
    lambda s, d: D.exchange_pairs(_turned(s, d), "conv_id").groupBy("conv_id").agg(F.count(F.lit(1)).alias("pairs"), F.max("gap").alias("widest")),
    f"WITH {BASE}, {_PAIRS} SELECT conv_id, count(*) AS pairs, CAST(max(gap) AS BIGINT) AS widest FROM x WHERE prev IS NOT NULL AND NOT ends_with(rtrim(prev), '?') AND gap <= 30 GROUP BY 1",
)
register(
    "T22_batches",
    lambda s, d: D.exchange_pairs(_turned(s, d), "conv_id")
    .withColumn("batch", F.expr("(row_number() OVER (PARTITION BY conv_id ORDER BY para_no) - 1) div 60"))
    .groupBy("conv_id", "batch")
    .agg(F.count(F.lit(1)).alias("n"), F.max(F.length(F.left("spoken", F.lit(300)))).alias("longest")),
    f"""WITH {BASE}, {_PAIRS}, k AS (SELECT * FROM x WHERE prev IS NOT NULL AND NOT ends_with(rtrim(prev), '?') AND gap <= 30),
        b AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY para_no) - 1) // 60 AS batch FROM k)
        SELECT conv_id, batch, count(*) AS n, CAST(max(length(left(spoken, 300))) AS INTEGER) AS longest FROM b GROUP BY 1, 2""",
)
_STATS = """st AS (SELECT conv_id, count(spoken) AS turns, CAST(sum(words) AS BIGINT) AS words, CAST(coalesce(sum(spoken_words), 0) AS BIGINT) AS spoken_words,
      count(*) FILTER (spoken_words <= 12) AS short_turns, count(*) FILTER (spoken_words >= 40) AS long_turns, coalesce(max(spoken_words), 0) AS longest_turn FROM t GROUP BY 1),
    ss AS (SELECT *, round(coalesce(spoken_words / nullif(words, 0), 0.0), 3) AS dialogue_share, round(coalesce(short_turns / nullif(turns, 0), 0.0), 3) AS short_share,
      round(coalesce(long_turns / nullif(turns, 0), 0.0), 3) AS long_share FROM st)"""
_COLS = ["conv_id", "turns", "words", "spoken_words", "short_turns", "long_turns", "longest_turn", "dialogue_share", "short_share", "long_share"]
register("A12_dialogue_shape", lambda s, d: _plain(s, d).select(*_COLS), f"WITH {BASE}, {_STATS} SELECT {', '.join(_COLS)} FROM ss")
register(
    "A13_book_totals",
    lambda s, d: D.book_totals(_plain(s, d)),
    f"""WITH {BASE}, {_STATS} SELECT CAST(sum(turns) AS BIGINT) AS turns, CAST(sum(words) AS BIGINT) AS words, round(sum(short_share * turns) / sum(turns), 3) AS short_share,
        round(sum(long_share * turns) / sum(turns), 3) AS long_share, max(longest_turn) AS longest_turn FROM ss""",
)
register(
    "F26_hesitation_markers",
    lambda s, d: _plain(s, d).select("conv_id", "broken_off", "trailing_off", "hedge"),
    rf"""WITH {BASE} SELECT conv_id, count(*) FILTER (regexp_matches(spoken, '—|--|–')) AS broken_off, count(*) FILTER (regexp_matches(spoken, '\.\.\.|…|\. \. \.')) AS trailing_off,
        count(*) FILTER (regexp_matches(spoken, '(?i)\b(?:maybe|perhaps|I guess|I think|I suppose|probably|I''m not sure|I don''t know|not sure|might|seems?|I believe)\b')) AS hedge
        FROM t GROUP BY 1""",
)
register("Q07_dialogue_findings", lambda s, d: D.findings(_plain(s, d), D.volleys(_turned(s, d), "conv_id"), "conv_id"))
register(
    "O10_volley_rows",
    lambda s, d: D.findings(_plain(s, d), D.volleys(_turned(s, d), "conv_id"), "conv_id")
    .filter("kind <> 'fluent_speech'")
    .withColumn("rank", F.expr("row_number() OVER (ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'moderate' THEN 1 ELSE 2 END, kind, metric DESC, conv_id, start_paragraph)"))
    .filter("rank <= 30"),
    f"""WITH {BASE}, {_RUNS}, {_STATS},
        f AS (SELECT v.conv_id, 'volley' AS kind, CASE WHEN long_share < 0.03 THEN CASE WHEN v.turns >= 16 THEN 'high' ELSE 'moderate' END ELSE 'low' END AS severity,
                     v.turns, CAST(start_paragraph + 1 AS INTEGER) AS start_paragraph, CAST(v.turns AS DOUBLE) AS metric FROM v JOIN ss USING (conv_id) WHERE v.turns >= 10
              UNION ALL SELECT conv_id, 'no_long_speech', 'moderate', turns, NULL, CAST(longest_turn AS DOUBLE) FROM ss WHERE turns >= 25 AND longest_turn < 40),
        k AS (SELECT *, CAST(row_number() OVER (ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'moderate' THEN 1 ELSE 2 END, kind, metric DESC, conv_id, start_paragraph) AS INTEGER) AS rank FROM f)
        SELECT * FROM k WHERE rank <= 30""",
)
