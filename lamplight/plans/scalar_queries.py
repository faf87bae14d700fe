"""Queries of the scalar functions: each over the distinct tokens, the texts, or another whole column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamplight.functions import lexicons as L
from lamplight.functions import scalars as S
from lamplight.operators.dialogue import without_front_matter
from lamplight.plans.registry import register
from lamplight.plans.views import DIALOGUE, dialogue, table

_TOK = r"SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z\-'']*')) AS tok FROM (SELECT text FROM documents UNION ALL SELECT text FROM conversations UNION ALL SELECT p_name || '''s' FROM part)"


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select("text").unionByName(table(spark, sf_dir, "conversations").select("text"))
    texts = texts.unionByName(table(spark, sf_dir, "part").select(F.concat("p_name", F.lit("'s")).alias("text")))
    return texts.select(F.explode(F.regexp_extract_all("text", F.lit(f"({S.TOKEN})"), F.lit(1))).alias("tok")).distinct()


def _on_tokens(name: str, column: Column | None, sql: str, make=None) -> None:
    register(name, lambda s, d: tokens(s, d).select("tok", (make() if make else column).alias("value")), f"SELECT tok, {sql} AS value FROM ({_TOK})")


def _on_docs(name: str, make, sql: str) -> None:
    register(name, lambda s, d: table(s, d, "documents").select("doc_id", make().alias("value")), f"SELECT doc_id, {sql} AS value FROM documents")


def _list(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)



def d_lemma(x: str) -> str:
    low = f"lower({x})"
    return f"CASE WHEN ends_with({low}, '''s') THEN substr({low}, 1, length({low}) - 2) WHEN length({low}) > 3 AND ends_with({low}, 's') AND NOT ends_with({low}, 'ss') THEN substr({low}, 1, length({low}) - 1) ELSE {low} END"


def d_norm(x: str) -> str:
    low = f"replace(lower({x}), '-', '')"
    es = " OR ".join(f"ends_with({low}, '{e}')" for e in ("xes", "zes", "ches", "shes", "sses"))
    cut = lambda n: f"substr({low}, 1, length({low}) - {n})"
    return f"""CASE WHEN ends_with({low}, '''s') THEN {cut(2)} WHEN length({low}) > 4 AND ends_with({low}, 'ies') THEN {cut(3)} || 'y'
        WHEN length({low}) > 4 AND ({es}) THEN {cut(2)} WHEN length({low}) > 3 AND ends_with({low}, 's') AND NOT ends_with({low}, 'ss') THEN {cut(1)} ELSE {low} END"""


def d_bare(x: str) -> str:
    for curly, straight in (("‘", "'"), ("’", "'"), ("“", '"'), ("”", '"')):
        x = f"replace({x}, {_list([curly])}, {_list([straight])})"
    flat = rf"lower(trim(regexp_replace({x}, '\s+', ' ', 'g')))"
    return f"CASE WHEN ends_with({flat}, '''s') THEN substr({flat}, 1, length({flat}) - 2) ELSE {flat} END"


_on_tokens("F01_lemma", None, d_lemma("tok"), lambda: S.lemma(F.col("tok")))
_on_tokens("F02_norm_token", None, d_norm("tok"), lambda: S.norm_token(F.col("tok")))
_on_tokens("F15_bare_name", None, d_bare("tok"), lambda: S.bare_name(F.col("tok")))
_on_tokens("F24_slug", None, r"regexp_replace(regexp_replace(lower(tok), '[^a-z0-9_\-]+', '-', 'g'), '^-+|-+$', '', 'g')", lambda: S.slug(F.col("tok")))
_FORMS = ", ".join(f"('{a}', '{b}')" for a, b in L.speech_forms())


def canonical_tags(spark: SparkSession, toks: DataFrame) -> DataFrame:
    """The counted form of a speech verb, by the word or else by its lemma; bare attribution drops out."""
    forms = spark.createDataFrame(L.speech_forms(), "form string, counted string")
    by_word = toks.withColumn("low", F.lower("tok")).join(F.broadcast(forms), F.col("low") == F.col("form"), "left").withColumnRenamed("counted", "c1").drop("form")
    by_lemma = by_word.withColumn("lem", S.lemma(F.col("tok"))).join(F.broadcast(forms), F.col("lem") == F.col("form"), "left")
    found = by_lemma.withColumn("tag", F.coalesce("c1", "counted"))
    return found.filter(F.col("tag").isNotNull() & ~F.col("tag").isin(L.BARE_ATTRIBUTION)).select("tok", "tag")


# attribution words do not occur in the invented prose, so the told dialogue feeds this one
_DTOK = rf"{DIALOGUE}, tk AS (SELECT DISTINCT unnest(regexp_extract_all(content, '[A-Za-z][A-Za-z\-'']*')) AS tok FROM dialogue)"
register(
    "F05_canonical_tag",
    lambda s, d: canonical_tags(s, dialogue(s, d).select(F.explode(F.regexp_extract_all("content", F.lit(f"({S.TOKEN})"), F.lit(1))).alias("tok")).distinct()),
    f"""WITH {_DTOK}, forms(form, counted) AS (VALUES {_FORMS}),
        m AS (SELECT tok, coalesce(a.counted, b.counted) AS tag FROM tk LEFT JOIN forms a ON a.form = lower(tok) LEFT JOIN forms b ON b.form = {d_lemma('tok')})
        SELECT tok, tag FROM m WHERE tag IS NOT NULL AND tag NOT IN ({_list(L.BARE_ATTRIBUTION)})""",
)
register(
    "U03_fancy_tags",
    lambda s, d: L.words(s, [c for _, c in L.speech_forms()], "tag").exceptAll(L.words(s, L.BARE_ATTRIBUTION, "tag")),
    f"SELECT unnest([{_list(sorted({c for _, c in L.speech_forms()}))}]) AS tag EXCEPT SELECT unnest([{_list(L.BARE_ATTRIBUTION)}])",
)

_on_docs("F08_normalized_key", lambda: S.normalized_key(F.col("text")), r"lower(trim(regexp_replace(text, '\s+', ' ', 'g')))")
_on_docs(
    "F10_quote_fallback",
    lambda: S.around_first(F.col("text"), F.lit("the")),
    "CASE WHEN strpos(lower(text), 'the') > 0 THEN nullif(trim(substr(text, greatest(strpos(lower(text), 'the') - 40, 1), 160), ' '), '') END",
)
_on_docs("F12_substring_count", lambda: S.substring_count(F.lower(F.col("text")), F.lit("an")), "CAST((length(lower(text)) - length(replace(lower(text), 'an', ''))) // 2 AS BIGINT)")
_on_docs(
    "F13_char_to_word",
    lambda: F.when(F.length("text") > 100, F.size(F.split(F.trim(F.left("text", F.lit(100))), r"[ \n]+"))).otherwise(-1),
    r"CASE WHEN length(text) > 100 THEN CAST(len(string_split_regex(trim(left(text, 100)), '[ \n]+')) AS INTEGER) ELSE -1 END",
)
_FOLD = "text"
for _from, _to in [*[(c, "'") for c in "‘’‚‛′"], *[(c, '"') for c in "“”„″"], *[(c, "-") for c in "—–‒‑‐"], ("\xa0", " "), ("*", ""), ("_", ""), ("`", ""), ("…", "...")]:
    _FOLD = f"replace({_FOLD}, {_list([_from])}, {_list([_to])})"
_on_docs("F14_normalized_text", lambda: S.normalized_quote(F.col("text")), rf"lower(trim(regexp_replace({_FOLD}, '\s+', ' ', 'g')))")
_on_docs("F20_card_text", lambda: S.card_text(F.col("text")), r"trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))")
_on_docs("F22_clip", lambda: S.clip(F.col("text"), 60), "CASE WHEN length(text) <= 60 THEN text ELSE rtrim(left(text, 59), ' ') || '…' END")
_on_docs("M10_content_hash", lambda: F.sha2("text", 256), "sha256(text)")
_on_docs("M11_cache_key", lambda: S.cache_key(F.col("doc_id"), F.col("lang"), F.col("text")), "sha256(CAST(doc_id AS VARCHAR) || chr(0) || lang || chr(0) || text || chr(0))")
_on_docs("M12_finding_id", lambda: S.finding_id(F.col("lang"), F.left("text", F.lit(80))), "left(sha1(lang || chr(0) || left(text, 80)), 12)")
_on_docs(
    "M13_stub_embedding",
    lambda: F.transform(S.stub_embedding(F.col("text"), 384), lambda x: F.round(x, 9)),
    "list_transform(range(0, 384), lambda i: round(CAST(('0x' || substr(sha256(text), CAST((i % 32) * 2 + 1 AS INTEGER), 2)) AS INTEGER) / 255.0 * 2 - 1, 9))",
)
_on_docs("T02_front_matter", lambda: without_front_matter(F.concat(F.lit("---\ntitle: x\n---\n"), F.col("text"))), "text")
_on_docs("T12_whitespace_tokens", lambda: F.size(F.split(F.trim(F.regexp_replace("text", r"[ \t\r\n\f]+", " ")), " ")), r"CAST(len(string_split(trim(regexp_replace(text, '[ \t\r\n\f]+', ' ', 'g')), ' ')) AS INTEGER)")
_on_docs("T21_opening_window", lambda: F.regexp_extract("text", r"^\s*(?:\S+\s+){0,299}\S+", 0), r"regexp_extract(text, '^\s*(?:\S+\s+){0,299}\S+', 0)")
_on_docs("S04_title", lambda: F.coalesce(F.nullif(F.trim(F.regexp_extract(F.concat(F.lit("# "), F.col("text")), r"(?m)^\s*# (.*)$", 1)), F.lit("")), F.lit("untitled")),
    r"coalesce(nullif(trim(regexp_extract('# ' || text, '(?m)^\s*# (.*)$', 1)), ''), 'untitled')")

register(
    "F11_phrase_count",
    lambda s, d: table(s, d, "documents").select("doc_id", F.regexp_count("text", F.lit(r"(?i)(?<![A-Za-z0-9_])of the(?![A-Za-z0-9_])")).alias("value")),
    r"""WITH p AS (SELECT doc_id, ' ' || replace(replace(regexp_replace(replace(lower(text), ' ', chr(1)), '[^a-z0-9_\x01]', chr(2), 'g'), chr(1), '  '), chr(2), ' | ') || ' ' AS t FROM documents)
        SELECT doc_id, CAST((length(t) - length(replace(t, ' of  the ', ''))) // 9 AS INTEGER) AS value FROM p""",
)
register(
    "S08_crude_strip",
    lambda s, d: table(s, d, "pages").select("page_id", F.regexp_replace("html", "<[^>]+>", " ").alias("value")),
    "SELECT page_id, regexp_replace(html, '<[^>]+>', ' ', 'g') AS value FROM pages",
)
register(
    "S09_page_title",
    lambda s, d: table(s, d, "pages").select(
        "page_id",
        F.coalesce(*[F.nullif(F.trim(F.regexp_replace(F.regexp_extract("html", rf"(?is)<{t}[^>]*>(.*?)</{t}>", 1), r"\s+", " ")), F.lit("")) for t in ("title", "h1", "h2")], F.lit("untitled")).alias("value"),
    ),
    "SELECT page_id, coalesce("
    + ", ".join(rf"nullif(trim(regexp_replace(regexp_extract(html, '(?is)<{t}[^>]*>(.*?)</{t}>', 1), '\s+', ' ', 'g')), '')" for t in ("title", "h1", "h2"))
    + ", 'untitled') AS value FROM pages",
)
register(
    "T11_tokens",
    lambda s, d: table(s, d, "documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(f"({S.TOKEN})"), F.lit(1))).alias("pos", "tok")),
    r"""SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS pos, unnest(l) AS tok FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z][A-Za-z\-'']*') AS l FROM documents)""",
)
register(
    "T19_vocabulary",
    lambda s, d: table(s, d, "documents").select("source", F.explode(F.regexp_extract_all("text", F.lit(r"([a-z][a-z'\-]+)"), F.lit(1))).alias("word")).distinct(),
    r"SELECT DISTINCT source, unnest(regexp_extract_all(text, '[a-z][a-z''\-]+')) AS word FROM documents",
)
_PROTECTED = "text"
for _a in L.ABBREVIATIONS:
    _PROTECTED = f"replace({_PROTECTED}, '{_a}', '{_a[:-1]}' || chr(2))"
register(
    "T06_sentences",
    lambda s, d: sentences(table(s, d, "documents")),
    rf"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace({_PROTECTED}, '([.!?])[ \n]+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(replace(x, chr(2), '.'))), lambda x: x <> '') AS l FROM documents)
        SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS pos, unnest(l) AS sentence FROM l""",
)
register(
    "T08_fixed_chunks",
    lambda s, d: table(s, d, "documents").select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 1300).cast("int")), lambda i: F.substring(F.col("text"), i * 1300 + 1, F.lit(1500)))).alias("chunk_index", "chunk")),
    """WITH c AS (SELECT doc_id, list_transform(range(0, (length(text) - 1) // 1300 + 1), lambda i: substr(text, i * 1300 + 1, 1500)) AS l FROM documents WHERE length(text) > 0)
       SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS chunk_index, unnest(l) AS chunk FROM c""",
)


def sentences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A sentence ends at . ! or ? before white space; known abbreviations do not end one."""
    body = F.col(text)
    for a in L.ABBREVIATIONS:
        body = F.replace(body, F.lit(a), F.lit(a[:-1] + "\x02"))
    parts = F.split(body, r"(?<=[.!?])[ \n]+")
    parts = F.filter(F.transform(parts, lambda p: F.trim(F.replace(p, F.lit("\x02"), F.lit(".")))), lambda p: p != "")
    return docs.select(key, F.posexplode(parts).alias("pos", "sentence"))


# --- severities, bands and weights over rows with numbers ----------------------------------------------------------

def _lines(s, d):
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("n"), (F.col("l_discount") * 10).cast("double").alias("p"))


_LINES = "(SELECT l_orderkey, l_linenumber, CAST(floor(l_quantity) AS INTEGER) AS n, CAST(l_discount * 10 AS DOUBLE) AS p FROM lineitem)"
_SEV = "CASE WHEN {0} >= {1} THEN 'high' WHEN {0} >= {2} THEN 'moderate' ELSE 'low' END"


def _on_lines(name: str, make, sql: str) -> None:
    register(name, lambda s, d: _lines(s, d).select("l_orderkey", "l_linenumber", make().alias("value")), f"SELECT l_orderkey, l_linenumber, {sql} AS value FROM {_LINES}")


_on_lines("M01_severity", lambda: S.severity(F.col("n")), _SEV.format("n", 4, 2))
_on_lines("M02_common_severity", lambda: S.severity(F.col("n"), 8, 6), _SEV.format("n", 8, 6))
_on_lines("M03_over_threshold", lambda: S.over_threshold(F.col("n"), F.col("l_orderkey") % 5000 + 1, F.col("l_linenumber") == 1),
    "n >= CASE WHEN l_linenumber = 1 THEN 10 ELSE 6 END OR (l_orderkey % 5000 + 1 >= 1000 AND n >= 4 AND n * 1000.0 / (l_orderkey % 5000 + 1) >= CASE WHEN l_linenumber = 1 THEN 1.8 ELSE 1.2 END)")
_on_lines("M04_repetition_severity", lambda: S.severity(F.col("n"), 10, 5), _SEV.format("n", 10, 5))
_on_lines("M05_register_severity", lambda: F.when((F.col("l_linenumber") < 3) & (F.col("n") >= 5), "high").when(F.col("l_linenumber") < 5, "moderate").otherwise("low"),
    "CASE WHEN l_linenumber < 3 AND n >= 5 THEN 'high' WHEN l_linenumber < 5 THEN 'moderate' ELSE 'low' END")
_on_lines("M06_row_weight", lambda: S.row_weight(S.severity(F.col("n")), F.col("n")), f"CAST((CASE {_SEV.format('n', 4, 2)} WHEN 'high' THEN 3 WHEN 'moderate' THEN 2 ELSE 1 END) * (1 + floor(log10(greatest(n, 1)))) AS INTEGER)")
_on_lines("M07_band", lambda: S.band(F.col("p")), "CASE WHEN p >= 0.65 THEN 'positive' WHEN p >= 0.35 THEN 'mid' ELSE 'negative' END")
_on_lines("M09_severity_rank", lambda: S.severity_rank(S.severity(F.col("n"))), "CASE WHEN n >= 4 THEN 0 WHEN n >= 2 THEN 1 ELSE 2 END")
_on_lines("N04_chapter_chars", lambda: F.when(F.col("l_linenumber") == 1, 4000).otherwise(16000), "CASE WHEN l_linenumber = 1 THEN 4000 ELSE 16000 END")
register(
    "M16_safe_int",
    lambda s, d: table(s, d, "part").select("p_partkey", F.expr("CASE WHEN try_cast(p_size AS INT) > 10 THEN try_cast(p_size AS INT) END").alias("positive"), F.expr("try_cast(p_name AS INT)").alias("bad")),
    "SELECT p_partkey, CASE WHEN try_cast(p_size AS INTEGER) > 10 THEN try_cast(p_size AS INTEGER) END AS positive, try_cast(p_name AS INTEGER) AS bad FROM part",
)
register(
    "M17_shares",
    lambda s, d: table(s, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.count_if(F.col("l_quantity") > 25) / F.count(F.lit(1)), 3).alias("share")),
    "SELECT l_suppkey, round(count(*) FILTER (l_quantity > 25) / count(*), 3) AS share FROM lineitem GROUP BY 1",
)
