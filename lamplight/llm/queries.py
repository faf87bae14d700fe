"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamplight.llm import bpe, chat, ctw, exact_dedup, licenses, mixing, near_dedup, sharding, topk, toxicity
from lamplight.llm.common import read


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"))


def op2_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score_documents(read(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.byte_shards(read(spark, sf_dir, "documents"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.chat_examples(turns.unionByName(more)))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return topk.exact_top_k(vectors, vectors.filter("vec_id % 50 = 0"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(read(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.bpe_encode(read(spark, sf_dir, "documents"), word_bpe_path(), digests=True)
    return done.select("doc_id", "n_tokens", F.col("ids").alias("ids_sha256"), F.col("decoded").alias("decoded_sha256"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return found.withColumn("n_spans", F.size("spans")).drop("spans")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(read(spark, sf_dir, "documents"))


def _license_oracle() -> str:
    rows = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in licenses.template_set())
    words = r"string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' ')"
    runs = "list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k} - 1], ' '))"
    short = " UNION ALL ".join(
        f"""SELECT doc_id, template_id, 1 AS n_found, 1 AS n_template, min(pos) AS first_shingle, max(pos) AS last_shingle
            FROM (SELECT doc_id, unnest(range(0, len(w) - {k - 1})) AS pos, unnest({runs.format(k=k)}) AS h FROM dw WHERE len(w) >= {k}) JOIN st USING (h) GROUP BY 1, 2"""
        for k in range(1, licenses.SHINGLE)
    )
    return rf"""
        WITH t(template_id, text) AS (VALUES {rows}),
        tw AS (SELECT template_id, {words} AS w FROM t),
        st AS (SELECT template_id, array_to_string(w, ' ') AS h FROM tw WHERE len(w) < 5 AND w[1] <> ''),
        ts AS (SELECT DISTINCT template_id, len(w) AS n, unnest({runs.format(k=5)}) AS h FROM tw WHERE len(w) >= 5),
        tm AS (SELECT template_id, h, regexp_matches(h, '{licenses.EXACT}') OR (n <= {licenses.NOTICE} AND regexp_matches(h, '[0-9]')) AS must FROM ts),
        tn AS (SELECT template_id, count(*) AS n_template, count(*) FILTER (must) AS n_must FROM tm GROUP BY 1),
        dw AS (SELECT doc_id, {words} AS w FROM documents),
        ds AS (SELECT doc_id, unnest(range(0, len(w) - 4)) AS pos, unnest({runs.format(k=5)}) AS h FROM dw WHERE len(w) >= 5),
        m AS (SELECT doc_id, template_id, count(DISTINCT h) AS n_found, count(DISTINCT h) FILTER (must) AS n_held, min(pos) AS first_shingle, max(pos) AS last_shingle
              FROM ds JOIN tm USING (h) GROUP BY 1, 2),
        a AS (SELECT doc_id, template_id, n_found, n_template, first_shingle, last_shingle FROM m JOIN tn USING (template_id) WHERE n_found >= {licenses.CONTAINED} * n_template AND n_held = n_must
              UNION ALL {short})
        SELECT doc_id, template_id, n_found / n_template AS containment, CAST(n_found AS BIGINT) AS n_found, CAST(n_template AS BIGINT) AS n_template, CAST(first_shingle AS INTEGER) AS first_shingle, CAST(last_shingle AS INTEGER) AS last_shingle FROM a"""


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_ctw": op2_ctw,
    "op3_sharding": op3_sharding,
    "op4_chat": op4_chat,
    "op5_topk": op5_topk,
    "op6_mixing": op6_mixing,
    "op7_bpe": op7_bpe,
    "op8_toxicity": op8_toxicity,
    "op9_licenses": op9_licenses,
    "op10_near_dedup": op10_near_dedup,
}

ORACLES: dict[str, str] = {
    "op1_exact_dedup": """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(text) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY text)""",
    "op4_chat": """
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        f AS (
            SELECT *, 23 + length(regexp_replace(role, '<([|!])', '<!\\1', 'g')) + length(regexp_replace(text, '<([|!])', '<!\\1', 'g')) AS chars FROM t),
        g AS (
            SELECT *, sum(chars) OVER w AS upto, sum(chars) OVER (PARTITION BY conv_id) AS whole,
                   max(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id) AS last_reply,
                   max(turn) OVER (PARTITION BY conv_id) AS last_turn
            FROM f WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING))
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(coalesce(sum(upto) FILTER (role = 'assistant'), 0)
                    + CASE WHEN coalesce(any_value(last_reply) <> any_value(last_turn), true) THEN any_value(whole) ELSE 0 END AS BIGINT) AS formatted_chars
        FROM g GROUP BY conv_id""",
    "op5_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, r.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, r.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
              FROM v q JOIN v r ON r.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
        k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 5""",
    "op3_sharding": r"""
        WITH RECURSIVE step(i, k, c) AS (
            SELECT range, 0, range FROM range(256)
            UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM step WHERE k < 8),
        crc AS (SELECT list(c ORDER BY i) AS crc_table FROM step WHERE k = 8),
        b AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size,
                     list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes FROM documents),
        s AS (SELECT doc_id, size, xor(list_reduce(bytes, lambda c, x: xor(c // 256, crc_table[CAST(xor(c % 256, x) AS BIGINT) + 1]), 4294967295), 4294967295) AS text_crc32 FROM b, crc),
        p AS (SELECT *, sum(size) OVER (ORDER BY doc_id, text_crc32, size ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total FROM s),
        h AS (SELECT *, CAST(least(23, (2 * before + size) * 24 // (2 * total)) AS INTEGER) AS shard FROM p)
        SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
               row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM h""",
    "op9_licenses": _license_oracle(),
    "op10_near_dedup": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 2, 2)), lambda i: array_to_string(w[i:i + 3], ' '))) AS h FROM w WHERE len(w) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        e AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM e JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
        r(doc_id, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reach),
        c AS (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY 1)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)""",
}
