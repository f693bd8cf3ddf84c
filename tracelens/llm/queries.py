"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelens.llm.common import table

#: Tokenizer file of the queries that need one.
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelens.llm.html_text import extract_text

    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelens.llm.exact_dup import exact_duplicates

    return exact_duplicates(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelens.llm.passages import dedup_passages

    d = dedup_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "words_before", "words_removed")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelens.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelens.llm.chat import chat_digests

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    more = spark.range(0, 2, 1, 1).select(F.lit(-7).alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(said).alias("text"))
    return chat_digests(rows.union(more))


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelens.llm.top_k import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelens.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelens.llm.line_dedup import dedup_lines

    d = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lines_before", "lines_removed")


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelens.llm.near_dup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelens.llm.bpe import encode_digests

    return encode_digests(table(spark, sf_dir, "documents"), tokenizer_path())


QUERIES = {f.__name__: f for f in (op1_html_text, op2_exact_dedup, op3_suffix_dedup, op4_toxicity, op5_chat_formatting, op6_top_k, op7_packing, op8_line_dedup, op9_minhash, op10_bpe)}

#: The pages of the test tables hold their main text in one article element.
ORACLE_SQL = {
    "op1_html_text": r"""
WITH a AS (
    SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article[^>]*>(.*)</article>', 1, 's') AS h FROM pages
), b AS (
    SELECT page_id, url, regexp_replace(regexp_replace(h, '</?(p|h1|br)[^>]*>', ' ', 'g'), '<[a-z/][^>]*>', '', 'g') AS t FROM a
), c AS (
    SELECT page_id, url, replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&') AS t FROM b
), d AS (SELECT page_id, url, trim(regexp_replace(t, '\s+', ' ', 'g')) AS text FROM c)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM d""",
    "op2_exact_dedup": r"""
WITH d AS (
    SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
    doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM d""",
    "op5_chat_formatting": r"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
    SELECT *, length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), '|>', '|\>'))
        + length(replace(replace(replace(text, '\', '\\'), '<|', '<\|'), '|>', '|\>')) + 18 AS n
    FROM t
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""",
    "op6_top_k": r"""
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.e, v.e) AS BIGINT) AS score
    FROM v q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e) WHERE q.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op8_line_dedup": r"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), p AS (
    SELECT doc_id, text, ls, unnest(range(0, len(ls) - 2)) AS pos FROM d WHERE len(ls) >= 3
), w AS (
    SELECT doc_id, pos, ls[pos + 1] || chr(10) || ls[pos + 2] || chr(10) || ls[pos + 3] AS win FROM p
    WHERE trim(ls[pos + 1] || ls[pos + 2] || ls[pos + 3], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''
), later AS (
    SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS k FROM w) WHERE k > 1
), gone AS (
    SELECT DISTINCT doc_id, pos + k AS line FROM later, (SELECT unnest([0, 1, 2]) AS k)
), kept AS (
    SELECT l.doc_id, string_agg(l.line_text, chr(10) ORDER BY l.line) AS text
    FROM (SELECT doc_id, unnest(range(0, len(ls))) AS line, unnest(ls) AS line_text FROM d) l
    ANTI JOIN gone g ON l.doc_id = g.doc_id AND l.line = g.line GROUP BY l.doc_id
), n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(kept.text, '') AS text, CAST(CASE WHEN d.text = '' THEN 0 ELSE len(d.ls) END AS BIGINT) AS lines_before,
    CAST(coalesce(n.n, 0) AS BIGINT) AS lines_removed
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
}
