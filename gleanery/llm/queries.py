"""The thin queries of this subpackage, by name, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gleanery.llm import chat_format, decontaminate, exact_dedup, html_extract, langid, line_dedup, mixing, near_dedup, toxicity, url_filter

Query = Callable[[SparkSession, str], DataFrame]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return toxicity.predict(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return url_filter.judge(pages, url_filter.labelled_pages(pages, labels))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.digest(chat_format.with_probe(chat_format.turn_rows(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.group(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def queries() -> dict[str, Query]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_language_id": op2_language_id,
        "op3_url_filter": op3_url_filter,
        "op4_chat_format": op4_chat_format,
        "op5_mixing": op5_mixing,
        "op6_html_extraction": op6_html_extraction,
        "op7_exact_dedup": op7_exact_dedup,
        "op8_line_dedup": op8_line_dedup,
        "op9_decontamination": op9_decontamination,
        "op10_near_dedup": op10_near_dedup,
    }


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


_WORDS = "[w FOR w IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') IF w <> '']"
_OP9 = f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
    i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
    n AS (SELECT DISTINCT least(10, len(w)) AS k FROM i WHERE len(w) > 0),
    iw AS (SELECT DISTINCT item_id, k, array_to_string(w[p : p + k - 1], ' ') AS g
           FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM (SELECT item_id, w, least(10, len(w)) AS k FROM i WHERE len(w) > 0))),
    dw AS (SELECT r, k, p, array_to_string(w[p : p + k - 1], ' ') AS g
           FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, n WHERE len(w) >= k)),
    m AS (SELECT DISTINCT r, p, k, item_id FROM dw JOIN iw USING (k, g)),
    hit AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS q FROM (SELECT DISTINCT r, p, k FROM m)) GROUP BY r),
    it AS (SELECT r, count(*) AS n_items, sha256(string_agg(x, ',' ORDER BY x)) AS h FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY r)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)"""


_OP10 = f"""
    WITH RECURSIVE d AS (SELECT doc_id, [w FOR w IN string_split_regex({_LOWER}, '[\\x20\\x09-\\x0D]+') IF w <> ''] AS w FROM documents),
    s AS MATERIALIZED (SELECT DISTINCT doc_id, x FROM (
        SELECT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS x FROM d)),
    n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (x) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
    e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
    u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
    r AS (SELECT doc_id, doc_id AS o FROM documents UNION SELECT r.doc_id, u.b FROM r JOIN u ON u.a = r.o)
    SELECT documents.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(o) AS component_id, documents.doc_id = min(o) AS kept
    FROM documents LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY documents.doc_id"""


_ESCAPED = "length({0}) + length(regexp_replace({0}, '[^\\\\<\\[{1}]', '', 'g'))"
_OP4 = f"""
    WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
               UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           CAST(sum(11 + {_ESCAPED.format("role", "\\]")} + {_ESCAPED.format("text", "")}) AS BIGINT) AS formatted_chars
    FROM c GROUP BY conv_id"""


def oracle_sql() -> dict[str, str]:
    return {
        "op4_chat_format": _OP4,
        "op7_exact_dedup": f"""
            WITH t AS (SELECT doc_id, {_LOWER} AS x FROM documents)
            SELECT doc_id, max(doc_id) OVER (PARTITION BY x) AS keep_id, count(*) OVER (PARTITION BY x) AS group_size,
                   doc_id = max(doc_id) OVER (PARTITION BY x) AS kept, sha256(x) AS text_sha256
            FROM t""",
        "op9_decontamination": _OP9,
        "op10_near_dedup": _OP10,
    }
