"""The registered queries of the training-data operators, and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import chat, decontam, hnsw, html_extract, langid, packing, probminhash, quality, suffix_dedup, text as T, url_filter

URL_RULES: list[url_filter.Rule] = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def fold_of(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(fold_of(doc_id) == 2, F.lit(False))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(T.table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(T.table(spark, sf_dir, "pages"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest(T.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = T.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    return chat.conversation_digests(talks.unionByName(tricky))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(T.table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probminhash.near_duplicates(T.table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = T.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(documents, T.table(spark, sf_dir, "labels"), ~held_out())
    return quality.score(documents, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(T.table(spark, sf_dir, "pages"), URL_RULES).drop("p_block")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path and rule of every page, and the rule's verdict: what of op8 SQL can express."""
    rows = T.table(spark, sf_dir, "pages").select("page_id", url_filter.host_of(F.col("url")).alias("host"), url_filter.path_of(F.col("url")).alias("path"))
    rule, verdict = url_filter.ruled(F.col("host"), F.col("path"), URL_RULES)
    return rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(T.table(spark, sf_dir, "documents").select("doc_id", "text"), T.table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = T.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(documents, ~held_out())
    return langid.identify(documents, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_packing, op2_html_extraction, op3_nearest_neighbours, op4_chat_formatting, op5_suffix_array_dedup, op6_minhash_near_dedup, op7_quality_classifier, op8_url_filters, url_rules, op9_benchmark_decontamination, op10_language_id)
}

_ESCAPED = r"""regexp_replace({0}, '([<\[])(\\*)(/?s>|/?INST\]|/?SYS\]|/?ROLE\]|OUT\])', '\1\2\\\3', 'g')"""

ORACLES: dict[str, str] = {
    "url_rules": r"""
        WITH u AS (
            SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages),
        rules(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/'))
        SELECT page_id, host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
        FROM u LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL""",
    "op4_chat_formatting": f"""
        WITH t AS (
            SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (CAST(-1 AS BIGINT), CAST(0 AS BIGINT), 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(length({_ESCAPED.format("text")}) + CASE role WHEN 'user' THEN 16 WHEN 'assistant' THEN 9 WHEN 'system' THEN 14
                    ELSE 20 + length({_ESCAPED.format("role")}) END) AS BIGINT) AS formatted_chars
        FROM t GROUP BY conv_id""",
}
