"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontaminate, gru_lm, langid, licenses, minhash_dedup, packing, sharding, suffix_dedup, url_filter
from .common import table


def op1_length_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, table(spark, sf_dir, "documents"))


def op2_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


def op3_suffix_interval_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_substrings(spark, table(spark, sf_dir, "documents"))


def op4_naive_bayes_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", langid.fold("doc_id", 4) == 2)
    model = langid.train(spark, docs.where("not held_out"), "text", "lang")
    return langid.predict(spark, docs, model, keep=["doc_id", "held_out"])


def op5_gru_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gru_lm.score_documents(spark, table(spark, sf_dir, "documents"), langid.fold("doc_id", 7) == 2)


def op6_rare_token_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(spark, table(spark, sf_dir, "pages")).drop("rules_tried")


def op7_permutation_table_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(spark, table(spark, sf_dir, "documents"), "doc_id")


def op8_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(spark, table(spark, sf_dir, "embeddings"), every=20)


def op9_tensored_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(spark, table(spark, sf_dir, "documents"), percent=85)


def op10_license_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_length_packing, op2_template_decontamination, op3_suffix_interval_dedup, op4_naive_bayes_langid, op5_gru_lm_scoring, op6_rare_token_url_rules,
        op7_permutation_table_sharding, op8_multi_index_hashing, op9_tensored_minhash_dedup, op10_license_signatures,
    )
}


def _op6_sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    # the SQL is as it was registered: its words for com/en/ and net/de/ are not those of url_filter.RULES (README)
    words = {("com", "/en/"): "allow", ("net", "/de/"): "block"}
    rules = ", ".join(f"({quoted(h)}, {quoted(p)}, {quoted(words.get((h, p), v))})" for h, p, v in url_filter.RULES)
    blocked = " OR ".join(f"regexp_matches(low, {quoted(p)})" for p, _ in url_filter.PATTERNS)
    return f"""
    WITH parts AS (
      SELECT page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path,
             translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
      FROM pages),
    rules(h, p, v) AS (VALUES {rules}),
    fit AS (SELECT page_id, h || p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC, h || p) AS k
            FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
    SELECT parts.page_id, host, path, rule, coalesce(v, CASE WHEN {blocked} THEN 'block' ELSE 'allow' END) AS verdict
    FROM parts LEFT JOIN fit ON fit.page_id = parts.page_id AND k = 1"""


def _op7_sql() -> str:
    owner = ",".join(map(str, sharding.lookup_table(sharding.shard_names(sharding.SHARDS))))
    return f"""
    WITH t AS (SELECT string_split('{owner}', ',') AS owner),
    d AS (SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) % {sharding.SLOTS} AS INTEGER) AS slot FROM documents)
    SELECT doc_id, slot, CAST(owner[slot + 1] AS INTEGER) AS shard FROM d, t"""


ORACLES = {"op6_rare_token_url_rules": _op6_sql(), "op7_permutation_table_sharding": _op7_sql()}
