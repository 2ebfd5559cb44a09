"""One query for each operator of this subpackage, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brindle.llm import ann, join, langid, mixing, packing, quality, rules, secrets, toxicity, urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predictions(table(spark, sf_dir, "documents"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(table(spark, sf_dir, "documents"))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(table(spark, sf_dir, "embeddings"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join.jaccard_classes(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


# --- parts of results that SQL can express where it can't express the whole ---


def secrets_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_url_filter(spark, sf_dir).select("page_id", "host", "path", "rule")


QUERIES = {f.__name__: f for f in (op1_language_id, op2_source_mixing, op3_secret_scan, op4_nearest_neighbours, op5_jaccard_join, op6_packing, op7_url_filter, op8_quality_classifier, op9_quality_rules, op10_toxicity, secrets_base, quality_base, url_rules)}
#: Queries that SQL can express.
ORACLE: dict[str, str] = {"op2_source_mixing": mixing.oracle(), "op4_nearest_neighbours": ann.oracle(), "op5_jaccard_join": join.oracle(), "secrets_base": secrets.base_sql(), "quality_base": rules.base_sql(), "url_rules": urls.rules_sql()}
