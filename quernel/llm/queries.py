"""The registered queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quernel.llm import bpe, decontaminate, fixity, html_text, jaccard, language_id, line_dedup, oracles, quality, secrets, url_rules
from quernel.llm.shared import spread, table


def documents(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", *more))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(documents(spark, sf_dir, "lang"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(documents(spark, sf_dir, "lang"), table(spark, sf_dir, "labels"))


def op3_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return fixity.audit(pages, fixity.damaged(pages))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(documents(spark, sf_dir))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(documents(spark, sf_dir))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(documents(spark, sf_dir))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spread(table(spark, sf_dir, "pages").select("page_id", "url", "html")))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(documents(spark, sf_dir))


def queries() -> dict:
    return {
        f.__name__: f
        for f in (op1_language_id, op2_quality_rules, op3_warc_fixity, op4_byte_bpe, op5_secret_scan, op6_jaccard_join, op7_url_filter, op8_decontamination, op9_html_extraction, op10_line_dedup)
    }


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
