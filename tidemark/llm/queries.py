"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontam, exact_dedup, filter_audit, html_wrap, lm_score, ngram_join, packing, quality, secrets, spelling, subwords, token_counts, url_lists
from .common import ready, table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_score(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.weigh(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    pages = table(spark, sf_dir, "pages")
    judged = url_lists.judge(url_lists.sample_captures(pages), url_lists.sample_entries(pages))
    return judged.withColumns({c: judged[c].cast("string") for c in ("fetched_on", "active_since")})


def op5_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrap.main_text(table(spark, sf_dir, "pages"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents")).drop("found")


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subwords.digests(subwords.encode(table(spark, sf_dir, "documents"), decoded=True))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_exact_dedup, op2_lm_score, op3_quality_classifier, op4_url_filters, op5_html_main_text, op6_secret_scan, op7_ngram_jaccard_join, op8_best_fit_packing, op9_decontamination, op10_token_counts, op11_spelling_variants, op12_bpe_round_trip, op13_filter_audit)}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": exact_dedup.ORACLE, "op4_url_filters": url_lists.ORACLE, "op13_filter_audit": filter_audit.ORACLE}
