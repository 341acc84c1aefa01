"""The opN queries: each operator over its whole table, and the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import debruijn, decontaminate, exact_dedup, fim, importance, licenses, mixing, oracles, quality, secrets, simhash, token_counts, url_rules, warc
from .common import table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratings = quality.grades_of(table(spark, sf_dir, "labels"))
    return quality.quality_report(table(spark, sf_dir, "documents"), ratings)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).drop("n_chunks")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"), width=4, radius=4)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.url_verdicts(table(spark, sf_dir, "pages"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents")).drop("spans")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    index = warc.capture_index(pages, date=lambda p: F.timestamp_seconds(F.lit(1_577_836_800) + p["page_id"]))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured_at")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_report(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.fim_report(table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.without_repeats(table(spark, sf_dir, "documents"), with_text=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_classifier,
        op2_exact_dedup,
        op3_simhash,
        op4_url_filter,
        op5_secret_scan,
        op6_license_scan,
        op7_warc,
        op8_decontaminate,
        op9_mix_sources,
        op10_token_counts,
        op11_fill_in_middle,
        op12_importance_resampling,
        op13_substring_dedup,
    )
}

#: The rest hash with XXH64, train, tokenise or permute, which SQL can't: tests/llm has brute force.
ORACLES: dict[str, str] = {
    "op2_exact_dedup": oracles.EXACT_DEDUP,
    "op4_url_filter": oracles.url_filter(),
    "op5_secret_scan": oracles.secret_scan(),
    "op6_license_scan": oracles.license_scan(),
    "op7_warc": oracles.WARC,
    "op8_decontaminate": oracles.DECONTAMINATE,
    "op11_fill_in_middle": oracles.FILL_IN_MIDDLE,
    "op13_substring_dedup": oracles.SUBSTRING_DEDUP,
}
