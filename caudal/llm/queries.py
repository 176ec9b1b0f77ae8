"""Registered queries of the package and their SQL.

Each ``opN_<name>`` applies one operator, with production parameters, to the
whole of its table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from caudal.llm import (alignment, decontaminate, exact_dedup, lm, packing, quality, secrets, simhash, spelling,
                        suffix_dedup, token_output, url_lists, warc)

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("hash")


def op4_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_lists.judged_pages(spark, table(spark, sf_dir, "pages"))


def op5_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), order=lm.ORDER)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op10_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.written_segments(table(spark, sf_dir, "documents"))


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.digest(alignment.align(table(spark, sf_dir, "documents")))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (
        op1_secret_scan, op2_simhash_near_dedup, op3_benchmark_decontamination, op4_url_lists, op5_warc_round_trip,
        op6_quality_rules, op7_lm_scoring, op8_best_fit_packing, op9_suffix_array_dedup, op10_token_id_output,
        op11_cross_tokenizer_alignment, op12_exact_dedup, op13_spelling_variants)}


def oracle_sql() -> dict[str, str]:
    return {"op4_url_lists": url_lists.ORACLE, "op5_warc_round_trip": warc.ORACLE, "op6_quality_rules": quality.ORACLE,
            "op12_exact_dedup": exact_dedup.ORACLE}
