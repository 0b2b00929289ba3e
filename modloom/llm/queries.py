"""The registered queries of this folder and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from modloom.llm import (
    covertree,
    credentials,
    extraction,
    fim,
    language,
    lexicon,
    licenses,
    mixing,
    packing,
    postings,
    simhash,
    toxicity,
    whitening,
)
from modloom.llm.tables import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.license_report(read(spark, folder, "documents"))


def op2_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_report(read(spark, folder, "documents"))


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity_report(read(spark, folder, "documents"), read(spark, folder, "labels"))


def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language.language_report(read(spark, folder, "pages"), read(spark, folder, "documents"))


def op5_cover_tree_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return covertree.near_duplicates(read(spark, folder, "embeddings"))


def op6_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(read(spark, folder, "documents"))


def op7_posting_lists(spark: SparkSession, folder: str) -> DataFrame:
    return postings.search(read(spark, folder, "embeddings"))


def op8_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicate_report(read(spark, folder, "documents"))


def op9_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return extraction.extraction_report(read(spark, folder, "pages"))


def op10_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return credentials.secret_report(read(spark, folder, "documents"))


def op11_qdwh_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitening_report(read(spark, folder, "embeddings"))


def op12_bpe_lexicon(spark: SparkSession, folder: str) -> DataFrame:
    return lexicon.encoding_report(read(spark, folder, "documents"))


def op13_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    return fim.middle_report(read(spark, folder, "documents"))


def queries() -> dict[str, Query]:
    return {
        name: value
        for name, value in globals().items()
        if name.startswith("op") and name[2].isdigit()
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_license_scan": licenses.oracle(),
        "op2_source_mix": mixing.ORACLE,
        "op5_cover_tree_dedup": covertree.ORACLE,
        "op10_secret_scan": credentials.oracle(),
        "op13_fill_in_middle": fim.ORACLE,
    }
