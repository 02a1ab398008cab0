"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import decontamination, language_id, license_scan, merkle, near_duplicates, secret_scan, source_mix, suffix_dedup, token_output, toxicity
from graphloom.llm.common import documents


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": lambda spark, d: license_scan.query(spark, documents(spark, d)),
        "op2_secret_scan": lambda spark, d: secret_scan.query(spark, documents(spark, d)),
        "op3_language_id": lambda spark, d: language_id.query(spark, documents(spark, d)),
        "op4_token_output": lambda spark, d: token_output.query(spark, documents(spark, d)),
        "op5_source_mix": lambda spark, d: source_mix.query(spark, documents(spark, d)),
        "op6_merkle": lambda spark, d: merkle.query(spark, documents(spark, d)),
        "op7_decontamination": lambda spark, d: decontamination.query(spark, documents(spark, d), spark.read.parquet(f"{d}/benchmark.parquet")),
        "op8_toxicity": lambda spark, d: toxicity.query(spark, documents(spark, d), spark.read.parquet(f"{d}/labels.parquet")),
        "op9_suffix_dedup": lambda spark, d: suffix_dedup.query(spark, documents(spark, d)),
        "op10_near_duplicates": lambda spark, d: near_duplicates.query(spark, documents(spark, d)),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_license_scan": license_scan.oracle(),
        "op5_source_mix": source_mix.oracle(),
        "op10_near_duplicates": near_duplicates.oracle(),
    }
