"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from meltfield.llm import op01_langid, op02_pii, op03_substring, op04_quality, op05_decontam, op06_tokens, op07_bpe, op08_simhash, op09_toxicity, op10_html


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return op01_langid.digest(op01_langid.predict(docs, op01_langid.fit(docs)))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op02_pii.digest(op02_pii.detect(table(spark, sf_dir, "documents")))


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op03_substring.digest(op03_substring.dedup(table(spark, sf_dir, "documents")))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return op04_quality.digest(op04_quality.assess(docs, op04_quality.fit(docs, table(spark, sf_dir, "labels"))))


def quality_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of ``op4_quality`` that SQL can express."""
    return op04_quality.base(op04_quality.assess(table(spark, sf_dir, "documents"), None))


def pii_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of ``op2_pii`` that SQL can express."""
    return op02_pii.base_counts(op02_pii.detect(table(spark, sf_dir, "documents")))


def op5_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op05_decontam.digest(op05_decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op06_tokens.digest(op06_tokens.read(op06_tokens.write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op07_bpe.digest(op07_bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op08_simhash.digest(op08_simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return op09_toxicity.grade(docs, op09_toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_html.digest(op10_html.extract(table(spark, sf_dir, "pages")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_langid, op2_pii, op3_substring, op4_quality, op5_decontam, op6_tokens, op7_bpe, op8_simhash, op9_toxicity, op10_main_text, quality_statistics, pii_base_counts)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_substring": op03_substring.ORACLE_SQL, "op5_decontam": op05_decontam.ORACLE_SQL, "quality_statistics": op04_quality.BASE_SQL, "pii_base_counts": op02_pii.COUNTS_SQL}
