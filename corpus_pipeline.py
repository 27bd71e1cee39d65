"""The training-data pipeline: toxicity, near-duplicates, decontamination, personal data, token ids.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept; ``run`` writes each
result as Parquet into the shared checkpoint folder and rereads it as the next stage's documents.  A stage's result goes
when the next one is written, the last one when the driver ends.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meltfield.llm import op02_pii, op05_decontam, op07_bpe, op08_simhash, op09_toxicity
from meltfield.llm._batches import discard, written


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of severity grade 1 or more reaches one half go; the model is trained on ``labels``."""
    return op09_toxicity.reject(docs, op09_toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays: the one with the smallest id, of rows that share it the one with the smallest text hash."""
    return op08_simhash.survivors(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return op05_decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data is replaced by its kind in brackets."""
    return op02_pii.redact(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every kept text, with the digests of ids and decoded text."""
    encoded = op07_bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return encoded.select("doc_id", "n_tokens", "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("toxicity", toxicity), ("simhash_near_dedup", near_dedup), ("decontamination", decontamination), ("pii", personal_data), ("bpe", token_ids)]

#: SQL can express neither the trained models nor the merge ranks.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn, from ``documents``."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        out = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)
        docs = before = out
    return docs
