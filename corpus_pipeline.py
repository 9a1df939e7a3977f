"""A training-data pipeline: language ID, near-dedup, decontamination, secret redaction, packing.

Each stage reads what its predecessor has written. Documents go only for a reason that a stage has found: a text that
language ID rejects, all but one of a group of near duplicates, an exact benchmark passage; secrets are replaced in place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glossaria.llm import decontaminate, langid, near_dedup, packing, secrets
from glossaria.llm.common import Scratch


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised (operator 3)."""
    return langid.drop_rejected(docs, langid.learn(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (operator 6)."""
    return near_dedup.drop_near_duplicates(spark, docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark (operator 2)."""
    return decontaminate.drop_contaminated(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in their texts (operator 8)."""
    return secrets.redact_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in training sequences (operator 7)."""
    return packing.pack_documents(spark, docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secret_redaction", secret_redaction), ("packing", packed)]

#: SQL cannot express language ID by a trained model; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark)
    for k, (_, stage) in enumerate(STAGES):
        new = scratch.table(stage(spark, docs, sf_dir))
        if k:
            scratch.drop(docs)
        docs = new
    return docs
