"""The training-data pipeline: language ID, exact dedup, near-dedup, mixing, tokenising, each stage over what the one before kept.

`STAGES` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's docs. All stages but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meltframe.llm import stages
from meltframe.session import shared_path

STAGES = [
    ("language_id", stages.language_id),
    ("exact_dedup", stages.exact_dedup),
    ("minhash_near_dedup", stages.near_dedup),
    ("source_mixing", stages.source_mixing),
    ("sentencepiece", stages.sentencepiece),
]

# The first and the last stage cannot be written in SQL; tests hold the whole against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; every stage's table lies in the shared checkpoint folder, so a lost executor costs one stage's tasks."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline/{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
