"""The pipeline's stages: each applies one operator to the documents the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meltframe.llm import exact_dedup as exact
from meltframe.llm import language, mixing, near_dedup as near, sentencepieces
from meltframe.llm.queries import tokenizer
from meltframe.session import tune


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a learned language explains, with the language filled in where it was null; all others go."""
    tune(spark)
    return language.keep_known(docs, language.training_sample(docs, F.lit(True)))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    tune(spark)
    return exact.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8."""
    tune(spark)
    return near.drop_near_copies(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them."""
    tune(spark)
    return mixing.apply_mix(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document's ids and decoded text."""
    tune(spark)
    return sentencepieces.digests(docs, tokenizer("piece_bpe_32k.model"))
