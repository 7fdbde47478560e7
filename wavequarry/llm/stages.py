"""The stages of the corpus pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, dedup, mixing, quality, tokenfile
from .catalog import tokenizer_path
from .common import prepared, table


@prepared
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject. It learns from all labelled positives and the documents themselves."""
    return quality.keep_quality(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


@prepared
def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: shingles of five words, similarity of 0.8 or more."""
    return dedup.drop_near_duplicates(docs)


@prepared
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


@prepared
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


@prepared
def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back: one row a document taken."""
    return tokenfile.token_table(docs, tokenizer=tokenizer_path("word_bpe_49k.json"))
