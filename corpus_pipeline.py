"""Training text from raw documents: five stages, each written before the next one reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomline.llm import decontamination, jaccard, mixing, pii, quality
from loomline.llm.shared import Scratch, tables


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.passing(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least id."""
    return jaccard.first_of_groups(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontamination.clean(docs, spark.read.parquet(tables(sf_dir, "benchmark")))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with pseudonyms for personal data, under the configured key (a stated one for demonstration where
    none is)."""
    return pii.pseudonymise(docs, pii.configured_key(spark) or pii.DEMONSTRATION_KEY, report=False)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with how often each is taken into the mix."""
    return mixing.mix_sources(docs, texts=True)


STAGES = [
    ("quality rules", quality_stage),
    ("near duplicates", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("pii pseudonyms", pii_stage),
    ("source mixing", mixing_stage),
]

#: The pseudonyms are a keyed permutation, which SQL can't state; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(tables(sf_dir, "documents"))
    for i, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"stage{i}", "snappy")
        if i:
            scratch.drop(f"stage{i - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
