"""Findings against a list of accepted phrases: equal texts, runs of words, and beginnings of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.functions.text import collapse, norm


def checked(accepts: DataFrame) -> DataFrame:
    """accepts(phrase, reason) with both written; raises if an entry lacks one."""
    bad = accepts.where("coalesce(trim(phrase), '') = '' OR coalesce(trim(reason), '') = ''")
    if bad.limit(1).count():
        raise ValueError("every accepted phrase needs a phrase and a written reason")
    return accepts


def phrases(accepts: DataFrame) -> DataFrame:
    """The distinct phrases: phrase as written, and norms, its words normalised, empty ones kept."""
    raw = accepts.select(collapse(F.col("phrase")).alias("phrase")).distinct()
    words = raw.select("phrase", F.posexplode(F.split("phrase", " ")).alias("at", "word")).withColumn("norm", norm(F.col("word")))
    listed = words.groupBy("phrase").agg(F.array_sort(F.collect_list(F.struct("at", "norm"))).alias("w"))
    return listed.select("phrase", F.transform("w", lambda x: x["norm"]).alias("norms"))


def not_listed(findings: DataFrame, accepts: DataFrame, text: str) -> DataFrame:
    """Findings whose text, white space collapsed, is no accepted phrase as it stands."""
    listed = phrases(accepts).select(F.col("phrase").alias("_phrase"))
    return findings.join(listed, collapse(F.col(text)) == F.col("_phrase"), "left_anti")


def run_not_listed(findings: DataFrame, accepts: DataFrame, run: str) -> DataFrame:
    """Findings whose run (an array of normalised words) isn't exactly an accepted phrase's."""
    listed = phrases(accepts).select(F.col("norms").alias("_norms")).distinct()
    return findings.join(listed, F.col(run) == F.col("_norms"), "left_anti")


def gram_not_listed(findings: DataFrame, accepts: DataFrame, gram: str, longest: int = 6) -> DataFrame:
    """Findings of which no accepted phrase of two words or more begins the gram, nor the gram the phrase. Each different gram
    is looked up once; beginnings of two to longest words meet in equi-joins."""
    listed = phrases(accepts).select("norms").where(F.size("norms") >= 2).distinct()
    begun = lambda c: F.explode(F.transform(F.sequence(F.lit(2), F.least(F.size(c), F.lit(longest))), lambda k: F.slice(c, F.lit(1), k)))
    heads = listed.where(F.size("norms") > 2).select(begun(F.col("norms")).alias("_g")).distinct()
    grams = findings.select(F.col(gram).alias("_gram")).distinct()
    # An accepted phrase that begins the gram, or the gram as the beginning of one.
    begins = grams.where(F.size("_gram") >= 2).select("_gram", begun(F.col("_gram")).alias("_g")).join(listed.select(F.col("norms").alias("_g")), "_g", "left_semi").select("_gram")
    ruled = begins.unionByName(heads.select(F.col("_g").alias("_gram"))).distinct()
    return findings.join(ruled, F.col(gram) == F.col("_gram"), "left_anti")
