"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.llm.shared import WORD, Scratch, fits, ranked, tables

SEED = "mix-1"
MAX_EPOCHS = 3
WEIGHTS = (1, 2, 3)
BROADCAST_SOURCES = 50_000


def source_targets(slim: DataFrame, scratch: Scratch, weights=WEIGHTS, max_epochs=MAX_EPOCHS) -> DataFrame:
    """One row for each source: key, source_size, target.

    The water level is the words that each unit of weight gets. Sources whose cap lies under it are clamped, and the
    excess raises the level for the rest, until no more are clamped. A round is one small aggregate; the driver holds
    only the level.
    """
    sizes = slim.groupBy("key").agg(F.sum("size").alias("source_size"))
    sizes = ranked(sizes, "key", "rank", scratch)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    sizes = scratch.keep(sizes.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs))), "sources")
    total = sizes.agg(F.sum("source_size")).first()[0] or 0
    level, clamped = 0.0, -1
    while True:
        under = F.col("cap") <= level * F.col("w")
        n, fixed, free = sizes.agg(F.count_if(under), F.sum(F.when(under, F.col("cap"))), F.sum(F.when(~under, F.col("w")))).first()
        if n == clamped or not free:
            break
        clamped, level = n, (total - (fixed or 0.0)) / free
    return sizes.select("key", "source_size", F.least("cap", level * F.col("w")).alias("target"))


def repetitions(rows: DataFrame, slim: DataFrame, targets: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds taken to rows: whole repetitions of every document, and one fractional repetition of its source in seeded order.

    Documents of a source stand in the order of their digest. Those before the point where the rest of the target is
    used up are repeated once more, the one at that point in part, those after it not. Digest prefixes of 2, 4 and 6
    digits narrow the point down by sums, so that no task sorts a source. Equal rows at the point share alike.
    """
    plan = targets.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = plan.withColumn("rest", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    plan = scratch.keep(plan, "plan")
    # A row a source: broadcast while there are few sources, else joined by a shuffle whose skewed parts Spark splits.
    few = fits(plan, BROADCAST_SOURCES)
    small = F.broadcast if few else lambda df: df
    point = plan.select("key", "rest", F.lit("").alias("prefix"), F.lit(0).cast("long").alias("before"))
    for digits in (2, 4, 6):
        part = slim.join(small(point), "key").where(F.substring("digest", 1, digits - 2) == F.col("prefix"))
        bins = part.groupBy("key", "rest", "before", F.substring("digest", 1, digits).alias("bin")).agg(F.sum("size").alias("n"))
        window = Window.partitionBy("key").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        upto = bins.withColumn("upto", F.col("before") + F.sum("n").over(window))
        point = upto.where(F.col("upto") > F.col("rest")).groupBy("key").agg(
            F.min(F.struct("bin", "rest", (F.col("upto") - F.col("n")).alias("before"))).alias("at"))
        point = point.select("key", F.col("at.rest").alias("rest"), F.col("at.bin").alias("prefix"), F.col("at.before").alias("before"))
        point = scratch.keep(point, f"point{digits}")
    plan = plan.join(point.drop("rest"), "key", "left").select(F.col("key").alias("_key"), "source_size", "target", "whole", "rest", "prefix", "before")
    plan = scratch.keep(plan, "point")
    # The rows at the point: one for each digest, with the words before it and how many equal rows share it.
    here = F.substring("digest", 1, 6)
    at = slim.join(small(plan), F.col("key") == F.col("_key")).where(here == F.col("prefix"))
    at = at.groupBy("key", "digest", "size", "before", "rest").agg(F.count(F.lit(1)).alias("n"))
    window = Window.partitionBy("key").orderBy("digest", "size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("rest") - F.col("before") - F.coalesce(F.sum(F.col("n") * F.col("size")).over(window), F.lit(0))
    at = at.select(F.col("key").alias("_edge_key"), F.col("digest").alias("_edge"), F.floor(F.greatest(F.lit(0), F.least(F.col("n") * F.col("size"), left)) / F.col("n")).alias("_part"))
    at = scratch.keep(at, "edge")
    few_at = F.broadcast(at) if fits(at, BROADCAST_SOURCES) else at
    joined = rows.join(small(plan), F.col("key") == F.col("_key"), "left").join(few_at, (F.col("key") == F.col("_edge_key")) & (F.col("digest") == F.col("_edge")), "left")
    past = F.col("prefix").isNull() | (here < F.col("prefix"))
    extra = F.when(here == F.col("prefix"), F.coalesce("_part", F.lit(0))).when(past, F.col("size")).otherwise(0)
    return joined.withColumn("taken", (F.col("whole") * F.col("size") + extra).cast("long")).drop("_key", "_edge_key", "_edge", "_part")


def text_size(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("long") * text.isNotNull().cast("long"), F.lit(0).cast("long"))


def mix_sources(docs: DataFrame, weights=WEIGHTS, max_epochs=MAX_EPOCHS, seed: str = SEED, texts: bool = False) -> DataFrame:
    """Mixes documents so that each source's words come to its target.

    docs needs doc_id, text and source. Returns doc_id, source, size, source_size, target, whole, taken and repeats
    (taken / size); with texts, all columns of docs and size .. repeats, which replace columns of these names. Sources in
    order of their code points, null last, weigh 1, 2, 3, repeating, and share all words; none takes more than
    max_epochs times its own.

    A null or empty text has size 0 and takes 0. A null source is a source of its own. Repeated rows are each a row of
    the result; where a fractional repetition ends among equal rows, they share what is left, rounded down. An empty
    table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    key = F.when(docs["source"].isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), docs["source"]))
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(docs["doc_id"].cast("string"), F.lit("")), F.md5(F.coalesce(docs["text"], F.lit("")))))
    added = ("size", "source_size", "target", "whole", "taken", "repeats")
    own = [c for c in docs.columns if c not in added] if texts else ["doc_id", "source"]
    named = lambda *columns: docs.select(*columns, key.alias("key"), text_size(docs["text"]).alias("size"), digest.alias("digest"))
    slim = scratch.keep(named(F.struct("doc_id", "source").alias("_row")), "slim")
    rows = named(F.struct(*(docs[c] for c in own)).alias("_row")) if texts else slim
    mixed = repetitions(rows, slim, source_targets(slim, scratch, weights, max_epochs), scratch)
    repeats = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0.0).alias("repeats")
    return mixed.select(*(F.col("_row")[c].alias(c) for c in own), *added[:-1], repeats)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(tables(sf_dir, "documents"))
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


def oracle(documents: str = "documents") -> str:
    """The closed form of the water level, and the plain running sum over each source."""
    return rf"""
WITH slim AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS digest
  FROM {documents}),
sizes AS (SELECT k, CAST(sum(size) AS BIGINT) AS source_size FROM slim GROUP BY k),
weighed AS (SELECT *, CAST((row_number() OVER (ORDER BY k) - 1) % 3 + 1 AS DOUBLE) AS w, CAST(source_size * 3 AS DOUBLE) AS cap FROM sizes),
tries AS (SELECT *, cap / w AS ratio,
    (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
levels AS (SELECT min_by(level, ratio) FILTER (WHERE level <= ratio) AS level FROM tries),
plan AS (SELECT t.k, t.source_size, least(t.cap, coalesce(l.level, 0) * t.w) AS target FROM tries t, levels l),
rests AS (SELECT *, CAST(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS BIGINT) AS whole FROM plan),
cum AS (SELECT s.doc_id, s.size, r.source_size, r.target, r.whole,
    CAST(round(r.target - r.whole * r.source_size) AS BIGINT) AS rest,
    coalesce(sum(s.size) OVER (PARTITION BY s.k ORDER BY s.digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM slim s JOIN rests r USING (k))
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target,
       CAST(whole * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM cum"""
