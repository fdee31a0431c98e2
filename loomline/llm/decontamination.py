"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Built-in functions only. A test item's sketch is its k least shingle hashes. k depends on the item's size band: a text
that holds at least the given share of the item's n shingles lacks at most n - ceil(share * n) of them, so one of the
k = n - ceil(share * n) + 1 least hashes, taken at the band's largest n, must be among the text's hashes, however long
the text is. So the search misses nothing; what it finds too much, the exact comparison drops.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.shared import Scratch, ascii_lower, fits, tables, words

SPAN = 5
SHARE_PERCENT = 80
#: Size bands: powers of this ratio.
BAND = 1.5
#: Up to so many rows (some 20 bytes each) are broadcast; beyond it the same join goes by a shuffle.
BROADCAST_ROWS = 500_000


def shingles(text: Column, span: int = SPAN) -> Column:
    """The distinct runs of span lower-cased words; none for a shorter text."""
    runs = lambda ws: F.transform(F.sequence(F.lit(1), F.size(ws) - (span - 1)), lambda i: F.array_join(F.slice(ws, i, span), " "))
    ws = words(ascii_lower(text))
    return F.transform(F.array(ws), lambda w: F.when(F.size(w) >= span, F.array_distinct(runs(w))).otherwise(F.array().cast("array<string>")))[0]


def hashes(text: Column, span: int = SPAN) -> Column:
    """64-bit hashes of the same runs, without building them as strings."""
    runs = lambda ws: F.transform(F.sequence(F.lit(0), F.size(ws) - span), lambda i: F.xxhash64(*(F.get(ws, i + k) for k in range(span))))
    ws = words(ascii_lower(text))
    return F.transform(F.array(ws), lambda w: F.when(F.size(w) >= span, F.array_distinct(runs(w))).otherwise(F.array().cast("array<bigint>")))[0]


def sketches(items: DataFrame, percent: int = SHARE_PERCENT) -> DataFrame:
    """item, n, hash: each item's k least hashes, k by its size band."""
    sized = items.withColumn("n", F.size("hashes")).where("n > 0")
    band = F.floor(F.log("n") / F.log(F.lit(BAND)) + 1e-9)
    largest = F.greatest(F.col("n"), F.floor(F.pow(F.lit(BAND), band + 1)))
    k = (largest - F.ceil(largest * percent / 100) + 1).cast("int")
    return sized.select("item_id", "n", F.explode(F.slice(F.array_sort("hashes"), F.lit(1), k)).alias("hash"))


def small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if fits(df, BROADCAST_ROWS) else df


def row_key(docs: DataFrame) -> Column:
    """A row is known by its id and its text's digest, so that any scan finds it again."""
    return F.struct(docs["doc_id"].alias("id"), F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("h"))


def matches(docs: DataFrame, items: DataFrame, percent: int = SHARE_PERCENT) -> DataFrame:
    """row, item_id (both structs of id and text digest), n_item, n_shared for every text that holds an item."""
    scratch = Scratch(docs.sparkSession, "leaks")
    base = items.select(F.struct(items["item_id"].alias("id"), F.xxhash64(items["text"]).alias("h")).alias("item_id"), F.coalesce(items["text"], F.lit("")).alias("text")).distinct()
    sketch = scratch.keep(sketches(base.withColumn("hashes", hashes(F.col("text"))), percent), "sketch")
    grams = scratch.keep(base.select("item_id", F.explode(shingles(F.col("text"))).alias("gram")), "grams")
    named = docs.select(row_key(docs).alias("row"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    probes = named.select("row", F.explode(hashes(F.col("text"))).alias("hash"))
    found = probes.join(small(sketch), "hash").groupBy("row").agg(F.collect_set("item_id").alias("items"))
    found = scratch.keep(found, "candidates")
    holding = named.join(small(found.select("row")), "row", "left_semi").dropDuplicates(["row"])
    held = holding.select("row", F.explode(shingles(F.col("text"))).alias("gram"))
    shared = held.join(small(grams), "gram").groupBy("row", "item_id").agg(F.count(F.lit(1)).alias("n_shared"))
    pairs = found.select("row", F.explode("items").alias("item_id")).join(shared, ["row", "item_id"])
    sizes = sketch.groupBy("item_id").agg(F.first("n").cast("long").alias("n_item"))
    return pairs.join(small(sizes), "item_id").where(F.col("n_shared") * 100 >= F.col("n_item") * percent)


def search(docs: DataFrame, items: DataFrame, percent: int = SHARE_PERCENT) -> DataFrame:
    """doc_id, item_id, n_item, n_shared: documents that hold at least that share of an item's distinct shingles.

    docs needs doc_id and text, items item_id and text. Case of A-Z doesn't count. Items of fewer than five words have
    no shingle and are found nowhere; null and empty texts hold none. Pairs are a set: repeated rows give one pair, and
    for an id with several texts the largest n_shared counts. Null ids are ids like any other. Of an item id with
    several texts each text is an item. Empty tables give an empty result.
    """
    pairs = matches(docs, items, percent)
    best = pairs.groupBy(F.col("row.id").alias("doc_id"), F.col("item_id.id").alias("item_id")).agg(F.max(F.struct("n_shared", "n_item")).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.n_item").alias("n_item"), F.col("b.n_shared").alias("n_shared"))


def clean(docs: DataFrame, items: DataFrame, percent: int = SHARE_PERCENT) -> DataFrame:
    """The rows of docs whose text holds no item, with all their columns."""
    scratch = Scratch(docs.sparkSession, "clean")
    leaked = scratch.keep(matches(docs, items, percent).select(F.col("row").alias("_leaked")).distinct(), "leaked")
    packed = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_row"), row_key(docs).alias("_key"))
    return packed.join(small(leaked), F.col("_key") == F.col("_leaked"), "left_anti").select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(tables(sf_dir, "documents")), spark.read.parquet(tables(sf_dir, "benchmark")))


def oracle(documents: str = "documents") -> str:
    grams = lambda table, key: rf"""  -- distinct runs of five words
  SELECT DISTINCT k, array_to_string(ws[i:i+{SPAN - 1}], ' ') AS g FROM (
    SELECT k, ws, unnest(range(1, len(ws) - {SPAN - 2})) AS i FROM (
      SELECT {key} AS k, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM {table}))"""  # noqa: E731
    return f"""
WITH d AS ({grams(documents, 'doc_id')}), b AS ({grams('benchmark', 'item_id')}),
sizes AS (SELECT k, count(*) AS n FROM b GROUP BY k)
SELECT d.k AS doc_id, b.k AS item_id, any_value(s.n) AS n_item, count(*) AS n_shared
FROM d JOIN b USING (g) JOIN sizes s ON s.k = b.k GROUP BY d.k, b.k HAVING 100 * count(*) >= {SHARE_PERCENT} * any_value(s.n)"""
