"""Range and as-of joins. Every join carries source and a time bin, so none becomes a nested loop over a source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.operators.intervals import binned

#: Which words count as inside a range [s, e): by their end, wholly, by any overlap, or by their start.
PREDICATES = {
    "end": lambda a, b, s, e: (b > s) & (b <= e),
    "inside": lambda a, b, s, e: (a >= s) & (b <= e),
    "overlap": lambda a, b, s, e: ~((b <= s) | (a >= e)),
    "start": lambda a, b, s, e: (a >= s) & (a < e),
}


def straddles(a: Column, b: Column, edge: Column, slack: int = 0) -> Column:
    return (a + slack < edge) & (edge < b - slack)


def in_ranges(words: DataFrame, ranges: DataFrame, predicate: str, size: int, how: str = "inner") -> DataFrame:
    """words (source, start_ms, end_ms, ..) by ranges (source, start_ms, end_ms, ..): inner rows also carry the range as
    r_start, r_end and its other columns; how may be left_semi or left_anti."""
    named = ranges.withColumnRenamed("source", "r_source").withColumnRenamed("start_ms", "r_start").withColumnRenamed("end_ms", "r_end")
    left = binned(words, size, "start_ms", "end_ms", "_bin") if predicate == "overlap" else words.withColumn("_bin", F.floor(F.col("end_ms" if predicate in ("end", "inside") else "start_ms") / size))
    right = binned(named, size, "r_start", "r_end", "r_bin")
    test = PREDICATES[predicate](F.col("start_ms"), F.col("end_ms"), F.col("r_start"), F.col("r_end"))
    on = (F.col("source") == F.col("r_source")) & (F.col("_bin") == F.col("r_bin")) & test
    if predicate == "overlap" and how == "inner":
        on = on & (F.floor(F.greatest("start_ms", "r_start") / size) == F.col("_bin"))
    if predicate == "overlap" and how != "inner":
        raise ValueError("overlap needs one bin for each word; use inner")
    joined = left.join(right, on, how)
    return joined.drop("_bin", "r_source", "r_bin")


def edges_in_words(ranges: DataFrame, words: DataFrame, size: int, slack: int = 0) -> DataFrame:
    """The edges of ranges that fall strictly inside a word."""
    edges = ranges.select("source", F.explode(F.array("start_ms", "end_ms")).alias("edge")).distinct().withColumn("bin", F.floor(F.col("edge") / size))
    spoken = binned(words, size, "start_ms", "end_ms")
    hit = edges.join(spoken, ["source", "bin"]).where(straddles(F.col("start_ms"), F.col("end_ms"), F.col("edge"), slack))
    return hit.drop("bin")


def asof(left: DataFrame, right: DataFrame, t: str, s: str, values: list[str], direction: str = "backward", keys: tuple[str, ...] = ("source",)) -> DataFrame:
    """For each left row the last right row at or before it (forward: the first at or after). A union and one window
    over each key: linear, with no pairs. Of right rows at the same time the one with the largest (forward: least)
    values counts. values become null where there is none."""
    payload = F.struct(F.col(s).alias("_s"), *values)
    l_rows = left.select(*keys, F.col(t).alias("_t"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.select(payload.alias("p")).schema["p"].dataType).alias("_r"))
    r_rows = right.select(*keys, F.col(s).alias("_t"), F.lit(None).cast(l_rows.schema["_l"].dataType).alias("_l"), payload.alias("_r"))
    # Forward is backward in descending order. At equal times right rows stand first, so that "at" counts; frames end at
    # the row itself, so that Spark carries the last right row along.
    side, window = F.col("_l").isNotNull(), Window.partitionBy(*keys)
    order = ["_t", side, "_r"] if direction == "backward" else [F.desc("_t"), side, F.desc("_r")]
    found = F.last("_r", ignorenulls=True).over(window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    both = l_rows.unionByName(r_rows).withColumn("_f", found).where("_l IS NOT NULL")
    return both.select("_l.*", *(F.col(f"_f.{v}").alias(v if v not in left.columns else f"r_{v}") for v in values))
