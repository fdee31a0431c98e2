"""Interval algebra over (source, start_ms, end_ms): union, complement, subtraction, intersection, remapping.

All windows are by source; intervals are half open; times are whole milliseconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, slack: int, order=("start_ms", "end_ms")) -> DataFrame:
    """Adds island, a number by source: a row joins the island before it if it starts less than slack after the
    furthest end so far. slack 0: only overlaps join; 1: touching intervals too; 600: gaps under 600 ms are bridged."""
    window = Window.partitionBy("source").orderBy(*order)
    reach = F.max("end_ms").over(window.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("start_ms") - reach >= slack), 1).otherwise(0)
    return df.withColumn("_fresh", fresh).withColumn("island", F.sum("_fresh").over(window.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_fresh")


def union(df: DataFrame, slack: int = 0, why: str | None = None) -> DataFrame:
    """Intervals joined into islands. why: "all" joins the reasons in order, "first" keeps the earliest one's."""
    grouped = islands(df, slack, ("start_ms", "end_ms", "why") if why else ("start_ms", "end_ms")).groupBy("source", "island")
    columns = [F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")]
    order = F.struct("start_ms", "end_ms", "why")
    if why == "all":
        columns.append(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["why"]), " + ").alias("why"))
    elif why == "first":
        columns.append(F.min(order)["why"].alias("why"))
    return grouped.agg(*columns).drop("island")


def complement(merged: DataFrame, spans: DataFrame, least: int = 0) -> DataFrame:
    """What merged, disjoint intervals leave of each source's span (source, lo, hi): pieces longer than least. A source
    without intervals keeps its whole span."""
    inside = merged.join(spans, "source").select("source", F.greatest("start_ms", "lo").alias("a"), F.least("end_ms", "hi").alias("b")).where("b > a")
    ends = spans.select("source", F.col("hi").alias("a"), F.col("hi").alias("b"), F.col("lo"))
    rows = inside.select("source", "a", "b", F.lit(None).cast("long").alias("lo")).unionByName(ends)
    window = Window.partitionBy("source").orderBy("a", "b")
    lo = F.max("lo").over(Window.partitionBy("source"))
    pieces = rows.select("source", F.coalesce(F.lag("b").over(window), lo).alias("start_ms"), F.col("a").alias("end_ms"))
    return pieces.where(F.col("end_ms") - F.col("start_ms") > least)


def binned(df: DataFrame, size: int, start: str, end: str, bin_: str = "bin") -> DataFrame:
    """One row for each time bin that an interval touches."""
    return df.withColumn(bin_, F.explode(F.sequence(F.floor(F.col(start) / size), F.floor(F.col(end) / size))))


def intersect(left: DataFrame, right: DataFrame, size: int, keep: list[str] | None = None) -> DataFrame:
    """The overlaps of two sets of intervals. Both sides go into bins of size ms, and a pair counts in the bin where the
    later of the two starts, so a long source is not compared all with all."""
    a = binned(left.select("source", F.col("start_ms").alias("a0"), F.col("end_ms").alias("a1"), *(keep or [])), size, "a0", "a1")
    b = binned(right.select("source", F.col("start_ms").alias("b0"), F.col("end_ms").alias("b1")), size, "b0", "b1")
    both = a.join(b, ["source", "bin"]).where((F.col("a0") < F.col("b1")) & (F.col("b0") < F.col("a1")))
    both = both.where(F.floor(F.greatest("a0", "b0") / size) == F.col("bin"))
    return both.select("source", F.greatest("a0", "b0").alias("start_ms"), F.least("a1", "b1").alias("end_ms"), *(keep or []))


def subtract(left: DataFrame, right: DataFrame, least: int, size: int) -> DataFrame:
    """left (disjoint) minus right (disjoint): pieces of at least so many ms."""
    named = left.withColumnRenamed("start_ms", "l0").withColumnRenamed("end_ms", "l1").select("source", "l0", "l1")
    cut = intersect(left.withColumn("l0", F.col("start_ms")), right, size, ["l0"])
    rows = cut.select("source", "l0", F.col("start_ms").alias("a"), F.col("end_ms").alias("b"))
    rows = rows.unionByName(named.select("source", "l0", F.col("l1").alias("a"), F.col("l1").alias("b")))
    window = Window.partitionBy("source", "l0").orderBy("a", "b")
    pieces = rows.select("source", F.coalesce(F.lag("b").over(window), F.col("l0")).alias("start_ms"), F.col("a").alias("end_ms"))
    return pieces.where(F.col("end_ms") - F.col("start_ms") >= least)


def quantised(ms: Column, fps: float) -> Column:
    """Milliseconds as whole frames, rounded up; rounding first keeps exact multiples from gaining a frame."""
    return F.ceil(F.bround(ms * F.lit(float(fps)) / 1000.0, 6)).cast("long")


def with_offsets(ranges: DataFrame, fps: float) -> DataFrame:
    """Adds seq, and where each range starts on the compacted timeline: in ms by raw and in frames by rounded lengths."""
    window = Window.partitionBy("source").orderBy("start_ms", "end_ms")
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    length = F.col("end_ms") - F.col("start_ms")
    return ranges.withColumns({
        "seq": (F.row_number().over(window) - 1).cast("long"),
        "out_ms": F.coalesce(F.sum(length).over(before), F.lit(0)).cast("long"),
        "out_frames": F.coalesce(F.sum(quantised(length, fps)).over(before), F.lit(0)).cast("long"),
    })


def middle(df: DataFrame, target: int) -> DataFrame:
    """target ms out of the middle of each source's longest interval, the first of equals."""
    longest = df.groupBy("source").agg(F.max(F.struct((F.col("end_ms") - F.col("start_ms")).alias("n"), (-F.col("start_ms")).alias("neg"))).alias("m"))
    start, n = -F.col("m.neg"), F.col("m.n")
    a = start + F.floor((n - F.least(n, F.lit(target))) / 2)
    return longest.select("source", a.alias("start_ms"), (a + F.least(n, F.lit(target))).alias("end_ms"))


def busiest(counts: DataFrame, width: int) -> DataFrame:
    """counts(source, slot, n) without gaps: the first run of width slots with the largest sum, by source."""
    window = Window.partitionBy("source").orderBy("slot")
    full = counts.withColumn("total", F.sum("n").over(window.rowsBetween(0, width - 1))).withColumn("_k", F.count("n").over(window.rowsBetween(0, width - 1)))
    best = full.where(F.col("_k") == width).groupBy("source").agg(F.max(F.struct("total", (-F.col("slot")).alias("neg"))).alias("m"))
    return best.select("source", (-F.col("m.neg")).alias("slot"), F.col("m.total").alias("total"))


def merge_refusals(ranges: DataFrame, inputs: DataFrame) -> DataFrame:
    """Why edits must not be merged, as refused and what: a source with ranges in two inputs (ranges: input, source), inputs
    without ranges, and different subtitles (inputs: input, subtitles). No row: they may."""
    shared = ranges.distinct().groupBy("source").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("ranges in two inputs").alias("refused"), F.col("source").cast("string").alias("what"))
    empty = inputs.select("input").distinct().join(ranges.select("input").distinct(), "input", "left_anti").select(F.lit("no ranges").alias("refused"), F.col("input").alias("what"))
    kinds = inputs.select("subtitles").distinct().agg(F.array_sort(F.collect_set("subtitles")).alias("s")).where(F.size("s") > 1)
    return shared.unionByName(empty).unionByName(kinds.select(F.lit("inputs disagree about subtitles").alias("refused"), F.array_join("s", ", ").alias("what")))
