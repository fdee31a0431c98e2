"""Decisions over regularly sampled levels and block-compared pictures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.operators.intervals import union


def order(rows: tuple[int, int] | None = None) -> Window:
    w = Window.partitionBy("source").orderBy("i")
    return w.rowsBetween(*rows) if rows else w


def percentiles(frames: DataFrame) -> DataFrame:
    qs = {"p10": 0.1, "p20": 0.2, "p90": 0.9, "p95": 0.95}
    return frames.groupBy("source").agg(*(F.round(F.percentile("level", F.lit(q)), 6).alias(k) for k, q in qs.items()))


def floors(frames: DataFrame) -> DataFrame:
    """Speech floors: 20 dB under the loud level, but over the quiet one by a factor (1.8, or 10 dB)."""
    p = lambda q: F.percentile("level", F.lit(q))
    loud = p(0.9) * 10 ** (-20 / 20)
    return frames.groupBy("source").agg(F.round(F.greatest(loud, p(0.1) * 1.8), 6).alias("floor_words"), F.round(F.greatest(loud, p(0.2) * 10 ** (10 / 20)), 6).alias("floor_gaps"))


def smoothed(k_before: int, k_after: int) -> Column:
    """Centred moving average that counts missing neighbours as zero."""
    return F.sum("level").over(order((-k_before, k_after))) / (k_before + k_after + 1)


def blocks(frames: DataFrame, size: int) -> DataFrame:
    """rms and peak_db of each size frames."""
    cut = frames.withColumn("block", F.floor(F.col("i") / size))
    return cut.groupBy("source", "block").agg(F.round(F.sqrt(F.avg(F.col("level") * F.col("level"))), 6).alias("rms"),
                                              F.round(20 * F.log10(F.max(F.abs("level")) + 1e-9), 6).alias("peak_db"))


def true_runs(flagged: DataFrame, least: int) -> DataFrame:
    """Maximal runs of frames where flag holds: source, first, last, n."""
    hits = flagged.where("flag").withColumn("_g", F.col("i") - F.row_number().over(order()))
    return hits.groupBy("source", "_g").agg(F.min("i").alias("first"), F.max("i").alias("last"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).drop("_g")


def window_max(frames: DataFrame, size: int) -> DataFrame:
    """The largest sum over complete windows of size frames."""
    w = order((0, size - 1))
    full = frames.withColumns({"total": F.sum("level").over(w), "_k": F.count("level").over(w)}).where(F.col("_k") == size)
    return full.groupBy("source").agg(F.round(F.max("total"), 6).alias("total"))


def quiet(frames: DataFrame, floor: DataFrame, reach: int) -> DataFrame:
    """Adds quiet: the loudest of the frames within reach is under the source's floor."""
    return frames.withColumn("near", F.max("level").over(order((-reach, reach)))).join(floor, "source").withColumn("quiet", F.col("near") < F.col("floor"))


def nearest_quiet(at: DataFrame, quiet_frames: DataFrame, most: int) -> DataFrame:
    """at(source, i): the quiet frame nearest to i within most frames, the earlier one of two as near; i where none is."""
    steps = at.withColumn("j", F.explode(F.sequence(F.col("i") - most, F.col("i") + most)))
    q = quiet_frames.where("quiet").select("source", F.col("i").alias("j"))
    near = steps.join(q, ["source", "j"]).groupBy("source", "i").agg(F.min(F.struct(F.abs(F.col("j") - F.col("i")).alias("d"), "j")).alias("m"))
    return at.join(near, ["source", "i"], "left").select("source", "i", F.coalesce("m.j", "i").alias("moved"))


def blocks_changed(pictures: DataFrame, blocks: list[list[int]], inset: tuple[int, ...], delta: float) -> DataFrame:
    """Each picture against the one before: in how many blocks (lists of cells) the largest change is over delta, and in how
    many the mean one. Cells of the inset count as unchanged."""
    before = F.lag("vec").over(Window.partitionBy("source").orderBy("sec"))
    pair = pictures.withColumn("_b", before).where("_b IS NOT NULL").withColumn("_d", F.zip_with("vec", "_b", lambda a, b: F.abs(a.cast("double") - b.cast("double"))))
    cell = lambda k: F.lit(0.0) if k in inset else F.col("_d")[k]
    count = lambda f: sum((F.when(f(block) > delta, 1).otherwise(0) for block in blocks), F.lit(0)).cast("long")
    largest = lambda block: F.greatest(*(cell(k) for k in block))
    mean = lambda block: sum((cell(k) for k in block[1:]), cell(block[0])) / len(block)
    return pair.select("source", "sec", count(largest).alias("changed_max"), count(mean).alias("changed_mean"))


def silence_verdicts(windows: DataFrame, seconds: DataFrame, cells: int) -> DataFrame:
    """windows(source, a, b) by the seconds in (a, b]: dead air if a third of them or less are live, not sampled if there are
    none, else kept."""
    w = windows.withColumn("sec", F.explode(F.sequence(F.col("a") + 1, F.col("b")))).join(seconds.select("source", "sec", "changed_max"), ["source", "sec"], "left")
    each = w.groupBy("source", "a", "b").agg(F.count("changed_max").alias("total"), F.sum(F.when(F.col("changed_max") > cells, 1).otherwise(0)).cast("long").alias("live"))
    return each.withColumn("verdict", F.when(F.col("total") == 0, "not sampled").when(F.col("live") <= F.col("total") / 3, "dead air").otherwise("kept"))


def graded(stats: DataFrame) -> DataFrame:
    """source, contrast, gamma and saturation from y_mean, y_range and sat_mean."""
    share = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    held = lambda x, lo, hi: F.round(F.greatest(F.lit(lo), F.least(F.lit(hi), x)), 6)
    contrast = F.when(F.col("y_range") < 0.65, 1.08 - 0.05 * share((F.col("y_range") - 0.50) / 0.15)).otherwise(1.03)
    gamma = F.when(F.col("y_mean") < 0.42, 1.10 - 0.08 * share((F.col("y_mean") - 0.30) / 0.12)).when(F.col("y_mean") > 0.60, 0.97).otherwise(1.0)
    saturation = F.when(F.col("sat_mean") < 0.18, 1.04).when(F.col("sat_mean") > 0.38, 0.96).otherwise(0.98)
    return stats.select("source", held(contrast, 0.94, 1.08).alias("contrast"), held(gamma, 0.94, 1.10).alias("gamma"), saturation.alias("saturation"))


def reference_level(sound: DataFrame, ranges: DataFrame, take: int, least: int, most: int, hop: int = 20) -> DataFrame:
    """The 95th percentile in dB of up to take ms from each range of least ms and more, in order, until most ms are together."""
    before = Window.partitionBy("source").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    length = F.col("end_ms") - F.col("start_ms")
    r = ranges.where(length >= least).withColumn("take", F.least(F.lit(take), length))
    r = r.withColumn("span", F.coalesce(F.sum("take").over(before), F.lit(0))).where(F.col("span") < most)
    frames = r.select("source", F.explode(F.sequence(F.floor(F.col("start_ms") / hop), F.floor((F.col("start_ms") + F.col("take")) / hop) - 1)).alias("i"))
    heard = frames.join(sound.select("source", "i", "level"), ["source", "i"])
    return heard.groupBy("source").agg(F.count(F.lit(1)).alias("frames"), F.round(F.percentile(20 * F.log10(F.col("level") + 1e-9), F.lit(0.95)), 6).alias("reference"))


def live_share(changed: DataFrame, cells: int) -> DataFrame:
    """How many seconds have more than cells changed cells, and whether the source counts as live (over a third)."""
    live = F.sum(F.when(F.col("changed") > cells, 1).otherwise(0)).cast("long")
    return changed.groupBy("source").agg(live.alias("live"), F.count(F.lit(1)).alias("total"), (live > F.count(F.lit(1)) / 3).alias("keep"))


def measured_words(logged: DataFrame, sound: DataFrame, hop: int = 20) -> DataFrame:
    """The audible extent of words (source, idx, start_ms, end_ms): from the first to the last loud frame of sound (source,
    i, level), smoothed over three; of words over 1.5 s the longest run of them, gaps of up to 0.3 s bridged, the first of
    equals; of a silent word the last 0.1 s. Only what was padded by over 0.2 s changes. Loud: over 20 dB under the 90th
    percentile, and over 1.8 times the 10th."""
    p = lambda q: F.percentile("level", F.lit(q))
    line = sound.groupBy("source").agg(F.greatest(p(0.9) * 10 ** (-20 / 20), p(0.1) * 1.8).alias("thr"))
    smooth = sound.select("source", "i", (F.sum("level").over(order((-1, 1))) / 3).alias("smooth")).join(line, "source").where("smooth > thr").select("source", "i")
    spread = logged.withColumn("i", F.explode(F.sequence(F.floor(F.greatest(F.col("start_ms"), F.lit(0)) / hop), F.floor(F.col("end_ms") / hop))))
    loud = spread.join(smooth, ["source", "i"])
    w = Window.partitionBy("source", "idx").orderBy("i")
    runs = loud.withColumn("_f", F.when(F.col("i") - F.lag("i").over(w) <= 300 // hop, 0).otherwise(1)).withColumn("_g", F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    each = runs.groupBy("source", "idx", "_g").agg(F.min("i").alias("a"), F.max("i").alias("b"))
    of_word = each.groupBy("source", "idx").agg(F.max(F.struct((F.col("b") - F.col("a")).alias("n"), (-F.col("a")).alias("neg"), "b")).alias("m"), F.min("a").alias("a"), F.max("b").alias("b"))
    found = logged.join(of_word, ["source", "idx"], "left")
    long = F.col("end_ms") - F.col("start_ms") > 1500
    first = F.when(F.col("a").isNull(), F.greatest("start_ms", F.col("end_ms") - 100)).otherwise(F.when(long, -F.col("m.neg")).otherwise(F.col("a")) * hop)
    last = F.when(F.col("a").isNull(), F.col("end_ms")).otherwise((F.when(long, F.col("m.b")).otherwise(F.col("b")) + 1) * hop)
    found = found.withColumns({"s1": F.when(first - F.col("start_ms") > 200, first).otherwise(F.col("start_ms")), "e1": F.when(F.col("end_ms") - last > 200, last).otherwise(F.col("end_ms"))})
    ok = F.col("e1") > F.col("s1")
    return found.select("source", "idx", F.when(ok, F.col("s1")).otherwise(F.col("start_ms")).alias("start_ms"), F.when(ok, F.col("e1")).otherwise(F.col("end_ms")).alias("end_ms"))


def dead_air(sound: DataFrame, smooth: int, bridge: int, least: int, hop: int = 20) -> DataFrame:
    """Runs of frames whose centred average over smooth frames is 20 dB under the 90th percentile: source, start_ms, end_ms.
    Runs less than bridge frames apart are one, and those under least frames are left out."""
    line = sound.groupBy("source").agg((F.percentile("level", F.lit(0.9)) * 10 ** (-20 / 20)).alias("thr"))
    flagged = sound.withColumn("smooth", smoothed(smooth // 2, smooth - smooth // 2 - 1)).join(line, "source").withColumn("flag", F.col("smooth") < F.col("thr"))
    runs = true_runs(flagged, 1).select("source", F.col("first").alias("start_ms"), (F.col("last") + 1).alias("end_ms"))
    joined = union(runs, bridge)
    return joined.where(F.col("end_ms") - F.col("start_ms") >= least).select("source", (F.col("start_ms") * hop).alias("start_ms"), (F.col("end_ms") * hop).alias("end_ms"))
