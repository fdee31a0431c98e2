"""Gaps on the timeline that is left: which are too long, and what to cut out of them.

Everything is in whole milliseconds; frames are 20 ms; ranges are (source, seq, start_ms, end_ms) in delivery order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.operators import edges, intervals, joins
from loomline.operators.edges import HOP

#: Fixed values of gap tightening, in ms: gaps from which one is short or long, what is kept of each, what stays beside a
#: word, and the least cut.
SHORT, SHORT_KEEP, LONG, LONG_KEEP, EDGE, LEAST = 750, 400, 4000, 1200, 60, 200
#: Speech is held where 0.20 s of any 0.50 s are at speech level; a removed word rings for 0.80 s, a kept one for 0.10 s.
WINDOW, DENSE, RING, TAIL = 25, 10, 800, 100
BIN = 4000


def quantised_ms(ms: Column, fps: int) -> Column:
    """Whole frames in ms; fps must divide 1000."""
    return intervals.quantised(ms, fps) * (1000 // fps)


def delivered(words: DataFrame, ranges: DataFrame, fps: int = 25) -> DataFrame:
    """Words that lie in a range as a whole, with out_start and out_end on the delivered timeline."""
    before = Window.partitionBy("source").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranges.withColumn("out_ms", F.coalesce(F.sum(quantised_ms(F.col("end_ms") - F.col("start_ms"), fps)).over(before), F.lit(0)))
    kept = joins.in_ranges(words, placed.select("source", "start_ms", "end_ms", "out_ms"), "inside", BIN)
    shift = F.col("out_ms") - F.col("r_start")
    return kept.withColumns({"out_start": F.col("start_ms") + shift, "out_end": F.col("end_ms") + shift})


def wordless(words: DataFrame, ranges: DataFrame, ceiling: int = 2500, fps: int = 25) -> DataFrame:
    """Delivered gaps over the ceiling, the lead-in and the tail among them: source, at_ms, gap_ms, before, after, and the
    source times sa and sb of the words on both sides (null at the ends)."""
    total = ranges.groupBy("source").agg(F.sum(quantised_ms(F.col("end_ms") - F.col("start_ms"), fps)).alias("clock"))
    by = Window.partitionBy("source").orderBy("out_start", "out_end")
    k = delivered(words, ranges, fps)
    here = k.select("source", F.coalesce(F.lag("out_end").over(by), F.lit(0)).alias("at_ms"), F.col("out_start").alias("to_ms"), F.coalesce(F.lag("text").over(by), F.lit("(start)")).alias("before"),
                    F.col("text").alias("after"), F.lag("end_ms").over(by).alias("sa"), F.col("start_ms").alias("sb"), F.lead("text").over(by).isNull().alias("last"), "out_end", "end_ms")
    tail = here.where("last").join(total, "source").select("source", F.col("out_end").alias("at_ms"), F.col("clock").alias("to_ms"), F.col("after").alias("before"), F.lit("(end)").alias("after"),
                                                           F.col("end_ms").alias("sa"), F.lit(None).cast("long").alias("sb"))
    every = here.drop("last", "out_end", "end_ms").unionByName(tail).withColumn("gap_ms", F.col("to_ms") - F.col("at_ms"))
    return every.where(F.col("gap_ms") > ceiling).drop("to_ms")


def gap_cuts(gaps: DataFrame, ceiling: int = 2500) -> DataFrame:
    """Head and tail cuts around what stays of each gap between two words that is over the ceiling at the source too: the
    middle max(0.8 s, ceiling - 0.42 s); 100 ms stay beside the words, and cuts of 100 ms and less are left out."""
    target = max(800, ceiling - 420)
    keep = F.floor((F.col("sa") + F.col("sb") - target) / 2)
    parts = F.array(F.struct(F.lit("head").alias("part"), (F.col("sa") + 100).alias("start_ms"), keep.alias("end_ms")),
                    F.struct(F.lit("tail").alias("part"), (keep + target).alias("start_ms"), (F.col("sb") - 100).alias("end_ms")))
    cut = gaps.where(F.col("sb") - F.col("sa") > ceiling).select("source", "gap_ms", F.explode(parts).alias("p")).select("source", "gap_ms", "p.*")
    return cut.where("end_ms - start_ms > 100")


def covered_frames(words: DataFrame, kept: DataFrame) -> DataFrame:
    """Frames (source, i) that a word accounts for: from 100 ms before it to 100 ms behind a kept word's end, or 800 ms
    behind a removed one's. kept: (source, idx)."""
    flagged = words.join(kept.select("source", "idx", F.lit(True).alias("_kept")), ["source", "idx"], "left")
    tail = F.when(F.col("_kept"), TAIL).otherwise(RING)
    first = F.floor(F.greatest(F.col("start_ms") - 100, F.lit(0)) / HOP)
    last = F.floor((F.greatest("end_ms", F.coalesce("logged_end", "end_ms")) + tail) / HOP)
    return flagged.select("source", F.explode(F.sequence(first, last)).alias("i")).distinct()


def speech_floor(sound: DataFrame) -> DataFrame:
    """source, floor: the louder of 20 dB under the 90th percentile and 10 dB over the 20th."""
    p = lambda q: F.percentile("level", F.lit(q))
    return sound.groupBy("source").agg(F.greatest(p(0.9) * 10 ** (-20 / 20), p(0.2) * 10 ** (10 / 20)).alias("floor"))


def holding_speech(pieces: DataFrame, sound: DataFrame, covered: DataFrame, floor: DataFrame) -> DataFrame:
    """source, id of pieces (source, id, lo, hi) with 0.20 s at speech level, 6 dB over the floor, in any half second,
    counting only frames that no word accounts for."""
    order = Window.partitionBy("source").orderBy("i")
    free = covered.select("source", "i", F.lit(True).alias("_covered"))
    loud = sound.join(floor, "source").join(free, ["source", "i"], "left")
    loud = loud.select("source", "i", F.when((F.col("level") > F.col("floor") * 10 ** (6 / 20)) & F.col("_covered").isNull(), 1).otherwise(0).alias("loud"))
    loud = loud.withColumn("dense", F.sum("loud").over(order.rowsBetween(0, WINDOW - 1)))
    p = pieces.withColumns({"i0": F.floor(F.col("lo") / HOP), "i1": F.floor(F.col("hi") / HOP)}).where("i1 > i0")
    heard = p.select("source", "id", "i0", "i1", F.explode(F.sequence("i0", F.col("i1") - 1)).alias("i")).join(loud, ["source", "i"])
    most = F.when(F.first("i1") - F.first("i0") <= WINDOW, F.sum("loud")).otherwise(F.max(F.when(F.col("i") <= F.col("i1") - WINDOW, F.col("dense"))))
    return heard.groupBy("source", "id").agg(most.alias("most")).where(F.col("most") >= DENSE).select("source", "id")


def tightened(words: DataFrame, ranges: DataFrame, sound: DataFrame, protect: DataFrame, moves: DataFrame) -> DataFrame:
    """What to cut out of the gaps between kept words: source, gap_start, start_ms, end_ms, delivered_ms, kind (short or
    wait) and verdict (cut; dropped: no quiet edge; held: speech that no word accounts for).

    A gap is measured across joins, as the sum of the kept pieces between two kept words. It keeps 400 ms from the middle
    of its largest piece, or 1.2 s from the busiest second on if it is a wait (moves: source, sec, n). Edges stay 60 ms off
    words and go to the nearest quiet frame. Gaps that meet protect (source, start_ms, end_ms) are left alone."""
    kept = joins.in_ranges(words, ranges.select("source", "start_ms", "end_ms"), "inside", BIN).select("source", "idx", "start_ms", "end_ms")
    by = Window.partitionBy("source").orderBy("start_ms", "end_ms")
    gaps = kept.select("source", F.col("end_ms").alias("a"), F.lead("start_ms").over(by).alias("b")).where("b - a > 1")
    met = gaps.select("source", F.col("a").alias("start_ms"), F.col("b").alias("end_ms"), "a", "b")
    pieces = intervals.intersect(met, ranges, BIN, ["a", "b"]).where("end_ms - start_ms > 1")
    of_gap = Window.partitionBy("source", "a")
    size = F.col("end_ms") - F.col("start_ms")
    pieces = pieces.withColumns({"delivered_ms": F.sum(size).over(of_gap), "big": F.max(F.struct(size.alias("n"), (-F.col("start_ms")).alias("neg"))).over(of_gap)})
    pieces = pieces.where(F.col("delivered_ms") >= SHORT).withColumns({"g0": -F.col("big.neg"), "g1": F.col("big.n") - F.col("big.neg")}).drop("big")
    guarded = intervals.intersect(pieces.select("source", F.col("a").alias("start_ms"), F.col("b").alias("end_ms"), "a").distinct(), protect, BIN, ["a"]).select("source", "a").distinct()
    pieces = pieces.join(guarded, ["source", "a"], "left_anti")
    # The busiest second of each wait's largest piece, the first of equals.
    waits = pieces.where((F.col("delivered_ms") >= LONG) & (F.col("g1") - F.col("g0") > LONG_KEEP)).select("source", "a", "g0", "g1").distinct()
    seconds = F.greatest(F.lit(1).cast("long"), F.bround((F.col("g1") - F.col("g0")) / 1000).cast("long"))
    tried = waits.withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), seconds - 1))).withColumn("sec", F.floor((F.col("g0") + F.col("s") * 1000) / 1000))
    tried = tried.join(moves, ["source", "sec"], "left").groupBy("source", "a").agg(F.max(F.struct(F.coalesce("n", F.lit(0)).alias("n"), (-F.col("s")).alias("neg"))).alias("m"))
    pieces = pieces.join(tried.select("source", "a", (-F.col("m.neg")).alias("s")), ["source", "a"], "left")
    wait = F.col("delivered_ms") >= LONG
    k0 = F.when(wait, F.col("g0") + F.coalesce(F.col("s"), F.lit(0)) * 1000).otherwise(F.greatest(F.col("g0"), F.floor((F.col("g0") + F.col("g1") - SHORT_KEEP) / 2)))
    pieces = pieces.withColumn("k0", k0).withColumn("k1", F.least("g1", F.col("k0") + F.when(wait, LONG_KEEP).otherwise(SHORT_KEEP)))
    apart = ~((F.col("start_ms") < F.col("k1")) & (F.col("k0") < F.col("end_ms")))
    part = lambda lo, hi, when: F.when(when, F.struct(lo.alias("lo"), hi.alias("hi")))
    sides = F.array(part(F.col("start_ms"), F.col("end_ms"), apart), part(F.col("start_ms"), F.least("end_ms", "k0"), ~apart & (F.col("start_ms") < F.col("k0"))),
                    part(F.greatest("start_ms", "k1"), F.col("end_ms"), ~apart & (F.col("end_ms") > F.col("k1"))))
    left = pieces.select("source", "a", "b", "delivered_ms", F.explode(F.array_compact(sides)).alias("p")).select("source", "a", "b", "delivered_ms", "p.*")
    left = left.withColumns({"lo": F.when(F.col("lo") == F.col("a"), F.col("lo") + EDGE).otherwise(F.col("lo")), "hi": F.when(F.col("hi") == F.col("b"), F.col("hi") - EDGE).otherwise(F.col("hi"))})
    left = left.where(F.col("hi") - F.col("lo") >= LEAST).withColumn("id", F.col("lo"))
    floor = speech_floor(sound)
    near = Window.partitionBy("source").orderBy("i").rowsBetween(-3, 3)
    quiet = sound.withColumn("near", F.max("level").over(near)).join(floor, "source").where(F.col("near") < F.col("floor") * 10 ** (-6 / 20)).select("source", "i")
    most = F.floor((F.col("hi") - F.col("lo")) / HOP)
    moved = [edges.nearest_quiet_ms(left.select("source", "id", F.col(c).alias("t"), F.col("a").alias("lo"), F.col("b").alias("hi")), quiet, most).select("source", "id", F.col("moved").alias(f"n{c}")) for c in ("lo", "hi")]
    placed = left.join(moved[0], ["source", "id"]).join(moved[1], ["source", "id"])
    good = (F.col("nhi") - F.col("nlo") >= LEAST) & F.col("nlo").isNotNull() & F.col("nhi").isNotNull()
    held = holding_speech(placed.where(good).select("source", "id", F.col("nlo").alias("lo"), F.col("nhi").alias("hi")), sound, covered_frames(words, kept), floor).withColumn("_held", F.lit(True))
    verdict = F.when(~F.coalesce(good, F.lit(False)), "dropped").when(F.col("_held"), "held").otherwise("cut")
    done = placed.join(held, ["source", "id"], "left").withColumn("verdict", verdict)
    chosen = lambda n, c: F.when(F.col("verdict") == "dropped", F.col(c)).otherwise(F.col(n))
    return done.select("source", F.col("a").alias("gap_start"), chosen("nlo", "lo").alias("start_ms"), chosen("nhi", "hi").alias("end_ms"), "delivered_ms",
                       F.when(F.col("delivered_ms") >= LONG, "wait").otherwise("short").alias("kind"), "verdict")


def pause_cuts(pieces: DataFrame, speech_cuts: DataFrame) -> DataFrame:
    """The pieces to cut without what speech cuts (disjoint) declare already, joined where they touch within 1 ms; the first
    one's kind counts."""
    cut = pieces.where("verdict = 'cut'")
    rest = intervals.subtract(cut.select("source", "start_ms", "end_ms"), speech_cuts, LEAST, BIN)
    named = joins.asof(rest.withColumn("_t", F.col("start_ms")), cut.select("source", F.col("start_ms").alias("s0"), F.col("kind").alias("why")), "_t", "s0", ["why"])
    return intervals.union(named.select("source", "start_ms", "end_ms", "why"), 2, "first")


def wait_beats(ranges: DataFrame, waits: DataFrame, slack: int = 20) -> DataFrame:
    """Kept ranges between two wait cuts, each edge within slack of one: source, seq, the middle, and looks at the ranges
    before (300 ms ahead of its end) and after (300 ms into it)."""
    by = Window.partitionBy("source").orderBy("seq")
    r = ranges.select("source", "seq", "start_ms", "end_ms", F.lag("end_ms").over(by).alias("pe"), F.lead("start_ms").over(by).alias("ns"))
    near = lambda at, edge: waits.select("source", F.explode(F.sequence(F.col(edge) - slack + 1, F.col(edge) + slack - 1)).alias(at)).distinct()
    between = r.join(near("start_ms", "end_ms"), ["source", "start_ms"], "left_semi").join(near("end_ms", "start_ms"), ["source", "end_ms"], "left_semi")
    return between.select("source", "seq", F.coalesce(F.col("pe") - 300, "start_ms").alias("prev_ms"), F.floor((F.col("start_ms") + F.col("end_ms")) / 2).alias("mid_ms"), F.coalesce(F.col("ns") + 300, "end_ms").alias("next_ms"))


def delivered_silence(sound: DataFrame, ranges: DataFrame, line: float, least: int = 2000, ceiling: int = 2500) -> DataFrame:
    """Runs of frames at or under the line on the assembled signal, of least ms and more: source, out_ms, length_ms, from_ms
    and to_ms at the source, one_range (the run lies inside one range) and over (150 ms over the ceiling)."""
    before = Window.partitionBy("source").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    r = ranges.withColumns({"i0": F.floor(F.col("start_ms") / HOP), "i1": F.floor(F.col("end_ms") / HOP)})
    r = r.withColumn("o0", F.coalesce(F.sum(F.col("i1") - F.col("i0")).over(before), F.lit(0)))
    frames = r.select("source", "seq", "i0", "i1", "o0", F.explode(F.sequence("i0", F.col("i1") - 1)).alias("i")).where("i1 > i0").join(sound.select("source", "i", "level"), ["source", "i"])
    quiet = frames.where(F.col("level") <= line).withColumn("o", F.col("o0") + F.col("i") - F.col("i0"))
    runs = quiet.withColumn("_g", F.col("o") - F.row_number().over(Window.partitionBy("source").orderBy("o"))).groupBy("source", "_g")
    found = runs.agg(F.min("o").alias("o"), F.count(F.lit(1)).alias("n"), F.min_by("i", "o").alias("first"), F.max_by("i", "o").alias("last"), (F.min("seq") == F.max("seq")).alias("one_range"))
    found = found.where(F.col("n") * HOP >= least)
    return found.select("source", (F.col("o") * HOP).alias("out_ms"), (F.col("n") * HOP).alias("length_ms"), (F.col("first") * HOP).alias("from_ms"), ((F.col("last") + 1) * HOP).alias("to_ms"),
                        "one_range", (F.col("n") * HOP > ceiling + 150).alias("over"))


def excess_cuts(windows: DataFrame, ranges: DataFrame, words: DataFrame, margin: int = 250, guard: int = 40) -> DataFrame:
    """What to cut out of delivered windows (source, out_ms, length_ms, bar_ms) that are more than 100 ms over their bar, so
    that they come margin ms under it: the head of the longest span without a word (the first of equals), or all of it if
    it is no more than 100 ms longer. verdict: cut, partial (over 100 ms short) or not cut (no span, or under 80 ms)."""
    before = Window.partitionBy("source").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    length = F.col("end_ms") - F.col("start_ms")
    marks = ranges.withColumn("o0", F.coalesce(F.sum(length).over(before), F.lit(0)))
    over = windows.where("length_ms > bar_ms + 100").withColumn("excess", F.col("length_ms") - F.col("bar_ms") + margin)
    laid = marks.select("source", F.col("o0").alias("start_ms"), (F.col("o0") + length).alias("end_ms"), (F.col("start_ms") - F.col("o0")).alias("shift"))
    met = intervals.intersect(laid, over.select("source", F.col("out_ms").alias("start_ms"), (F.col("out_ms") + F.col("length_ms")).alias("end_ms")), BIN, ["shift"])
    spans = met.select("source", F.col("start_ms").alias("o"), (F.col("start_ms") + F.col("shift")).alias("start_ms"), (F.col("end_ms") + F.col("shift")).alias("end_ms"))
    padded = intervals.union(words.select("source", (F.col("start_ms") - guard).alias("start_ms"), (F.col("end_ms") + guard).alias("end_ms")))
    free = intervals.subtract(spans, padded, 1, BIN)
    # Back to the window by the source time: a span's delivered time is that of the spans table.
    free = joins.asof(free.withColumn("_t", F.col("start_ms")), spans.select("source", F.col("start_ms").alias("s0"), "o"), "_t", "s0", ["s0", "o"])
    free = free.withColumn("_o", F.col("o") + F.col("start_ms") - F.col("s0"))
    owned = joins.asof(free.select("source", "start_ms", "end_ms", "_o"), over.select("source", F.col("out_ms").alias("w0"), "out_ms"), "_o", "w0", ["out_ms"])
    n = F.col("end_ms") - F.col("start_ms")
    best = owned.groupBy("source", "out_ms").agg(F.max(F.struct(n.alias("n"), (-F.col("_o")).alias("neg"), "start_ms", "end_ms")).alias("m"))
    done = over.join(best, ["source", "out_ms"], "left")
    cut = F.when(F.col("m.n") <= F.col("excess") + 100, F.col("m.n")).otherwise(F.col("excess"))
    done = done.withColumn("cut_ms", cut)
    verdict = F.when(F.coalesce(F.col("cut_ms") < 80, F.lit(True)), "not cut").when(F.col("cut_ms") < F.col("excess") - 100, "partial").otherwise("cut")
    return done.select("source", "out_ms", "length_ms", "bar_ms", verdict.alias("verdict"), F.when(verdict != "not cut", F.col("m.start_ms")).alias("start_ms"), F.when(verdict != "not cut", F.col("m.start_ms") + F.col("cut_ms")).alias("end_ms"))
