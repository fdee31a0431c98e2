"""Steps put together: from authored cuts to an edit that may be written, and checks of what was built from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.operators import edges as ed
from loomline.operators import intervals as iv
from loomline.operators import joins
from loomline.operators import pauses as pz
from loomline.operators.gates import GateError, publish
from loomline.plans.editing import placed_cuts
from loomline.plans.registry import query
from loomline.sources import fixtures as fx
from loomline.sources.files import edit_document
from loomline.sources.fixtures import KEPT_SQL, SOUND_SQL
from loomline.sources.store import kept


def untightened(cuts: DataFrame) -> DataFrame:
    """Cuts (.., why) that hold no pause cuts yet: tightening a timeline that has them would find nothing to cut."""
    if cuts.where("why IN ('short', 'wait')").limit(1).count():
        raise GateError("the cuts hold pause cuts already; start from the speech cuts")
    return cuts


def rebuild(speech: DataFrame, words: DataFrame, sound: DataFrame, spans: DataFrame, protect: DataFrame, moves: DataFrame) -> DataFrame:
    """Ranges in two stages: those that speech cuts (source, na, nb, why) leave; the gaps on them tightened; those that both
    kinds of cuts leave. There is no third stage, and none reads its own result; what a stage gives is
    written, and the next one's plan starts from that."""
    first = kept(ed.ranges_of(untightened(speech), words, spans), "ranges")
    pieces = kept(pz.tightened(words, first, sound, protect, moves), "pieces")
    merged = iv.union(speech.where("nb > na").select("source", F.col("na").alias("start_ms"), F.col("nb").alias("end_ms")))
    pauses = pz.pause_cuts(pieces, merged).select("source", F.col("start_ms").alias("na"), F.col("end_ms").alias("nb"), "why")
    return ed.ranges_of(speech.unionByName(pauses), words, spans)


def post_conditions(ranges: DataFrame, cuts: DataFrame, words: DataFrame, size: int = 4000) -> dict[str, DataFrame]:
    """What must be empty before an edit is written: edges inside words, and words that no range has and no cut explains."""
    lost = joins.in_ranges(words, ranges.select("source", "start_ms", "end_ms"), "end", size, "left_anti")
    declared = cuts.select("source", (F.col("na") - 1).alias("start_ms"), F.col("nb").alias("end_ms"))
    return {"an edge inside a word": joins.edges_in_words(ranges, words, size, 10), "a word outside the cuts": joins.in_ranges(lost, declared, "end", size, "left_anti")}


def write_edit(ranges: DataFrame, cuts: DataFrame, words: DataFrame, path: str, **settings) -> None:
    """Writes one JSON document for each source, unless a post-condition fails."""
    named = ranges.select(F.col("source").cast("string").alias("project"), "seq", F.col("source").cast("string").alias("source"), "start_ms", "end_ms", F.col("label").alias("beat"), "reason")
    publish(edit_document(named, **settings), path, post_conditions(ranges, cuts, words))


@query("rebuilt_ranges")
def rebuilt_ranges(spark, sf):
    """The chain over the recordings: refined speech cuts, gaps tightened, ranges of both."""
    sound = kept(fx.sound(spark, sf), "sound")
    words = kept(fx.spoken(sound), "words")
    cuts, _, spans = placed_cuts(spark, sf)
    cuts, spans = kept(cuts, "cuts"), kept(spans, "spans")
    protect = spans.select("source", F.lit(500).cast("long").alias("start_ms"), F.lit(1500).cast("long").alias("end_ms"))
    moves = sound.groupBy("source", F.floor(F.col("i") / 50).alias("sec")).agg(F.sum(F.when(F.col("k") % 5 == 0, 1).otherwise(0)).cast("long").alias("n"))
    return rebuild(cuts, words, sound, spans, protect, moves).select("source", "seq", "start_ms", "end_ms", "label")


WINDOWS_SQL = f"""{SOUND_SQL}, {KEPT_SQL}, ko AS (SELECT *, CAST(coalesce(sum(end_ms - start_ms) OVER (PARTITION BY source ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS o0 FROM kept),
wd AS (SELECT source, k, k * 1900 AS x, k * 1900 + 1300 AS y FROM (SELECT source, unnest(range(0, 7)) AS k FROM ke))"""


@query("window_remap", f"WITH {WINDOWS_SQL} SELECT w.source, w.k, greatest(x, o0) - o0 + start_ms AS from_ms, least(y, o0 + end_ms - start_ms) - o0 + start_ms AS to_ms FROM wd w JOIN ko r ON r.source = w.source AND greatest(x, o0) < least(y, o0 + end_ms - start_ms)")
def window_remap(spark, sf):
    """Delivered windows (1.3 s of each 1.9 s) as the spans of the source that they are assembled from."""
    ranges = fx.kept_ranges(fx.sound(spark, sf))
    before = Window.partitionBy("source").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    o0, length = F.coalesce(F.sum(F.col("end_ms") - F.col("start_ms")).over(before), F.lit(0)), F.col("end_ms") - F.col("start_ms")
    laid = ranges.withColumn("o0", o0).select("source", F.col("o0").alias("start_ms"), (F.col("o0") + length).alias("end_ms"), (F.col("start_ms") - F.col("o0")).alias("shift"))
    windows = ranges.select("source").distinct().withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(6).cast("long"))))
    windows = windows.select("source", (F.col("k") * 1900).alias("start_ms"), (F.col("k") * 1900 + 1300).alias("end_ms"), "k")
    met = iv.intersect(windows.withColumn("x", F.col("start_ms")), laid, 4000, ["k"])
    shift = joins.asof(met.withColumn("_t", F.col("start_ms")), laid.select("source", F.col("start_ms").alias("o0"), "shift"), "_t", "o0", ["shift"])
    return shift.select("source", "k", (F.col("start_ms") + F.col("shift")).alias("from_ms"), (F.col("end_ms") + F.col("shift")).alias("to_ms"))


@query("caption_grid_check", f"""WITH {SOUND_SQL}, {KEPT_SQL}, g AS (SELECT source, count(*) AS n, CAST(sum(end_ms - start_ms) AS BIGINT) AS raw, CAST(sum(CAST(ceil(round_even((end_ms - start_ms) * 30.0 / 1000.0, 6)) AS BIGINT)) AS BIGINT) AS frames FROM kept GROUP BY source),
s AS (SELECT *, CASE WHEN source % 3 = 0 THEN raw / 1000.0 WHEN source % 3 = 1 THEN frames / 30.0 ELSE frames / 30.0 + 0.06 END AS stamped, CASE WHEN source % 7 = 0 THEN 25.0 ELSE 30.0 END AS stamped_fps FROM g)
SELECT source, CASE WHEN abs(stamped_fps - 30.0) > 0.01 THEN 'another frame rate' WHEN abs(stamped - frames / 30.0) > 1.5 / 30.0 THEN 'another timeline' ELSE 'ok' END AS verdict FROM s""")
def caption_grid_check(spark, sf):
    """Whether captions were laid on the timeline that is delivered: their stamp (here the raw total for a third of the
    sources, 60 ms too much for another) against the total in whole frames."""
    return grid_verdicts(fx.kept_ranges(fx.sound(spark, sf)), 30.0)


def grid_verdicts(ranges: DataFrame, fps: float) -> DataFrame:
    length = F.col("end_ms") - F.col("start_ms")
    total = ranges.groupBy("source").agg(F.sum(length).alias("raw"), F.sum(iv.quantised(length, fps)).alias("frames"))
    exact = F.col("frames") / F.lit(fps)
    stamped = F.when(F.col("source") % 3 == 0, F.col("raw") / 1000.0).when(F.col("source") % 3 == 1, exact).otherwise(exact + 0.06)
    stamped_fps = F.when(F.col("source") % 7 == 0, 25.0).otherwise(30.0)
    verdict = F.when(F.abs(stamped_fps - fps) > 0.01, "another frame rate").when(F.abs(stamped - exact) > 1.5 / fps, "another timeline").otherwise("ok")
    return total.select("source", verdict.alias("verdict"))


@query("stitched_takes", "SELECT conv_id AS source, count(DISTINCT role) > 1 AS stitched FROM conversations GROUP BY conv_id")
def stitched_takes(spark, sf):
    """Whether a project is stitched from several takes, by evidence of a second one."""
    return fx.turns(spark, sf).groupBy("source").agg((F.countDistinct("role") > 1).alias("stitched"))


def stale(built: DataFrame, edits: DataFrame) -> DataFrame:
    """source of what was built (source, built_at) before its edit (source, edited_at), or from none."""
    return built.join(edits, "source", "left").where("edited_at IS NULL OR built_at < edited_at").select("source")
