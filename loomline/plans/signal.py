"""Queries over sampled levels (events) and pictures (embeddings)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.operators import signal as sg
from loomline.plans.registry import query
from loomline.sources import fixtures as fx
from loomline.sources.fixtures import FRAMES_SQL, KEPT_SQL, PICTURES_SQL, SOUND_SQL

FLOOR_SQL = "fl AS (SELECT source, greatest(quantile_cont(level, 0.9) * 0.1, quantile_cont(level, 0.1) * 1.8) AS floor_words, greatest(quantile_cont(level, 0.9) * 0.1, quantile_cont(level, 0.2) * pow(10, 0.5)) AS floor_gaps FROM frames GROUP BY source)"
ROUNDED = "SELECT source, round(floor_words, 6) AS floor_words, round(floor_gaps, 6) AS floor_gaps FROM fl"


@query("level_percentiles", f"WITH {FRAMES_SQL} SELECT source, round(quantile_cont(level, 0.1), 6) AS p10, round(quantile_cont(level, 0.2), 6) AS p20, round(quantile_cont(level, 0.9), 6) AS p90, round(quantile_cont(level, 0.95), 6) AS p95 FROM frames GROUP BY source")
def level_percentiles(spark, sf):
    return sg.percentiles(fx.frames(spark, sf))


@query("adaptive_floor", f"WITH {FRAMES_SQL}, {FLOOR_SQL} {ROUNDED}")
def adaptive_floor(spark, sf):
    return sg.floors(fx.frames(spark, sf))


BLOCK_SQL = f"WITH {FRAMES_SQL} SELECT source, i // 8 AS block, {{0}} FROM frames GROUP BY source, i // 8"


@query("frame_rms", BLOCK_SQL.format("round(sqrt(avg(level * level)), 6) AS rms"))
def frame_rms(spark, sf):
    return sg.blocks(fx.frames(spark, sf), 8).drop("peak_db")


@query("frame_peak_db", BLOCK_SQL.format("round(20 * log10(max(abs(level)) + 1e-9), 6) AS peak_db"))
def frame_peak_db(spark, sf):
    return sg.blocks(fx.frames(spark, sf), 8).drop("rms")


@query("centred_moving_average", f"WITH {FRAMES_SQL} SELECT source, i, round(sum(level) OVER (PARTITION BY source ORDER BY i ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING) / 20, 6) AS smooth FROM frames")
def centred_moving_average(spark, sf):
    return fx.frames(spark, sf).select("source", "i", F.round(sg.smoothed(10, 9), 6).alias("smooth"))


@query("rolling_window_max", f"WITH {FRAMES_SQL}, w AS (SELECT source, sum(level) OVER q AS t, count(*) OVER q AS k FROM frames WINDOW q AS (PARTITION BY source ORDER BY i ROWS BETWEEN CURRENT ROW AND 24 FOLLOWING)) SELECT source, round(max(t), 6) AS total FROM w WHERE k = 25 GROUP BY source")
def rolling_window_max(spark, sf):
    return sg.window_max(fx.frames(spark, sf), 25)


QUIET_SQL = f"{FRAMES_SQL}, {FLOOR_SQL}, q AS (SELECT f.source, i, max(level) OVER (PARTITION BY f.source ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near, floor_gaps * 2 AS floor FROM frames f JOIN fl ON f.source = fl.source), quiet AS (SELECT source, i, near < floor AS quiet FROM q)"


def quiet_frames(spark, sf):
    frames = fx.frames(spark, sf)
    p = lambda q: F.percentile("level", F.lit(q))
    floor = frames.groupBy("source").agg((F.greatest(p(0.9) * 0.1, p(0.2) * 10**0.5) * 2).alias("floor"))
    return sg.quiet(frames, floor, 1)


@query("is_quiet", f"WITH {QUIET_SQL} SELECT source, i, quiet FROM quiet")
def is_quiet(spark, sf):
    return quiet_frames(spark, sf).select("source", "i", "quiet")


RUN_SQL = "r AS (SELECT source, i, i - row_number() OVER (PARTITION BY source ORDER BY i) AS g FROM {0} WHERE {1}) SELECT source, min(i) AS first, max(i) AS last, count(*) AS n FROM r GROUP BY source, g HAVING count(*) >= {2}"


@query("quiet_runs", f"WITH {QUIET_SQL}, {RUN_SQL.format('quiet', 'quiet', 2)}")
def quiet_runs(spark, sf):
    return sg.true_runs(quiet_frames(spark, sf).withColumn("flag", F.col("quiet")), 2)


@query("nearest_quiet_point", f"""WITH {QUIET_SQL}, ats AS (SELECT source, i FROM frames), n AS (SELECT a.source, a.i, arg_min(b.i, abs(b.i - a.i) * 1000000 + b.i) AS moved FROM ats a JOIN quiet b ON a.source = b.source AND b.quiet AND b.i BETWEEN a.i - 6 AND a.i + 6 GROUP BY a.source, a.i)
SELECT a.source, a.i, coalesce(n.moved, a.i) AS moved FROM ats a LEFT JOIN n USING (source, i)""")
def nearest_quiet_point(spark, sf):
    at = fx.frames(spark, sf).select("source", "i")
    return sg.nearest_quiet(at, quiet_frames(spark, sf), 6)


@query("head_tail_onset", f"""WITH {FRAMES_SQL}, p AS (SELECT source, quantile_cont(level, 0.95) AS p95, max(i) AS n FROM frames GROUP BY source)
SELECT f.source, max(CASE WHEN i = 0 THEN level END) > any_value(p95) * pow(10, -15 / 20.0) AS head_clipped, max(CASE WHEN i = n THEN level END) > any_value(p95) * pow(10, -15 / 20.0) AS tail_clipped FROM frames f JOIN p USING (source) GROUP BY f.source""")
def head_tail_onset(spark, sf):
    """Whether a source's first or last frame is already (or still) as loud as speech."""
    frames = fx.frames(spark, sf)
    ends = frames.groupBy("source").agg(F.percentile("level", F.lit(0.95)).alias("p95"), F.min_by("level", "i").alias("head"), F.max_by("level", "i").alias("tail"))
    line = F.col("p95") * 10 ** (-15 / 20)
    return ends.select("source", (F.col("head") > line).alias("head_clipped"), (F.col("tail") > line).alias("tail_clipped"))


@query("cell_deviation", f"WITH {PICTURES_SQL}, c AS (SELECT source, unnest(range(0, 64)) AS cell, unnest(vec) AS v FROM pictures) SELECT source, cell, round(stddev_pop(v), 6) AS deviation FROM c GROUP BY source, cell")
def cell_deviation(spark, sf):
    cells = fx.pictures(spark, sf).select("source", F.posexplode("vec").alias("cell", "v"))
    return cells.groupBy("source", F.col("cell").cast("long").alias("cell")).agg(F.round(F.stddev_pop("v"), 6).alias("deviation"))


# A picture of 64 numbers is eight rows of eight cells; blocks are two by two, and the inset (the two lowest rows' first two
# cells) is left out.
BLOCKS = [[8 * (2 * r + i) + 2 * c + j for i in (0, 1) for j in (0, 1)] for r in range(4) for c in range(4)]
INSET = (48, 49, 56, 57)
DELTA, LIVE_CELLS = 0.2, 4
DIFF_SQL = f"{PICTURES_SQL}, pv AS (SELECT source, sec, vec, lag(vec) OVER (PARTITION BY source ORDER BY sec) AS b FROM pictures), dd AS (SELECT source, sec, list_transform(range(1, 65), lambda k: CASE WHEN list_contains({[k + 1 for k in INSET]}, k) THEN 0.0 ELSE abs(CAST(vec[k] AS DOUBLE) - CAST(b[k] AS DOUBLE)) END) AS d FROM pv WHERE b IS NOT NULL)"
COUNT_SQL = lambda f: "CAST(" + " + ".join(f"CAST({f.format('[' + ', '.join(f'd[{k + 1}]' for k in block) + ']')} > {DELTA} AS INTEGER)" for block in BLOCKS) + " AS BIGINT)"
CHANGE_SQL = f"{DIFF_SQL}, ch AS (SELECT source, sec, {COUNT_SQL('list_max({})')} AS changed, {COUNT_SQL('(list_sum({}) / 4)')} AS changed_mean FROM dd)"


@query("blocks_changed_max", f"WITH {CHANGE_SQL} SELECT source, sec, changed FROM ch")
def blocks_changed_max(spark, sf):
    """Blocks of which some cell changed, outside the inset."""
    return sg.blocks_changed(fx.pictures(spark, sf), BLOCKS, INSET, DELTA).select("source", "sec", F.col("changed_max").alias("changed"))


@query("blocks_changed_mean", f"WITH {CHANGE_SQL} SELECT source, sec, changed_mean AS changed, changed_mean > {LIVE_CELLS} AS live FROM ch")
def blocks_changed_mean(spark, sf):
    """Blocks whose cells changed in the mean; a second with more than four of them is live."""
    return sg.blocks_changed(fx.pictures(spark, sf), BLOCKS, INSET, DELTA).select("source", "sec", F.col("changed_mean").alias("changed"), (F.col("changed_mean") > LIVE_CELLS).alias("live"))


@query("live_ratio", f"WITH {CHANGE_SQL} SELECT source, CAST(sum(CASE WHEN changed > {LIVE_CELLS} THEN 1 ELSE 0 END) AS BIGINT) AS live, count(*) AS total, sum(CASE WHEN changed > {LIVE_CELLS} THEN 1 ELSE 0 END) > count(*) / 3 AS keep FROM ch GROUP BY source")
def live_ratio(spark, sf):
    return sg.live_share(sg.blocks_changed(fx.pictures(spark, sf), BLOCKS, INSET, DELTA).withColumnRenamed("changed_max", "changed"), LIVE_CELLS)


@query("silence_verdict", f"""WITH {CHANGE_SQL}, w AS (SELECT label AS source, k * 7 AS a, k * 7 + 5 + k % 4 AS b FROM (SELECT DISTINCT label FROM embeddings), range(0, 12) r(k))
SELECT w.source, w.a, w.b, count(c.sec) AS total, CAST(coalesce(sum(CASE WHEN changed > {LIVE_CELLS} THEN 1 ELSE 0 END), 0) AS BIGINT) AS live, CASE WHEN count(c.sec) = 0 THEN 'not sampled' WHEN coalesce(sum(CASE WHEN changed > {LIVE_CELLS} THEN 1 ELSE 0 END), 0) <= count(c.sec) / 3 THEN 'dead air' ELSE 'kept' END AS verdict
FROM w LEFT JOIN ch c ON c.source = w.source AND c.sec > w.a AND c.sec <= w.b GROUP BY w.source, w.a, w.b""")
def silence_verdict(spark, sf):
    """Silent windows by how many of their seconds the picture moved; a window without pictures fails too."""
    seconds = sg.blocks_changed(fx.pictures(spark, sf), BLOCKS, INSET, DELTA)
    labels = fx.table(spark, sf, "embeddings").select(F.col("label").cast("long").alias("source")).distinct()
    k = labels.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(11).cast("long"))))
    return sg.silence_verdicts(k.select("source", (F.col("k") * 7).alias("a"), (F.col("k") * 7 + 5 + F.col("k") % 4).alias("b")), seconds, LIVE_CELLS)


@query("grade_rules", f"""WITH {PICTURES_SQL}, c AS (SELECT source, unnest(vec) AS v FROM pictures), m AS (SELECT source, avg(abs(CAST(v AS DOUBLE))) * 4 AS y, (max(CAST(v AS DOUBLE)) - min(CAST(v AS DOUBLE))) * 0.8 AS r, avg(CAST(v AS DOUBLE) * CAST(v AS DOUBLE)) * 16 AS s FROM c GROUP BY source)
SELECT source, round(greatest(0.94, least(1.08, CASE WHEN r < 0.65 THEN 1.08 - 0.05 * greatest(0.0, least(1.0, (r - 0.50) / 0.15)) ELSE 1.03 END)), 6) AS contrast,
round(greatest(0.94, least(1.10, CASE WHEN y < 0.42 THEN 1.10 - 0.08 * greatest(0.0, least(1.0, (y - 0.30) / 0.12)) WHEN y > 0.60 THEN 0.97 ELSE 1.0 END)), 6) AS gamma,
CAST(CASE WHEN s < 0.18 THEN 1.04 WHEN s > 0.38 THEN 0.96 ELSE 0.98 END AS DOUBLE) AS saturation FROM m""")
def grade_rules(spark, sf):
    """Contrast, gamma and saturation by clamped piecewise rules over three means of a source's pictures."""
    v = F.col("v").cast("double")
    cells = fx.pictures(spark, sf).select("source", F.explode("vec").alias("v"))
    stats = cells.groupBy("source").agg((F.avg(F.abs(v)) * 4).alias("y_mean"), ((F.max(v) - F.min(v)) * 0.8).alias("y_range"), (F.avg(v * v) * 16).alias("sat_mean"))
    return sg.graded(stats)


@query("sampled_reference", f"""WITH {SOUND_SQL}, {KEPT_SQL}, tk AS (SELECT *, least(900, end_ms - start_ms) AS take FROM kept WHERE end_ms - start_ms >= 500), sp AS (SELECT *, coalesce(sum(take) OVER (PARTITION BY source ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS span FROM tk)
SELECT s.source, count(*) AS frames, round(quantile_cont(20 * log10(level + 1e-9), 0.95), 6) AS reference FROM sp r JOIN sound s ON s.source = r.source AND r.span < 2500 AND s.i >= r.start_ms // 20 AND s.i < (r.start_ms + take) // 20 GROUP BY s.source""")
def sampled_reference(spark, sf):
    """The speech level of a take: up to 0.9 s from each kept range of 0.5 s and more, until 2.5 s are together."""
    sound = fx.sound(spark, sf)
    return sg.reference_level(sound, fx.kept_ranges(sound), 900, 500, 2500)


@query("dead_air", f"""WITH {SOUND_SQL}, th AS (SELECT source, quantile_cont(level, 0.9) * pow(10, -20 / 20.0) AS thr FROM sound GROUP BY source),
sm AS (SELECT s.source, i, sum(level) OVER (PARTITION BY s.source ORDER BY i ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING) / 20 < thr AS quiet FROM sound s JOIN th USING (source)),
ru AS (SELECT source, min(i) AS a, max(i) + 1 AS b FROM (SELECT source, i, i - row_number() OVER (PARTITION BY source ORDER BY i) AS g FROM sm WHERE quiet) GROUP BY source, g),
br AS (SELECT *, sum(CASE WHEN pb IS NULL OR a - pb >= 30 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY a) AS k FROM (SELECT *, lag(b) OVER (PARTITION BY source ORDER BY a) AS pb FROM ru))
SELECT source, min(a) * 20 AS start_ms, max(b) * 20 AS end_ms FROM br GROUP BY source, k HAVING max(b) - min(a) >= 25""")
def dead_air(spark, sf):
    """Stretches of half a second and more whose level, smoothed, stays 20 dB under the source's loud level, gaps under 0.6 s
    bridged."""
    return sg.dead_air(fx.sound(spark, sf), smooth=20, bridge=30, least=25)
