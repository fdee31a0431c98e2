"""Queries of the interval algebra and of range joins, over events and words."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.operators import intervals as iv
from loomline.operators import joins
from loomline.plans.registry import query
from loomline.sources import fixtures as fx
from loomline.sources.fixtures import CUTS_SQL, WORDS_SQL

FPS = 30.0
DAY, HOUR = 86_400_000, 3_600_000
MINUTE = 60_000
LEAST = 50

MERGED_SQL = f"""{CUTS_SQL},
c1 AS (SELECT *, max(end_ms) OVER (PARTITION BY source ORDER BY start_ms, end_ms, why ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM cuts),
c2 AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_ms - reach >= {{slack}} THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY start_ms, end_ms, why ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM c1),
merged AS (SELECT source, island, min(start_ms) AS start_ms, max(end_ms) AS end_ms, string_agg(why, ' + ' ORDER BY start_ms, end_ms, why) AS why_all, arg_min(why, start_ms) AS why_first FROM c2 GROUP BY source, island)"""
STRICT_SQL = MERGED_SQL.format(slack=0)
RANGES_SQL = f"""{STRICT_SQL},
inside AS (SELECT m.source, greatest(start_ms, lo) AS a, least(end_ms, hi) AS b FROM merged m JOIN spans USING (source) WHERE least(end_ms, hi) > greatest(start_ms, lo)),
steps AS (SELECT source, a, b FROM inside UNION ALL SELECT source, hi, hi FROM spans),
pieces AS (SELECT s.source, coalesce(lag(b) OVER (PARTITION BY s.source ORDER BY a, b), lo) AS start_ms, a AS end_ms FROM steps s JOIN spans USING (source)),
ranges AS (SELECT * FROM pieces WHERE end_ms - start_ms > {LEAST})"""
FRAMES_OF = "CAST(ceil(round_even(({0}) * 30.0 / 1000.0, 6)) AS BIGINT)"
OFFSETS_SQL = f"""{RANGES_SQL},
offs AS (SELECT *, row_number() OVER w - 1 AS seq, CAST(coalesce(sum(end_ms - start_ms) OVER b, 0) AS BIGINT) AS out_ms,
  CAST(coalesce(sum({FRAMES_OF.format('end_ms - start_ms')}) OVER b, 0) AS BIGINT) AS out_frames FROM ranges
  WINDOW w AS (PARTITION BY source ORDER BY start_ms, end_ms), b AS (PARTITION BY source ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def merged(spark, sf):
    return iv.union(fx.cuts(spark, sf))


def ranges(spark, sf):
    return iv.complement(merged(spark, sf), fx.spans(spark, sf), LEAST)


@query("cut_union_strict", f"WITH {STRICT_SQL} SELECT source, start_ms, end_ms, why_all AS why FROM merged")
def cut_union_strict(spark, sf):
    return iv.union(fx.cuts(spark, sf), 0, "all")


@query("cut_union_touching", f"WITH {MERGED_SQL.format(slack=1)} SELECT source, start_ms, end_ms, why_first AS why FROM merged")
def cut_union_touching(spark, sf):
    return iv.union(fx.cuts(spark, sf), 1, "first")


@query("run_bridge", f"WITH {MERGED_SQL.format(slack=HOUR)} SELECT source, start_ms, end_ms FROM merged")
def run_bridge(spark, sf):
    return iv.union(fx.cuts(spark, sf), HOUR)


@query("kept_complement", f"WITH {RANGES_SQL} SELECT source, start_ms, end_ms FROM ranges")
def kept_complement(spark, sf):
    return ranges(spark, sf)


PAUSES_SQL = f"""{STRICT_SQL},
p1 AS (SELECT *, max(end_ms) OVER (PARTITION BY source ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM pauses),
p2 AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_ms - reach >= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM p1),
pm AS (SELECT source, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM p2 GROUP BY source, island)"""


@query("interval_intersect", f"WITH {PAUSES_SQL} SELECT a.source, greatest(a.start_ms, b.start_ms) AS start_ms, least(a.end_ms, b.end_ms) AS end_ms FROM pm a JOIN merged b ON a.source = b.source AND a.start_ms < b.end_ms AND b.start_ms < a.end_ms")
def interval_intersect(spark, sf):
    return iv.intersect(iv.union(fx.pauses(spark, sf)), merged(spark, sf), DAY)


@query("interval_subtract", f"""WITH {PAUSES_SQL},
x AS (SELECT a.source, a.start_ms AS l0, greatest(a.start_ms, b.start_ms) AS a, least(a.end_ms, b.end_ms) AS b FROM pm a JOIN merged b ON a.source = b.source AND a.start_ms < b.end_ms AND b.start_ms < a.end_ms),
y AS (SELECT * FROM x UNION ALL SELECT source, start_ms, end_ms, end_ms FROM pm),
z AS (SELECT source, coalesce(lag(b) OVER (PARTITION BY source, l0 ORDER BY a, b), l0) AS start_ms, a AS end_ms FROM y)
SELECT * FROM z WHERE end_ms - start_ms >= 200""")
def interval_subtract(spark, sf):
    return iv.subtract(iv.union(fx.pauses(spark, sf)), merged(spark, sf), 200, DAY)


@query("word_free_spans", f"""WITH {WORDS_SQL},
f AS (SELECT source, start_ms - 40 AS s, end_ms + 40 AS e, idx FROM words),
g AS (SELECT source, max(e) OVER (PARTITION BY source ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS start_ms, s AS end_ms FROM f)
SELECT source, CAST(start_ms AS BIGINT) AS start_ms, end_ms FROM g WHERE end_ms - start_ms > 200""")
def word_free_spans(spark, sf):
    words = fx.words(spark, sf)
    padded = iv.union(words.select("source", (F.col("start_ms") - 40).alias("start_ms"), (F.col("end_ms") + 40).alias("end_ms")))
    spans = words.groupBy("source").agg((F.min("start_ms") - 40).alias("lo"), (F.max("end_ms") + 40).alias("hi"))
    return iv.complement(padded, spans, 200)


@query("offset_quantised_vs_raw", f"""WITH {OFFSETS_SQL}
SELECT source, count(*) AS ranges, CAST(sum(end_ms - start_ms) AS BIGINT) AS raw_ms, CAST(sum({FRAMES_OF.format('end_ms - start_ms')}) AS BIGINT) AS frames,
  round(sum({FRAMES_OF.format('end_ms - start_ms')}) * 1000 / 30.0 - sum(end_ms - start_ms), 6) AS drift_ms FROM offs GROUP BY source""")
def offset_quantised_vs_raw(spark, sf):
    length = F.col("end_ms") - F.col("start_ms")
    frames = iv.quantised(length, FPS)
    return ranges(spark, sf).groupBy("source").agg(F.count(F.lit(1)).alias("ranges"), F.sum(length).alias("raw_ms"), F.sum(frames).alias("frames"),
                                                   F.round(F.sum(frames) * 1000 / F.lit(FPS) - F.sum(length), 6).alias("drift_ms"))


@query("range_offsets", f"WITH {OFFSETS_SQL} SELECT source, seq, start_ms, end_ms, out_ms, out_frames FROM offs")
def range_offsets(spark, sf):
    return iv.with_offsets(ranges(spark, sf), FPS)


@query("kept_points_remapped", f"""WITH {OFFSETS_SQL}
SELECT p.source, p.event_id, p.t_ms, o.seq, p.t_ms - o.start_ms + o.out_ms AS out_ms FROM points p JOIN offs o ON p.source = o.source AND p.t_ms > o.start_ms AND p.t_ms <= o.end_ms""")
def kept_points_remapped(spark, sf):
    """Events that no cut removes, on the timeline that is left: union, complement, offsets, range join."""
    points = fx.points(spark, sf).withColumns({"start_ms": F.col("t_ms"), "end_ms": F.col("t_ms")})
    kept = joins.in_ranges(points, iv.with_offsets(ranges(spark, sf), FPS), "end", DAY)
    return kept.select("source", "event_id", "t_ms", "seq", (F.col("t_ms") - F.col("r_start") + F.col("out_ms")).alias("out_ms"))


@query("inverse_remap", f"""WITH {OFFSETS_SQL}, marks AS (SELECT source, unnest(range(0, 10)) * 86400000 AS t FROM spans)
SELECT m.source, m.t, o.seq, o.start_ms + m.t - o.out_ms AS source_ms FROM marks m ASOF LEFT JOIN offs o ON m.source = o.source AND m.t >= o.out_ms""")
def inverse_remap(spark, sf):
    marks = fx.spans(spark, sf).select("source", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k")).select("source", (F.col("k").cast("long") * DAY).alias("t"))
    offs = iv.with_offsets(ranges(spark, sf), FPS)
    found = joins.asof(marks, offs, "t", "out_ms", ["seq", "start_ms", "out_ms"])
    return found.select("source", "t", "seq", (F.col("start_ms") + F.col("t") - F.col("out_ms")).alias("source_ms"))


@query("gap_keep_middle", f"""WITH {RANGES_SQL}, best AS (SELECT source, start_ms AS s, end_ms - start_ms AS n FROM ranges QUALIFY row_number() OVER (PARTITION BY source ORDER BY end_ms - start_ms DESC, start_ms) = 1)
SELECT source, CAST(s + (n - least(n, {HOUR})) // 2 AS BIGINT) AS start_ms, CAST(s + (n - least(n, {HOUR})) // 2 + least(n, {HOUR}) AS BIGINT) AS end_ms FROM best""")
def gap_keep_middle(spark, sf):
    return iv.middle(ranges(spark, sf), HOUR)


@query("busiest_slice", f"""WITH {CUTS_SQL}, h AS (SELECT source, t_ms // {HOUR} AS slot, count(*) AS n FROM points GROUP BY ALL),
r AS (SELECT source, unnest(range(lo // {HOUR}, hi // {HOUR} + 1)) AS slot FROM spans),
f AS (SELECT r.source, r.slot, coalesce(n, 0) AS n FROM r LEFT JOIN h USING (source, slot)),
w AS (SELECT source, slot, sum(n) OVER q AS total, count(*) OVER q AS k FROM f WINDOW q AS (PARTITION BY source ORDER BY slot ROWS BETWEEN CURRENT ROW AND 23 FOLLOWING))
SELECT source, arg_max(slot, total * 10000000 - slot) AS slot, CAST(max(total) AS BIGINT) AS total FROM w WHERE k = 24 GROUP BY source""")
def busiest_slice(spark, sf):
    points = fx.points(spark, sf).groupBy("source", F.floor(F.col("t_ms") / HOUR).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    slots = fx.spans(spark, sf).select("source", F.explode(F.sequence(F.floor(F.col("lo") / HOUR), F.floor(F.col("hi") / HOUR))).alias("slot"))
    return iv.busiest(slots.join(points, ["source", "slot"], "left").select("source", "slot", F.coalesce("n", F.lit(0)).alias("n")), 24)


# Ranges over the words of each document: every third minute is cut out.
WORD_RANGES_SQL = f"""{WORDS_SQL}, ends AS (SELECT source, max(end_ms) AS hi FROM words GROUP BY source),
wr AS (SELECT source, k * 180000 AS start_ms, least(k * 180000 + 120000, hi) AS end_ms FROM (SELECT source, hi, unnest(range(0, hi // 180000 + 1)) AS k FROM ends))"""


def word_ranges(words):
    ends = words.groupBy("source").agg(F.max("end_ms").alias("hi"))
    k = ends.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("hi") / 180_000))))
    return k.select("source", (F.col("k") * 180_000).alias("start_ms"), F.least(F.col("k") * 180_000 + 120_000, F.col("hi")).alias("end_ms"))


TESTS = {"end": "w.end_ms > r.start_ms AND w.end_ms <= r.end_ms", "inside": "w.start_ms >= r.start_ms AND w.end_ms <= r.end_ms", "overlap": "NOT (w.end_ms <= r.start_ms OR w.start_ms >= r.end_ms)", "start": "w.start_ms >= r.start_ms AND w.start_ms < r.end_ms"}


def _in_range(name):
    @query(f"point_in_range_{name}", f"WITH {WORD_RANGES_SQL} SELECT w.source, r.start_ms AS r_start, count(*) AS n, CAST(sum(w.idx) AS BIGINT) AS idx_sum FROM words w JOIN wr r ON w.source = r.source AND {TESTS[name]} GROUP BY w.source, r.start_ms")
    def run(spark, sf):
        words = fx.words(spark, sf)
        return joins.in_ranges(words, word_ranges(words), name, MINUTE).groupBy("source", "r_start").agg(F.count(F.lit(1)).alias("n"), F.sum("idx").alias("idx_sum"))


for _name in TESTS:
    _in_range(_name)


@query("straddle_violations", f"WITH {WORD_RANGES_SQL}, e AS (SELECT DISTINCT source, unnest([start_ms, end_ms]) AS edge FROM wr) SELECT w.source, e.edge, w.idx, w.text FROM e JOIN words w ON w.source = e.source AND w.start_ms + 10 < e.edge AND e.edge < w.end_ms - 10")
def straddle_violations(spark, sf):
    words = fx.words(spark, sf)
    return joins.edges_in_words(word_ranges(words), words, MINUTE, 10).select("source", "edge", "idx", "text")


LOST_SQL = f"{WORD_RANGES_SQL}, lost AS (SELECT w.* FROM words w WHERE NOT EXISTS (SELECT 1 FROM wr r WHERE r.source = w.source AND w.end_ms > r.start_ms AND w.end_ms <= r.end_ms))"


@query("lost_words", f"WITH {LOST_SQL} SELECT source, idx, text FROM lost")
def lost_words(spark, sf):
    words = fx.words(spark, sf)
    return joins.in_ranges(words, word_ranges(words), "end", MINUTE, "left_anti").select("source", "idx", "text")


@query("stray_words", f"WITH {LOST_SQL}, dc AS (SELECT source, k * 180000 + 120000 AS start_ms, k * 180000 + 180000 AS end_ms FROM (SELECT source, unnest(range(0, hi // 180000 + 1)) AS k FROM ends) WHERE k % 2 = 0) SELECT source, idx, text FROM lost w WHERE NOT EXISTS (SELECT 1 FROM dc r WHERE r.source = w.source AND w.end_ms > r.start_ms AND w.end_ms <= r.end_ms)")
def stray_words(spark, sf):
    """Lost words that no declared cut explains (every second cut is declared)."""
    words = fx.words(spark, sf)
    lost = joins.in_ranges(words, word_ranges(words), "end", MINUTE, "left_anti")
    ends = words.groupBy("source").agg(F.max("end_ms").alias("hi"))
    k = ends.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("hi") / 180_000)))).where("k % 2 = 0")
    declared = k.select("source", (F.col("k") * 180_000 + 120_000).alias("start_ms"), (F.col("k") * 180_000 + 180_000).alias("end_ms"))
    return joins.in_ranges(lost, declared, "end", MINUTE, "left_anti").select("source", "idx", "text")


MARKS_SQL = f"{WORD_RANGES_SQL}, marks AS (SELECT source, unnest(range(0, hi // 30000 + 1)) * 30000 AS t FROM ends)"


def marks(words):
    ends = words.groupBy("source").agg(F.max("end_ms").alias("hi"))
    k = ends.select("source", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("hi") / 30_000))).alias("k"))
    return k.select("source", (F.col("k") * 30_000).alias("t"))


@query("asof_prev_end", f"WITH {MARKS_SQL} SELECT m.source, m.t, w.idx, w.end_ms FROM marks m ASOF LEFT JOIN words w ON m.source = w.source AND m.t + 10 >= w.end_ms")
def asof_prev_end(spark, sf):
    """The last word that ends before each mark, or up to 10 ms after it."""
    words = fx.words(spark, sf)
    return joins.asof(marks(words).withColumn("to", F.col("t") + 10), words, "to", "end_ms", ["idx", "end_ms"]).select("source", "t", "idx", "end_ms")


@query("asof_next_word", f"""WITH {MARKS_SQL}, n AS (SELECT source, count(*) AS words_n FROM words GROUP BY source)
SELECT m.source, m.t, coalesce(w.idx, n.words_n) AS idx, coalesce(w.start_ms - m.t > 1500, false) AS far FROM marks m JOIN n ON n.source = m.source ASOF LEFT JOIN words w ON m.source = w.source AND m.t - 60 <= w.start_ms""")
def asof_next_word(spark, sf):
    """The first word from 60 ms before each mark; past the last word the number of words."""
    words = fx.words(spark, sf)
    total = words.groupBy("source").agg(F.count(F.lit(1)).alias("words_n"))
    found = joins.asof(marks(words).withColumn("from", F.col("t") - 60), words, "from", "start_ms", ["idx", "start_ms"], "forward").join(total, "source")
    return found.select("source", "t", F.coalesce("idx", "words_n").alias("idx"), F.coalesce(F.col("start_ms") - F.col("t") > 1500, F.lit(False)).alias("far"))


@query("window_owner", f"""WITH {WORDS_SQL}, hit AS (SELECT source, idx, start_ms FROM words WHERE length(text) > 18)
SELECT h.source, h.idx, h.start_ms // 600000 AS tile, count(*) AS tiles_that_see_it FROM hit h, range(-1, 2) d(k) WHERE h.start_ms // 600000 + k >= 0 AND h.start_ms >= (h.start_ms // 600000 + k) * 600000 - 90000 AND h.start_ms < (h.start_ms // 600000 + k + 1) * 600000 + 90000 GROUP BY ALL""")
def window_owner(spark, sf):
    """The ten-minute tile that owns each long word, and how many tiles see it with ninety seconds of context."""
    hits = fx.words(spark, sf).where(F.length("text") > 18).select("source", "idx", "start_ms", F.floor(F.col("start_ms") / 600_000).alias("tile"))
    seen = hits.withColumn("k", F.explode(F.sequence(F.greatest(F.col("tile") - 1, F.lit(0)), F.col("tile") + 1)))
    seen = seen.where((F.col("start_ms") >= F.col("k") * 600_000 - 90_000) & (F.col("start_ms") < (F.col("k") + 1) * 600_000 + 90_000))
    return seen.groupBy("source", "idx", "tile").agg(F.count(F.lit(1)).alias("tiles_that_see_it"))


@query("take_merge_checks", """WITH r AS (SELECT conv_id AS source, role AS input, count(*) AS ranges FROM conversations GROUP BY conv_id, role),
u AS (SELECT role AS input, CASE role WHEN 'system' THEN 'other.ass' ELSE 'master.ass' END AS subtitles, min(conv_id) AS first FROM conversations GROUP BY role)
SELECT 'ranges in two inputs' AS refused, CAST(source AS VARCHAR) AS what FROM r GROUP BY source HAVING count(*) > 1
UNION ALL SELECT 'inputs disagree about subtitles', string_agg(subtitles, ', ' ORDER BY subtitles) FROM (SELECT DISTINCT subtitles FROM u) HAVING count(*) > 1""")
def take_merge_checks(spark, sf):
    """Why inputs (here by role) must not be merged: a source with ranges in two of them, different subtitles."""
    t = fx.turns(spark, sf)
    ranges = t.select(F.col("role").alias("input"), "source")
    inputs = t.select(F.col("role").alias("input"), F.when(F.col("role") == "system", "other.ass").otherwise("master.ass").alias("subtitles")).distinct()
    return iv.merge_refusals(ranges, inputs)


@query("take_conflicts", "SELECT conv_id AS source, count(DISTINCT role) AS takes FROM conversations GROUP BY conv_id HAVING count(DISTINCT role) > 1")
def take_conflicts(spark, sf):
    """Sources that more than one take claims."""
    return fx.turns(spark, sf).groupBy("source").agg(F.countDistinct("role").alias("takes")).where("takes > 1")


@query("take_concat", """SELECT conv_id AS source, row_number() OVER (PARTITION BY conv_id ORDER BY CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END, turn, text) - 1 AS seq, role, turn FROM conversations""")
def take_concat(spark, sf):
    """Takes in the order given, each in its own order; the order is a column."""
    from functools import reduce

    from pyspark.sql import Window

    t = fx.turns(spark, sf)
    takes = [t.where(F.col("role") == r).withColumn("take", F.lit(i)) for i, r in enumerate(("system", "user"))]
    takes.append(t.where(~F.col("role").isin("system", "user")).withColumn("take", F.lit(2)))
    every = reduce(lambda a, b: a.unionByName(b), takes)
    seq = F.row_number().over(Window.partitionBy("source").orderBy("take", "seq", "text")) - 1
    return every.select("source", seq.cast("long").alias("n"), "role", F.col("seq").alias("turn")).withColumnRenamed("n", "seq")
