"""Queries that place cuts and tighten gaps, over recordings (order lines as frames) and their words."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomline.operators import edges as ed
from loomline.operators import pauses as pz
from loomline.plans.registry import query
from loomline.sources import fixtures as fx
from loomline.sources.fixtures import AUTHORED_SQL, KEPT_SQL, SPOKEN_SQL, WORDS_SQL
from loomline.sources.store import kept

BOTH_SQL = f"{AUTHORED_SQL}, {KEPT_SQL}, spans AS (SELECT source, hi AS dur_ms FROM ke)"


def recordings(spark, sf):
    """sound, words, authored cuts and spans."""
    sound = kept(fx.sound(spark, sf), "sound")
    words = kept(fx.spoken(sound), "words")
    return sound, words, fx.authored(words), sound.groupBy("source").agg(((F.max("i") + 1) * 20).alias("dur_ms"))


def steps_sql(name, points, rounds, slack, move):
    """points walked out of words, a step at a time; the last step is named name."""
    out, last = [], points
    for k in range(rounds):
        this = name if k == rounds - 1 else f"{name}{k}"
        out.append(f"{this} AS (SELECT p.source, p.id, coalesce(any_value(m.t), any_value(p.t)) AS t FROM {last} p LEFT JOIN (SELECT p.source, p.id, arg_min({move}, w.idx) AS t FROM {last} p JOIN spoken w ON w.source = p.source "
                   f"AND w.start_ms + {slack} < p.t AND p.t < w.end_ms - {slack} GROUP BY p.source, p.id) m ON m.source = p.source AND m.id = p.id GROUP BY p.source, p.id)")
        last = this
    return ", ".join(out)


def cleared_sql(name, points):
    return (f"{name} AS (SELECT p.source, p.id, greatest(p.t, coalesce(any_value(h.want), p.t)) AS t FROM {points} p LEFT JOIN (SELECT p.source, p.id, arg_min(least(w.end_ms + 150, coalesce(w.next_ms - 50, w.end_ms + 150)), w.idx) AS want "
            f"FROM {points} p JOIN nexts w ON w.source = p.source AND w.logged_start < p.t AND p.t < w.logged_end AND p.t >= w.end_ms - 1 GROUP BY p.source, p.id) h ON h.source = p.source AND h.id = p.id GROUP BY p.source, p.id, p.t)")


NEXTS_SQL = "nexts AS (SELECT w.*, (SELECT min(x.start_ms) FROM spoken x WHERE x.source = w.source AND x.start_ms > w.end_ms + 1) AS next_ms FROM spoken w)"
STARTS_SQL, ENDS_SQL = "ps AS (SELECT source, id, a + 30 AS t FROM authored)", "pe AS (SELECT source, id, b AS t FROM authored)"


@query("edge_snap_forward", f"WITH {AUTHORED_SQL}, {STARTS_SQL}, {steps_sql('done', 'ps', 8, 10, 'w.end_ms + 50')} SELECT * FROM done")
def edge_snap_forward(spark, sf):
    _, words, cuts, _ = recordings(spark, sf)
    return ed.snapped(cuts.select("source", "id", (F.col("a") + 30).alias("t")), words, True)


@query("edge_snap_backward", f"WITH {AUTHORED_SQL}, {ENDS_SQL}, {steps_sql('done', 'pe', 8, 10, 'w.start_ms - 50')} SELECT * FROM done")
def edge_snap_backward(spark, sf):
    _, words, cuts, _ = recordings(spark, sf)
    return ed.snapped(cuts.select("source", "id", F.col("b").alias("t")), words, False)


@query("edge_clear_window", f"WITH {AUTHORED_SQL}, {NEXTS_SQL}, {ENDS_SQL}, {cleared_sql('done', 'pe')} SELECT * FROM done")
def edge_clear_window(spark, sf):
    _, words, cuts, _ = recordings(spark, sf)
    return ed.cleared(cuts.select("source", "id", F.col("b").alias("t")), words)


@query("edge_settle", f"WITH {AUTHORED_SQL}, {STARTS_SQL}, {steps_sql('done', 'ps', 4, 0, 'w.start_ms - 10')} SELECT * FROM done")
def edge_settle(spark, sf):
    _, words, cuts, _ = recordings(spark, sf)
    return ed.settled(cuts.select("source", "id", (F.col("a") + 30).alias("t")), words)


REFINE_SQL = f"""{BOTH_SQL}, {NEXTS_SQL},
hd AS (SELECT c.*, s.i, s.level FROM authored c JOIN spans USING (source) JOIN sound s ON s.source = c.source AND s.i >= greatest(c.a - 5000, 0) // 20 AND s.i < least(c.b + 5000, dur_ms) // 20),
ln AS (SELECT source, id, quantile_cont(level, 0.95) * pow(10, -14 / 20.0) AS line FROM hd GROUP BY source, id),
ld AS (SELECT h.source, h.id, max(CASE WHEN i * 20 <= a + 250 THEN i * 20 END) AS last, min(CASE WHEN i * 20 >= b - 250 THEN i * 20 END) AS first FROM hd h JOIN ln ON ln.source = h.source AND ln.id = h.id AND h.level > ln.line GROUP BY h.source, h.id),
ne AS (SELECT c.source, c.id, least(CASE WHEN refine_start THEN coalesce(last + 120, a) ELSE a END, b) AS na, greatest(CASE WHEN refine_end THEN coalesce(first - 120 - keep_tail, b) ELSE b END, a) AS nb,
  (SELECT max(w.end_ms) FROM spoken w WHERE w.source = c.source AND w.end_ms <= c.a + 10) AS fl FROM authored c LEFT JOIN ld ON ld.source = c.source AND ld.id = c.id),
nf AS (SELECT *, (SELECT min(w.start_ms) FROM spoken w WHERE w.source = ne.source AND w.start_ms >= ne.fl - 1) AS nx FROM ne),
ps AS (SELECT source, id, CASE WHEN fl IS NULL THEN na ELSE greatest(na, least(fl + 30, coalesce(nx - 5, fl + 30))) END AS t FROM nf),
pe AS (SELECT n.source, n.id, coalesce(any_value(m.t), n.nb) AS t FROM nf n LEFT JOIN (SELECT n.source, n.id, arg_min(w.start_ms - 10, w.idx) AS t FROM nf n JOIN spoken w ON w.source = n.source AND w.start_ms < n.nb AND n.nb < w.end_ms GROUP BY n.source, n.id) m ON m.source = n.source AND m.id = n.id GROUP BY n.source, n.id, n.nb),
{steps_sql('s1', 'ps', 8, 10, 'w.end_ms + 50')}, {cleared_sql('s2', 's1')}, {steps_sql('s3', 's2', 4, 0, 'w.start_ms - 10')},
{steps_sql('e1', 'pe', 8, 10, 'w.start_ms - 50')}, {cleared_sql('e2', 'e1')}, {steps_sql('e3', 'e2', 4, 0, 'w.start_ms - 10')},
fine AS (SELECT s3.source, s3.id, s3.t AS na, e3.t AS nb FROM s3 JOIN e3 ON e3.source = s3.source AND e3.id = s3.id)"""


@query("edge_refine", f"WITH {REFINE_SQL} SELECT * FROM fine")
def edge_refine(spark, sf):
    sound, words, cuts, spans = recordings(spark, sf)
    return ed.refined(cuts, sound, words, spans)


def placed_cuts(spark, sf):
    """Refined cuts; one that starts at 0 or ends within 50 ms of the end keeps that edge."""
    sound, words, cuts, spans = recordings(spark, sf)
    fine = cuts.join(ed.refined(cuts, sound, words, spans), ["source", "id"]).join(spans, "source")
    na = F.when(F.col("a") <= 0, 0).otherwise(F.col("na"))
    nb = F.when((F.col("a") > 0) & (F.col("b") >= F.col("dur_ms") - 50), F.col("dur_ms")).otherwise(F.col("nb"))
    return fine.select("source", na.alias("na"), nb.alias("nb"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("why")), words, spans


CUTS_DONE_SQL = f"""{REFINE_SQL},
cd AS (SELECT c.source, CASE WHEN a <= 0 THEN 0 ELSE na END AS na, CASE WHEN a > 0 AND b >= dur_ms - 50 THEN dur_ms ELSE nb END AS nb, 'c' || c.id AS why FROM authored c JOIN fine f ON f.source = c.source AND f.id = c.id JOIN spans ON spans.source = c.source),
c1 AS (SELECT *, max(nb) OVER (PARTITION BY source ORDER BY na, nb, why ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM cd WHERE nb - na >= 150),
c2 AS (SELECT *, sum(CASE WHEN reach IS NULL OR na >= reach - 1 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY na, nb, why ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM c1),
cm AS (SELECT source, min(na) AS na, max(nb) AS nb, string_agg(why, ' + ' ORDER BY na, nb, why) AS why FROM c2 GROUP BY source, g),
rw AS (SELECT source, na, nb, why FROM cm UNION ALL SELECT source, dur_ms, dur_ms, NULL FROM spans),
pc AS (SELECT source, coalesce(max(nb) OVER (PARTITION BY source ORDER BY na, nb ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_ms, na AS end_ms, why FROM rw),
kp AS (SELECT * FROM pc WHERE end_ms - start_ms > 50 AND NOT (why IS NOT NULL AND end_ms - start_ms < 100 AND NOT EXISTS (SELECT 1 FROM spoken w WHERE w.source = pc.source AND w.start_ms < pc.end_ms AND w.end_ms > pc.start_ms))),
rs AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY start_ms) - 1 AS seq, start_ms, end_ms, why FROM kp)"""


@query("ranges_from_cuts", f"WITH {CUTS_DONE_SQL} SELECT source, seq, start_ms, end_ms, printf('SEG-%02d', seq) AS label, CASE WHEN why IS NULL THEN 'tail' ELSE 'Resumes after cutting: ' || why END AS reason FROM rs")
def ranges_from_cuts(spark, sf):
    """From authored cuts to kept ranges: refined edges, short cuts passed over, overlaps joined, slivers dropped."""
    cuts, words, spans = placed_cuts(spark, sf)
    return ed.ranges_of(cuts, words, spans)


DECISIONS_SQL = f"{WORDS_SQL}, wn AS (SELECT source, count(*) AS n FROM words GROUP BY source), decisions AS (SELECT w.source, idx AS i, least(idx + 1 + length(text) % 3, n) AS j, 'd' || idx AS why FROM words w JOIN wn USING (source) WHERE length(text) >= 9 AND least(idx + 1 + length(text) % 3, n) - idx < n)"
WORD_CUTS_SQL = f"""{DECISIONS_SQL},
d1 AS (SELECT *, max(j) OVER (PARTITION BY source ORDER BY i, j, why ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM decisions),
d2 AS (SELECT *, sum(CASE WHEN reach IS NULL OR i > reach THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY i, j, why ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM d1),
dm AS (SELECT source, min(i) AS i, max(j) AS j, string_agg(why, ' | ' ORDER BY i, j, why) AS why FROM d2 GROUP BY source, g),
cx AS (SELECT *, lag(end_ms) OVER w AS pe, lead(start_ms) OVER w AS ns, coalesce(string_agg(text, ' ') OVER (PARTITION BY source ORDER BY idx ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), '') AS before,
  coalesce(string_agg(text, ' ') OVER (PARTITION BY source ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING), '') AS after FROM words WINDOW w AS (PARTITION BY source ORDER BY idx)),
ce AS (SELECT d.*, f.start_ms AS rs, f.pe, f.before, l.end_ms AS re, l.ns, l.after FROM dm d JOIN cx f ON f.source = d.source AND f.idx = d.i JOIN cx l ON l.source = d.source AND l.idx = d.j - 1),
cc AS (SELECT *, CAST(CASE WHEN pe IS NULL THEN 0 ELSE greatest(pe + least(30, (rs - pe) // 2), rs - 120) END AS BIGINT) AS a_ms,
  CAST(CASE WHEN pe IS NULL AND ns - 250 >= re + 10 THEN ns - 250 ELSE least(ns - least(30, (ns - re) // 2), re + 120) END AS BIGINT) AS b_ms0 FROM ce),
cf AS (SELECT *, CASE WHEN ns IS NULL THEN NULL ELSE b_ms0 END AS b_ms FROM cc)"""


def decisions(words):
    """words with j and why, null where no decision begins."""
    total = F.count(F.lit(1)).over(Window.partitionBy("source").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    d = words.withColumn("n", total).withColumn("j", F.least(F.col("idx") + 1 + F.length("text") % 3, F.col("n")))
    made = (F.length("text") >= 9) & (F.col("j") - F.col("idx") < F.col("n"))
    return d.withColumns({"j": F.when(made, F.col("j")), "why": F.when(made, F.concat(F.lit("d"), F.col("idx").cast("string")))}).drop("n")


@query("edge_from_words", f"""WITH {WORD_CUTS_SQL}, dr AS (SELECT c.source, c.i, string_agg(w.text, ' ' ORDER BY w.idx) AS dropped FROM cf c JOIN words w ON w.source = c.source AND w.idx >= c.i AND w.idx < c.j GROUP BY c.source, c.i)
SELECT c.source, c.i, c.j, c.why, a_ms, b_ms, before, dropped, after, coalesce(b_ms - a_ms < 50, false) AS collapsed FROM cf c JOIN dr ON dr.source = c.source AND dr.i = c.i""")
def edge_from_words(spark, sf):
    """Decisions (long words, with up to two after them) as cuts between words, with the words before, dropped and after."""
    return ed.word_cuts(decisions(fx.words(spark, sf)))


@query("decision_refusals", f"""WITH {WORDS_SQL}, wn AS (SELECT source, count(*) AS n FROM words GROUP BY source),
rd AS (SELECT source, n - k AS i, n - k + k % 3 AS j, CASE WHEN n % 5 = 0 THEN 'accuracy_flag' ELSE 'cut' END AS kind, n FROM wn, range(0, 3) r(k) UNION ALL SELECT source, 0, n, 'cut', n FROM wn)
SELECT source, i, j, CASE WHEN kind = 'accuracy_flag' THEN 'a flag, not a cut' WHEN i >= n THEN 'past the last word' WHEN j <= i THEN 'keep is not after rm' ELSE 'removes every word' END AS refused FROM rd WHERE kind = 'accuracy_flag' OR i >= n OR j <= i OR (i = 0 AND j >= n)""")
def decision_refusals(spark, sf):
    words = fx.words(spark, sf)
    total = words.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    kind = F.when(F.col("n") % 5 == 0, "accuracy_flag").otherwise("cut").alias("kind")
    tails = total.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long")))).select("source", (F.col("n") - F.col("k")).alias("i"), (F.col("n") - F.col("k") + F.col("k") % 3).alias("j"), kind)
    whole = total.select("source", F.lit(0).cast("long").alias("i"), F.col("n").alias("j"), F.lit("cut").alias("kind"))
    return ed.refusals(tails.unionByName(whole), words)


FLOOR_SQL = "fl AS (SELECT source, greatest(quantile_cont(level, 0.9) * 0.1, quantile_cont(level, 0.2) * pow(10, 0.5)) AS floor FROM sound GROUP BY source)"


@query("audible_at", f"""WITH {AUTHORED_SQL}, {ENDS_SQL}, f90 AS (SELECT source, quantile_cont(level, 0.9) * pow(10, -20 / 20.0) AS floor FROM sound GROUP BY source),
r AS (SELECT p.source, p.id, sqrt(avg(level * level)) AS rms FROM pe p JOIN sound s ON s.source = p.source AND s.i >= greatest(p.t - 60, 0) // 20 AND s.i < (p.t + 60) // 20 GROUP BY p.source, p.id)
SELECT p.source, p.id, p.t, coalesce(rms > floor, true) AS audible FROM pe p LEFT JOIN r ON r.source = p.source AND r.id = p.id LEFT JOIN f90 ON f90.source = p.source""")
def audible_at(spark, sf):
    """Whether the ends of cuts can be heard, against 20 dB under each source's 90th percentile."""
    sound, _, cuts, _ = recordings(spark, sf)
    floor = sound.groupBy("source").agg((F.percentile("level", F.lit(0.9)) * 10 ** (-20 / 20)).alias("floor"))
    return ed.audible(cuts.select("source", "id", F.col("b").alias("t")), sound, floor)


DELIVERED_SQL = f"""{SPOKEN_SQL}, {KEPT_SQL},
kq AS (SELECT *, CAST(ceil(round_even((end_ms - start_ms) * 25.0 / 1000.0, 6)) AS BIGINT) * 40 AS q FROM kept),
ko AS (SELECT *, CAST(coalesce(sum(q) OVER (PARTITION BY source ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS out_ms FROM kq),
dv AS (SELECT w.*, k.start_ms AS r0, w.start_ms - k.start_ms + k.out_ms AS out_start, w.end_ms - k.start_ms + k.out_ms AS out_end FROM spoken w JOIN ko k ON k.source = w.source AND w.start_ms >= k.start_ms AND w.end_ms <= k.end_ms),
clock AS (SELECT source, CAST(sum(q) AS BIGINT) AS clock FROM kq GROUP BY source),
gp AS (SELECT source, coalesce(lag(out_end) OVER w, 0) AS at_ms, out_start AS to_ms, coalesce(lag(text) OVER w, '(start)') AS before, text AS after, lag(end_ms) OVER w AS sa, start_ms AS sb FROM dv WINDOW w AS (PARTITION BY source ORDER BY out_start, out_end)
  UNION ALL SELECT d.source, d.out_end, clock, d.text, '(end)', d.end_ms, NULL FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY out_start DESC, out_end DESC) AS r FROM dv) d JOIN clock USING (source) WHERE r = 1),
gaps AS (SELECT source, at_ms, to_ms - at_ms AS gap_ms, before, after, sa, sb FROM gp WHERE to_ms - at_ms > 2500)"""


def delivered_gaps_of(spark, sf):
    sound = fx.sound(spark, sf)
    return pz.wordless(fx.spoken(sound), fx.kept_ranges(sound))


@query("delivered_gaps", f"WITH {DELIVERED_SQL} SELECT source, at_ms, gap_ms, before, after, sa, sb FROM gaps")
def delivered_gaps(spark, sf):
    """Gaps over 2.5 s on the delivered timeline, lead-in and tail included."""
    return delivered_gaps_of(spark, sf)


@query("gap_cuts_emit", f"""WITH {DELIVERED_SQL}, k AS (SELECT *, (sa + sb - 2080) // 2 AS ks FROM gaps WHERE sb - sa > 2500),
e AS (SELECT source, gap_ms, 'head' AS part, sa + 100 AS start_ms, ks AS end_ms FROM k UNION ALL SELECT source, gap_ms, 'tail', ks + 2080, sb - 100 FROM k) SELECT * FROM e WHERE end_ms - start_ms > 100""")
def gap_cuts_emit(spark, sf):
    """What to cut before and after the middle that stays of each gap over the ceiling."""
    return pz.gap_cuts(delivered_gaps_of(spark, sf))


COVERED_SQL = """cv AS (SELECT DISTINCT w.source, unnest(range(greatest(w.start_ms - 100, 0) // 20, (greatest(w.end_ms, w.logged_end) + CASE WHEN d.idx IS NULL THEN 800 ELSE 100 END) // 20 + 1)) AS i FROM spoken w LEFT JOIN (SELECT DISTINCT source, idx FROM dv) d ON d.source = w.source AND d.idx = w.idx)"""


@query("kept_dependent_cover", f"WITH {DELIVERED_SQL}, {COVERED_SQL} SELECT * FROM cv")
def kept_dependent_cover(spark, sf):
    """Frames that words account for: kept words with a short pad, removed ones with the time they ring."""
    sound = fx.sound(spark, sf)
    words = fx.spoken(sound)
    return pz.covered_frames(words, pz.delivered(words, fx.kept_ranges(sound)))


PROTECT_SQL = "protect AS (SELECT source, k * 20000 + 500 AS start_ms, k * 20000 + 1500 AS end_ms FROM (SELECT source, unnest(range(0, hi // 20000 + 1)) AS k FROM ke))"
MOVES_SQL = "moves AS (SELECT source, i // 50 AS sec, CAST(sum(CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n FROM sound GROUP BY source, i // 50)"
TIGHT_SQL = f"""{DELIVERED_SQL}, {COVERED_SQL}, {PROTECT_SQL}, {MOVES_SQL}, {FLOOR_SQL},
tg AS (SELECT source, end_ms AS a, lead(start_ms) OVER (PARTITION BY source ORDER BY start_ms, end_ms) AS b FROM dv QUALIFY b IS NOT NULL),
ti AS (SELECT g.source, a, b, greatest(a, k.start_ms) AS x, least(b, k.end_ms) AS y FROM tg g JOIN kept k ON k.source = g.source AND least(b, k.end_ms) - greatest(a, k.start_ms) > 1),
td AS (SELECT source, a, b, CAST(sum(y - x) AS BIGINT) AS delivered_ms, arg_max(x, (y - x) * 100000000 - x) AS g0, arg_max(y, (y - x) * 100000000 - x) AS g1 FROM ti GROUP BY source, a, b HAVING sum(y - x) >= 750),
tp AS (SELECT * FROM td WHERE NOT EXISTS (SELECT 1 FROM protect p WHERE p.source = td.source AND td.a < p.end_ms AND p.start_ms < td.b)),
tw AS (SELECT source, a, arg_max(s, n * 1000000 - s) AS s FROM (SELECT w.source, w.a, w.s, coalesce(m.n, 0) AS n FROM (SELECT source, a, g0, unnest(range(0, greatest(1, CAST(round_even((g1 - g0) / 1000.0, 0) AS BIGINT)))) AS s FROM tp WHERE delivered_ms >= 4000 AND g1 - g0 > 1200) w LEFT JOIN moves m ON m.source = w.source AND m.sec = (w.g0 + w.s * 1000) // 1000) GROUP BY source, a),
tk AS (SELECT t.*, CASE WHEN delivered_ms >= 4000 THEN g0 + coalesce(s, 0) * 1000 ELSE greatest(g0, (g0 + g1 - 400) // 2) END AS k0, CASE WHEN delivered_ms >= 4000 THEN 1200 ELSE 400 END AS target FROM tp t LEFT JOIN tw ON tw.source = t.source AND tw.a = t.a),
ts AS (SELECT i.source, i.a, i.b, k.delivered_ms, x, y, k0, least(g1, k0 + target) AS k1 FROM ti i JOIN tk k ON k.source = i.source AND k.a = i.a),
tc AS (SELECT source, a, b, delivered_ms, x AS lo, y AS hi FROM ts WHERE NOT (x < k1 AND k0 < y) UNION ALL SELECT source, a, b, delivered_ms, x, least(y, k0) FROM ts WHERE x < k1 AND k0 < y AND x < k0 UNION ALL SELECT source, a, b, delivered_ms, greatest(x, k1), y FROM ts WHERE x < k1 AND k0 < y AND y > k1),
te AS (SELECT source, a, b, delivered_ms, CASE WHEN lo = a THEN lo + 60 ELSE lo END AS lo, CASE WHEN hi = b THEN hi - 60 ELSE hi END AS hi FROM tc),
tf AS (SELECT * FROM te WHERE hi - lo >= 200),
qt AS (SELECT q.source, i FROM (SELECT source, i, max(level) OVER (PARTITION BY source ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near FROM sound) q JOIN fl USING (source) WHERE near < floor * pow(10, -6 / 20.0)),
tm AS (SELECT f.source, f.lo, f.hi, unnest(range(-((b - a) // 20), (b - a) // 20 + 1)) AS k, a, b FROM tf f),
tl AS (SELECT t.source, t.lo, arg_min(t.lo + k * 20, abs(k) * 2 + CASE WHEN k > 0 THEN 1 ELSE 0 END) AS nlo FROM tm t JOIN qt ON qt.source = t.source AND qt.i = (t.lo + k * 20) // 20 WHERE k = 0 OR t.lo + k * 20 BETWEEN a AND b GROUP BY t.source, t.lo),
th AS (SELECT t.source, t.lo, arg_min(t.hi + k * 20, abs(k) * 2 + CASE WHEN k > 0 THEN 1 ELSE 0 END) AS nhi FROM tm t JOIN qt ON qt.source = t.source AND qt.i = (t.hi + k * 20) // 20 WHERE k = 0 OR t.hi + k * 20 BETWEEN a AND b GROUP BY t.source, t.lo),
tn AS (SELECT f.*, nlo, nhi, coalesce(nhi - nlo >= 200, false) AS good FROM tf f LEFT JOIN tl ON tl.source = f.source AND tl.lo = f.lo LEFT JOIN th ON th.source = f.source AND th.lo = f.lo),
lf AS (SELECT s.source, s.i, CASE WHEN level > floor * pow(10, 6 / 20.0) AND cv.i IS NULL THEN 1 ELSE 0 END AS loud FROM sound s JOIN fl USING (source) LEFT JOIN cv ON cv.source = s.source AND cv.i = s.i),
lw AS (SELECT *, sum(loud) OVER (PARTITION BY source ORDER BY i ROWS BETWEEN CURRENT ROW AND 24 FOLLOWING) AS dense FROM lf),
sp AS (SELECT n.source, n.lo, CASE WHEN any_value(nhi // 20 - nlo // 20) <= 25 THEN sum(loud) ELSE max(CASE WHEN l.i <= nhi // 20 - 25 THEN dense END) END AS most FROM tn n JOIN lw l ON l.source = n.source AND l.i >= nlo // 20 AND l.i < nhi // 20 WHERE good GROUP BY n.source, n.lo),
tight AS (SELECT n.source, a AS gap_start, CASE WHEN good THEN nlo ELSE n.lo END AS start_ms, CASE WHEN good THEN nhi ELSE n.hi END AS end_ms, delivered_ms, CASE WHEN delivered_ms >= 4000 THEN 'wait' ELSE 'short' END AS kind,
  CASE WHEN NOT good THEN 'dropped' WHEN coalesce(most, 0) >= 10 THEN 'held' ELSE 'cut' END AS verdict FROM tn n LEFT JOIN sp ON sp.source = n.source AND sp.lo = n.lo)"""


def gap_pieces(spark, sf):
    sound = kept(fx.sound(spark, sf), "sound")
    words, ranges = kept(fx.spoken(sound), "words"), fx.kept_ranges(sound)
    ends = sound.groupBy("source").agg(((F.max("i") + 1) * 20).alias("hi"))
    k = ends.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("hi") / 20000))))
    protect = k.select("source", (F.col("k") * 20000 + 500).alias("start_ms"), (F.col("k") * 20000 + 1500).alias("end_ms"))
    moves = sound.groupBy("source", F.floor(F.col("i") / 50).alias("sec")).agg(F.sum(F.when(F.col("k") % 5 == 0, 1).otherwise(0)).cast("long").alias("n"))
    return pz.tightened(words, ranges, sound, protect, moves)


@query("gap_tightening", f"WITH {TIGHT_SQL} SELECT * FROM tight")
def gap_tightening(spark, sf):
    """Every wordless gap of 0.75 s and more, measured across joins: what is cut, what is dropped, what holds speech."""
    return gap_pieces(spark, sf)


SPEECH_SQL = "spc AS (SELECT source, k * 1700 AS start_ms, k * 1700 + 90 AS end_ms FROM (SELECT source, unnest(range(0, hi // 1700 + 1)) AS k FROM ke))"


@query("pause_cuts", f"""WITH {TIGHT_SQL}, {SPEECH_SQL}, ct AS (SELECT * FROM tight WHERE verdict = 'cut'),
xs AS (SELECT c.source, c.start_ms AS l0, c.kind, greatest(c.start_ms, s.start_ms) AS a, least(c.end_ms, s.end_ms) AS b FROM ct c JOIN spc s ON s.source = c.source AND c.start_ms < s.end_ms AND s.start_ms < c.end_ms UNION ALL SELECT source, start_ms, kind, end_ms, end_ms FROM ct),
xp AS (SELECT source, kind, coalesce(lag(b) OVER (PARTITION BY source, l0 ORDER BY a, b), l0) AS start_ms, a AS end_ms FROM xs),
xo AS (SELECT * FROM xp WHERE end_ms - start_ms >= 200),
xm AS (SELECT *, max(end_ms) OVER (PARTITION BY source ORDER BY start_ms, end_ms, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM xo),
xg AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_ms - reach >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY start_ms, end_ms, kind ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM xm)
SELECT source, min(start_ms) AS start_ms, max(end_ms) AS end_ms, arg_min(kind, start_ms) AS why FROM xg GROUP BY source, g""")
def pause_cuts(spark, sf):
    """The pause cuts without what speech cuts (90 ms of each 1.7 s here) declare already."""
    pieces = kept(gap_pieces(spark, sf), "pieces")
    ends = fx.sound(spark, sf).groupBy("source").agg(((F.max("i") + 1) * 20).alias("hi"))
    k = ends.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("hi") / 1700))))
    return pz.pause_cuts(pieces, k.select("source", (F.col("k") * 1700).alias("start_ms"), (F.col("k") * 1700 + 90).alias("end_ms")))


WAITS_SQL = "wc AS (SELECT * FROM (SELECT source, end_ms + (seq % 3) * 12 AS start_ms, lead(start_ms) OVER (PARTITION BY source ORDER BY seq) - (seq % 2) * 15 AS end_ms FROM kept) WHERE end_ms IS NOT NULL)"


@query("wait_beats", f"""WITH {SPOKEN_SQL}, {KEPT_SQL}, {WAITS_SQL}, kx AS (SELECT *, lag(end_ms) OVER w AS pe, lead(start_ms) OVER w AS ns FROM kept WINDOW w AS (PARTITION BY source ORDER BY seq))
SELECT source, seq, coalesce(pe - 300, start_ms) AS prev_ms, (start_ms + end_ms) // 2 AS mid_ms, coalesce(ns + 300, end_ms) AS next_ms FROM kx k
WHERE EXISTS (SELECT 1 FROM wc w WHERE w.source = k.source AND abs(w.end_ms - k.start_ms) < 20) AND EXISTS (SELECT 1 FROM wc w WHERE w.source = k.source AND abs(w.start_ms - k.end_ms) < 20)""")
def wait_beats(spark, sf):
    """Kept ranges between two wait cuts (here what lies between ranges, up to 24 ms off)."""
    from pyspark.sql import Window

    ranges = fx.kept_ranges(fx.sound(spark, sf))
    after = F.lead("start_ms").over(Window.partitionBy("source").orderBy("seq"))
    waits = ranges.select("source", (F.col("end_ms") + F.col("seq") % 3 * 12).alias("start_ms"), (after - F.col("seq") % 2 * 15).alias("end_ms"))
    return pz.wait_beats(ranges, waits.where("end_ms IS NOT NULL"))


SILENT_SQL = f"""{SPOKEN_SQL}, {KEPT_SQL}, kf AS (SELECT *, start_ms // 20 AS i0, end_ms // 20 AS i1 FROM kept), kn AS (SELECT *, CAST(coalesce(sum(i1 - i0) OVER (PARTITION BY source ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS o0 FROM kf),
sf AS (SELECT k.source, k.seq, s.i, k.o0 + s.i - k.i0 AS o FROM kn k JOIN sound s ON s.source = k.source AND s.i >= k.i0 AND s.i < k.i1 WHERE s.level <= 0.01),
sg AS (SELECT *, o - row_number() OVER (PARTITION BY source ORDER BY o) AS g FROM sf),
sil AS (SELECT source, min(o) * 20 AS out_ms, count(*) * 20 AS length_ms, arg_min(i, o) * 20 AS from_ms, (arg_max(i, o) + 1) * 20 AS to_ms, min(seq) = max(seq) AS one_range FROM sg GROUP BY source, g HAVING count(*) * 20 >= {{0}})"""


@query("delivered_silence", f"WITH {SILENT_SQL.format(700)} SELECT *, length_ms > 750 + 150 AS over FROM sil")
def delivered_silence(spark, sf):
    """Silent runs on the assembled signal; floor and ceiling are 0.7 s and 0.75 s, as the recordings are short."""
    sound = fx.sound(spark, sf)
    return pz.delivered_silence(sound, fx.kept_ranges(sound), 0.01, 700, 750)


EXCESS_SQL = f"""{SILENT_SQL.format(500)},
ex AS (SELECT source, out_ms, length_ms, bar_ms, length_ms - bar_ms + 250 AS excess FROM (SELECT source, out_ms, length_ms, CASE WHEN out_ms % 80 = 0 THEN 400 ELSE 500 END AS bar_ms FROM sil) WHERE length_ms > bar_ms + 100),
kr AS (SELECT *, CAST(coalesce(sum(end_ms - start_ms) OVER (PARTITION BY source ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS o0 FROM kept),
sgm AS (SELECT e.source, e.out_ms, greatest(e.out_ms, k.o0) AS o, greatest(e.out_ms, k.o0) - k.o0 + k.start_ms AS s, least(e.out_ms + e.length_ms, k.o0 + k.end_ms - k.start_ms) - k.o0 + k.start_ms AS e FROM ex e JOIN kr k ON k.source = e.source AND greatest(e.out_ms, k.o0) < least(e.out_ms + e.length_ms, k.o0 + k.end_ms - k.start_ms)),
wp AS (SELECT g.source, g.out_ms, g.o, g.s, g.s AS s0, greatest(w.start_ms - 40, g.s) AS a, least(w.end_ms + 40, g.e) AS b FROM sgm g JOIN spoken w ON w.source = g.source AND w.start_ms - 40 < g.e AND w.end_ms + 40 > g.s UNION ALL SELECT source, out_ms, o, s, s, e, e FROM sgm),
wf AS (SELECT source, out_ms, o, s, coalesce(max(b) OVER (PARTITION BY source, out_ms, s ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), s) AS a, a AS b FROM wp),
wl AS (SELECT source, out_ms, max(b - a) AS n, arg_max(a, (b - a) * 100000000 - (o + a - s)) AS a FROM wf WHERE b > a GROUP BY source, out_ms),
we AS (SELECT ex.*, wl.n, wl.a, CASE WHEN wl.n <= excess + 100 THEN wl.n ELSE excess END AS cut_ms FROM ex LEFT JOIN wl ON wl.source = ex.source AND wl.out_ms = ex.out_ms),
wv AS (SELECT *, CASE WHEN cut_ms IS NULL OR cut_ms < 80 THEN 'not cut' WHEN cut_ms < excess - 100 THEN 'partial' ELSE 'cut' END AS verdict FROM we)"""


@query("silence_excess", f"WITH {EXCESS_SQL} SELECT source, out_ms, length_ms, bar_ms, verdict, CASE WHEN verdict <> 'not cut' THEN a END AS start_ms, CASE WHEN verdict <> 'not cut' THEN a + cut_ms END AS end_ms FROM wv")
def silence_excess(spark, sf):
    """What to cut out of silent windows that are over their bar (0.4 s for some, 0.5 s for the others)."""
    sound = fx.sound(spark, sf)
    ranges = fx.kept_ranges(sound)
    windows = pz.delivered_silence(sound, ranges, 0.01, 500, 500).select("source", "out_ms", "length_ms", F.when(F.col("out_ms") % 80 == 0, 400).otherwise(500).cast("long").alias("bar_ms"))
    return pz.excess_cuts(windows, ranges, fx.spoken(sound))
