"""Queries of the delivery gate: accepted findings, media checks, caption checks, reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomline.functions import captions as cp
from loomline.functions import text as tx
from loomline.operators import accepts as ac
from loomline.operators import pauses as pz
from loomline.operators import sequences as sq
from loomline.plans.registry import query
from loomline.plans.text import GATE_SQL, NORM_WORDS, PAUSE_SQL, RUN_CASES
from loomline.sources import fixtures as fx
from loomline.sources.fixtures import SPOKEN_SQL, WORDS_SQL
from loomline.sources.store import kept

# ---- accepted findings. The lists hold what was found in some sources: a ruling there holds everywhere. ----

PAIR_SQL = f"{NORM_WORDS}, pr AS (SELECT source, idx, text, lag(text) OVER w AS pt, norm, lag(norm) OVER w AS pn FROM nw WINDOW w AS (PARTITION BY source ORDER BY idx)), pf AS (SELECT source, idx, pt || ' ' || text AS pair FROM pr WHERE norm = pn AND length(norm) > 2)"


def pairs(words):
    w = sq.by_source()
    p = words.withColumns({"pt": F.lag("text").over(w), "pn": F.lag("norm").over(w)}).where((F.col("norm") == F.col("pn")) & (F.length("norm") > 2))
    return p.select("source", "idx", F.concat_ws(" ", "pt", "text").alias("pair"))


def accepted(findings, column):
    return findings.where("source % 3 = 0").select(F.col(column).alias("phrase"), F.lit("a ruling").alias("reason"))


@query("accepted_findings_removed", f"WITH {PAIR_SQL} SELECT source, idx, pair FROM pf WHERE pair NOT IN (SELECT pair FROM pf WHERE source % 3 = 0)")
def accepted_findings_removed(spark, sf):
    """Doubled words whose pair, as it stands, isn't on the accept list."""
    found = pairs(sq.with_norm(fx.words(spark, sf)))
    return ac.not_listed(found, accepted(found, "pair"), "pair")


TRUNC_SQL = f"{WORDS_SQL}, tr AS (SELECT source, idx, text FROM words WHERE contains(text, '--') OR suffix(text, '-'))"


@query("truncated_tokens", f"WITH {TRUNC_SQL} SELECT source, idx, text FROM tr WHERE text NOT IN (SELECT text FROM tr WHERE source % 3 = 0)")
def truncated_tokens(spark, sf):
    """Words broken off with a dash, but for accepted ones."""
    t = F.col("text")
    found = fx.words(spark, sf).where(t.contains("--") | t.endswith("-")).select("source", "idx", "text")
    return ac.not_listed(found, accepted(found, "text"), "text")


GRAM_SQL = f"""{NORM_WORDS}, {GATE_SQL}, ha AS ({' UNION ALL '.join(f'SELECT * FROM hits{n}' for n, _ in sq.GATE)}),
gl AS (SELECT source, idx, [norm, lead(norm) OVER w, lead(norm, 2) OVER w, lead(norm, 3) OVER w, lead(norm, 4) OVER w, lead(norm, 5) OVER w] AS six FROM nw WINDOW w AS (PARTITION BY source ORDER BY idx)),
hg AS (SELECT h.source, h.idx, h.n, array_to_string(six[1:h.n], ' ') AS gram FROM ha h JOIN gl USING (source, idx)),
ag AS (SELECT DISTINCT array_to_string(string_split(gram, ' ')[1:least(n, 2 + source % 5)], ' ') AS g FROM hg WHERE source % 9 = 0)"""


@query("accepted_gram_prefix", f"""WITH {GRAM_SQL}, bad AS (SELECT DISTINCT h.source, h.idx, h.n FROM hg h JOIN (SELECT DISTINCT gram FROM hg) u USING (gram) WHERE gram IN (SELECT u2.gram FROM (SELECT DISTINCT gram FROM hg) u2 JOIN ag ON u2.gram = ag.g OR starts_with(u2.gram, ag.g || ' ') OR starts_with(ag.g, u2.gram || ' ')))
SELECT source, idx, n, gram FROM hg WHERE (source, idx, n) NOT IN (SELECT (source, idx, n) FROM bad)""")
def accepted_gram_prefix(spark, sf):
    """Repeated runs of which no accepted phrase is a beginning, nor the other way round. The runs are written once: the list
    and both ways of the comparison read them."""
    hits = kept(gram_hits(spark, sf), "grams")
    listed = hits.where("source % 9 = 0").select(F.array_join(F.slice("gram", F.lit(1), F.least(F.col("n"), 2 + F.col("source") % 5).cast("int")), " ").alias("phrase"), F.lit("a ruling").alias("reason"))
    return ac.gram_not_listed(hits, listed, "gram").withColumn("gram", F.array_join("gram", " "))


def gram_hits(spark, sf):
    hits = sq.gate_repeats(sq.with_norm(fx.words(spark, sf))).select("source", "idx", "n")
    return sq.with_grams(hits, fx.texts(spark, sf))


@query("accepted_run", f"""WITH {PAUSE_SQL}, e AS (SELECT source, idx, l, CAST(CASE {RUN_CASES} ELSE 0 END AS BIGINT) AS n FROM pause), f AS (SELECT source, idx, array_to_string(l[-n:], ' ') AS run FROM e WHERE n > 0)
SELECT source, idx, run FROM f WHERE run NOT IN (SELECT run FROM f WHERE source % 3 = 0)""")
def accepted_run(spark, sf):
    """Restarts whose repeated run isn't exactly an accepted phrase."""
    p = sq.around_pause(sq.with_norm(fx.words(spark, sf)), 800, 10, 10).withColumn("n", sq.run_restart(F.col("left"), F.col("right"))).where("n > 0")
    found = p.select("source", "idx", F.slice("left", -F.col("n").cast("int"), F.col("n").cast("int")).alias("run"))
    listed = found.where("source % 3 = 0").select(F.array_join("run", " ").alias("phrase"), F.lit("a ruling").alias("reason"))
    return ac.run_not_listed(found, listed, "run").withColumn("run", F.array_join("run", " "))


EDGES = ("left", "right", "top", "bottom")


@query("accepted_edge", """WITH f AS (SELECT vec_id, label, ['left', 'right', 'top', 'bottom'][vec_id % 4 + 1] AS edge FROM embeddings)
SELECT vec_id, label, edge FROM f WHERE 'black bar on ' || edge || ' edge' NOT IN ('black bar on left edge', 'black bar on bottom edge')""")
def accepted_edge(spark, sf):
    """Black bars by edge; an accept counts if it is exactly that edge's phrase."""
    edge = F.element_at(F.array(*map(F.lit, EDGES)), (F.col("vec_id") % 4 + 1).cast("int"))
    found = fx.table(spark, sf, "embeddings").select("vec_id", "label", edge.alias("edge"))
    listed = spark.createDataFrame([("black bar on left edge", "a ruling"), (" black bar on bottom edge ", "a ruling"), ("bar on top edge", "too short")], "phrase string, reason string")
    keyed = found.withColumn("_text", F.concat(F.lit("black bar on "), "edge", F.lit(" edge")))
    return keyed.join(ac.checked(listed).select(F.trim("phrase").alias("_text")), "_text", "left_anti").drop("_text")


#: Words that carry no content, in the language of the tables.
STOPWORDS = ("the", "of", "and", "on", "is", "in", "to", "der", "die", "und", "de", "la", "le", "el")


@query("restart_lcs", f"""WITH {PAUSE_SQL}, st AS (SELECT source, idx, list_filter(l[greatest(1, len(l) - 5):], lambda x: x <> '' AND NOT list_contains({list(STOPWORDS)}, x)) AS a, list_filter(r[1:6], lambda x: x <> '' AND NOT list_contains({list(STOPWORDS)}, x)) AS b FROM pause),
m AS (SELECT s.source, s.idx, x.i, y.j FROM st s, unnest(range(1, len(a) + 1)) x(i), unnest(range(1, len(b) + 1)) y(j) WHERE a[x.i] = b[y.j])
SELECT DISTINCT p.source, p.idx FROM m p JOIN m q ON p.source = q.source AND p.idx = q.idx AND p.i < q.i AND p.j < q.j JOIN m t ON t.source = q.source AND t.idx = q.idx AND q.i < t.i AND q.j < t.j""")
def restart_lcs(spark, sf):
    """Three content words or more of the last six before a pause come again in the same order among the first six after it."""
    p = sq.around_pause(sq.with_norm(fx.words(spark, sf)), 800, 10, 10)
    content = lambda c: F.filter(c, lambda x: (x != "") & ~x.isin(*STOPWORDS))
    last = F.slice("left", F.greatest(F.lit(1), F.size("left") - 5), F.lit(6))
    both = p.select("source", "idx", content(last).alias("l"), content(F.slice("right", 1, 6)).alias("r")).where("size(l) >= 3 AND size(r) >= 3")
    return both.withColumn("n", sq.common_order_udf("l", "r")).where("n >= 3").select("source", "idx")


# ---- media: what a probe says of each delivered file, made up from the orders ----

MEDIA_SQL = """media AS (SELECT o_orderkey AS file, 1920 + o_custkey % 3 * 960 AS width, CASE WHEN o_orderkey % 11 = 0 THEN 3840 ELSE 1080 END AS height, o_totalprice / 1000 AS video_s, o_totalprice / 1000 + (o_custkey % 13 - 6) * 0.125 AS audio_s,
  CAST(o_orderkey % 90 - 60 AS DOUBLE) AS lead_ms, -14.0 + (o_custkey % 9 - 4) * 0.75 AS loudness, -1.0 + o_custkey % 5 * 0.5 AS peak, 1920 + o_custkey % 2 * 1920 AS source_width, 1080 AS source_height,
  o_totalprice / 1000 + (o_orderkey % 7 - 3) * 0.75 AS expected_s, o_orderkey % 200 AS n_ranges, 30.0 AS fps, CASE o_orderkey % 4 WHEN 0 THEN 'smpte2084' WHEN 1 THEN 'arib-std-b67' ELSE 'bt709' END AS transfer FROM orders)"""


def media(spark, sf):
    o, key, cust, price = fx.table(spark, sf, "orders"), F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice") / 1000
    return o.select(key.alias("file"), (1920 + cust % 3 * 960).alias("width"), F.when(key % 11 == 0, 3840).otherwise(1080).alias("height"), price.alias("video_s"), (price + (cust % 13 - 6) * 0.125).alias("audio_s"),
                    (key % 90 - 60).cast("double").alias("lead_ms"), (F.lit(-14.0) + (cust % 9 - 4) * 0.75).alias("loudness"), (F.lit(-1.0) + cust % 5 * 0.5).alias("peak"), (1920 + cust % 2 * 1920).alias("source_width"),
                    F.lit(1080).alias("source_height"), (price + (key % 7 - 3) * 0.75).alias("expected_s"), (key % 200).alias("n_ranges"), F.lit(30.0).alias("fps"),
                    F.when(key % 4 == 0, "smpte2084").when(key % 4 == 1, "arib-std-b67").otherwise("bt709").alias("transfer"))


#: What each delivered file must hold to, and what is said where it doesn't.
MEDIA_RULES = {
    "audio and video durations disagree": "abs(audio_s - video_s) > 0.5",
    "audio leads video": "lead_ms > 20.0",
    "audio trails video": "lead_ms < -45.0",
    "loudness outside the band": "NOT (loudness >= -16.5 AND loudness <= -11.5)",
    "true peak is clipping": "peak > 0.5",
    "smaller than its source": "width < source_width OR height < source_height",
    "duration differs from the edit": "abs(video_s - expected_s) > greatest(1.5, n_ranges / greatest(fps, 1.0))",
}


@query("stream_checks", f"WITH {MEDIA_SQL} " + " UNION ALL ".join(f"SELECT file, '{k}' AS failed FROM media WHERE {v}" for k, v in MEDIA_RULES.items()))
def stream_checks(spark, sf):
    from loomline.operators.gates import findings

    return findings(media(spark, sf), MEDIA_RULES, ["file"])


@query("hdr_portrait", f"WITH {MEDIA_SQL} SELECT file, transfer IN ('smpte2084', 'arib-std-b67') AS hdr, height > width AS portrait FROM media")
def hdr_portrait(spark, sf):
    return media(spark, sf).select("file", F.col("transfer").isin("smpte2084", "arib-std-b67").alias("hdr"), (F.col("height") > F.col("width")).alias("portrait"))


# ---- captions: the lines of a document are its cues, two seconds apart, long ones running into the next ----

CUE_SQL = f"""cu0 AS (SELECT doc_id, i - 1 AS n, ls[i] AS text FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
cue AS (SELECT doc_id, n, text, n * 2000 AS start_ms, n * 2000 + length(text) * 20 AS end_ms, lead(n * 2000) OVER (PARTITION BY doc_id ORDER BY n) AS next_ms FROM cu0)"""
RTL = cp.rtl_class()
CUE_RULES = {
    "double dash": "contains(text, '--')",
    "lone letter": "regexp_matches(text, '(^|[ \\t])[ء-هىي]([ \\t]|$)')",
    "trailing mark": "regexp_matches(text, '[،,:;][ \\t]*$')",
    "stranded mark": "regexp_matches(text, '(^|[ \\t])[،,;:.!؟?…-]+([ \\t]|$)')",
    "not embedded": f"regexp_matches(text, '[{RTL}]') AND NOT (starts_with(text, '{cp.EMBED}') AND ends_with(text, '{cp.POP}'))",
    "embedded for nothing": f"NOT regexp_matches(text, '[{RTL}]') AND (contains(text, '{cp.EMBED}') OR contains(text, '{cp.POP}'))",
    "no duration": "end_ms <= start_ms",
    "overlaps the next": "end_ms > next_ms + 1",
    "too many lines": "length(text) > 46",
}


@query("caption_checks", f"WITH {CUE_SQL} " + " UNION ALL ".join(f"SELECT doc_id, n, '{k}' AS failed FROM cue WHERE {v}" for k, v in CUE_RULES.items()))
def caption_checks(spark, sf):
    from loomline.operators.gates import findings

    lines = fx.table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "text")).withColumn("n", F.col("n").cast("long"))
    timed = lines.withColumns({"start_ms": F.col("n") * 2000, "end_ms": F.col("n") * 2000 + F.length("text") * 20})
    timed = timed.withColumn("next_ms", F.lead("start_ms").over(Window.partitionBy("doc_id").orderBy("n")))
    rules = {k: v.replace("regexp_matches(", "regexp(").replace("\\", "\\\\").replace("starts_with(", "startswith(").replace("ends_with(", "endswith(") for k, v in CUE_RULES.items()}
    return findings(timed, rules, ["doc_id", "n"])


@query("cue_order_check", f"WITH {CUE_SQL} SELECT doc_id, n, end_ms, next_ms FROM cue WHERE end_ms > next_ms + 1")
def cue_order_check(spark, sf):
    """Cues that run into the next one."""
    lines = fx.table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "text")).withColumn("n", F.col("n").cast("long"))
    timed = lines.select("doc_id", "n", (F.col("n") * 2000 + F.length("text") * 20).alias("end_ms"), (F.lead("n").over(Window.partitionBy("doc_id").orderBy("n")) * 2000).alias("next_ms"))
    return timed.where("end_ms > next_ms + 1")


@query("widest_cues", f"WITH {CUE_SQL} SELECT doc_id, n, length(text) AS width FROM cue ORDER BY length(text) DESC, doc_id, n LIMIT 12")
def widest_cues(spark, sf):
    """The twelve widest cues: a report of that size."""
    lines = fx.table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "text"))
    return lines.select("doc_id", F.col("n").cast("long").alias("n"), F.length("text").cast("long").alias("width")).orderBy(F.desc("width"), "doc_id", "n").limit(12)


@query("first_probe_cues", f"WITH {CUE_SQL} SELECT doc_id, n, (start_ms + end_ms) // 2 AS at_ms FROM cue WHERE end_ms - start_ms > 800 ORDER BY doc_id, n LIMIT 12")
def first_probe_cues(spark, sf):
    """The first twelve cues over 0.8 s, and where to look at them."""
    lines = fx.table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "text")).withColumn("n", F.col("n").cast("long"))
    long = lines.withColumn("ms", F.length("text") * 20).where("ms > 800")
    return long.orderBy("doc_id", "n").limit(12).select("doc_id", "n", F.floor((F.col("n") * 4000 + F.col("ms")) / 2).alias("at_ms"))


@query("first_repeats_reported", f"WITH {NORM_WORDS}, {GATE_SQL} SELECT source, idx, n FROM hits6 ORDER BY source, idx LIMIT 25")
def first_repeats_reported(spark, sf):
    """The first twenty-five repeats of six words."""
    return sq.repeats(sq.with_norm(fx.words(spark, sf)), [(6, 40, 4)]).orderBy("source", "idx").limit(25).select("source", "idx", "n")


@query("drop_examples", f"WITH {WORDS_SQL} SELECT source, idx, text FROM words WHERE length(text) >= 12 ORDER BY source, idx LIMIT 4")
def drop_examples(spark, sf):
    """The first four examples for a report."""
    return fx.words(spark, sf).where(F.length("text") >= 12).orderBy("source", "idx").limit(4).select("source", "idx", "text")


@query("ordered_distinct", "SELECT source, min(doc_id) AS first_at FROM documents GROUP BY source")
def ordered_distinct(spark, sf):
    """Distinct values in the order in which they first come."""
    return fx.table(spark, sf, "documents").groupBy("source").agg(F.min("doc_id").alias("first_at")).orderBy("first_at", "source")


@query("word_union", r"SELECT conv_id, CAST(len(list_distinct(flatten(list(string_split(text, ' '))))) AS BIGINT) AS words FROM conversations GROUP BY conv_id")
def word_union(spark, sf):
    """How many different words the turns of a conversation have together."""
    turns = fx.table(spark, sf, "conversations").select("conv_id", F.explode(F.split("text", " ")).alias("w")).distinct()
    return turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("words"))


@query("long_tokens", f"WITH {WORDS_SQL} SELECT source, idx, text, end_ms - start_ms AS ms FROM words WHERE end_ms - start_ms >= 1500")
def long_tokens(spark, sf):
    return fx.words(spark, sf).select("source", "idx", "text", (F.col("end_ms") - F.col("start_ms")).alias("ms")).where("ms >= 1500")


@query("swallow_report", f"WITH {SPOKEN_SQL} SELECT source, count(*) AS words, CAST(sum(CASE WHEN logged_end - end_ms > 60 THEN 1 ELSE 0 END) AS BIGINT) AS tail_padded, CAST(sum(CASE WHEN start_ms - logged_start > 30 THEN 1 ELSE 0 END) AS BIGINT) AS head_padded FROM spoken GROUP BY source")
def swallow_report(spark, sf):
    """Words whose logged span is wider than the measured one, at its end (60 ms) and its start (30 ms)."""
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return fx.spoken(fx.sound(spark, sf)).groupBy("source").agg(F.count(F.lit(1)).alias("words"), count(F.col("logged_end") - F.col("end_ms") > 60).alias("tail_padded"), count(F.col("start_ms") - F.col("logged_start") > 30).alias("head_padded"))


# ---- cards: a conversation's user turns are cues, its system turn is the card on screen ----

CARD_SQL = r"""t AS (SELECT conv_id, turn, role, lower(regexp_replace(w, '[^\p{L}\p{N}_]', '', 'g')) AS w FROM (SELECT conv_id, turn, role, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w FROM conversations)),
tw AS (SELECT DISTINCT * FROM t WHERE w <> '' AND w NOT IN ({0})),
win AS (SELECT conv_id, turn, turn * 10000 - 6000 AS ws, turn * 10000 + 8000 AS we, CASE WHEN conv_id % 2 = 0 THEN 'lowerthird' ELSE 'card' END AS kind FROM conversations WHERE role = 'assistant' GROUP BY ALL),
cq AS (SELECT conv_id, turn, turn * 10000 AS a, turn * 10000 + 6000 AS b FROM conversations WHERE role = 'user' GROUP BY ALL),
cn AS (SELECT conv_id, turn, count(*) AS n FROM tw WHERE role = 'user' GROUP BY ALL),
sh AS (SELECT c.conv_id, c.turn, w.turn AS card, any_value(w.kind) AS kind, count(*) AS shared FROM cq c JOIN win w ON w.conv_id = c.conv_id AND c.a < w.we AND c.b > w.ws JOIN tw x ON x.conv_id = c.conv_id AND x.turn = c.turn AND x.role = 'user' JOIN tw y ON y.conv_id = w.conv_id AND y.turn = w.turn AND y.role = 'assistant' AND y.w = x.w GROUP BY ALL)""".replace("{0}", ", ".join(f"'{s}'" for s in STOPWORDS))


@query("topic_overlap_suppression", f"WITH {CARD_SQL} SELECT c.conv_id, c.turn FROM cq c WHERE NOT EXISTS (SELECT 1 FROM sh JOIN cn USING (conv_id, turn) WHERE sh.conv_id = c.conv_id AND sh.turn = c.turn AND (kind = 'lowerthird' OR shared >= 2 OR shared / n >= 0.6))")
def topic_overlap_suppression(spark, sf):
    """Cues (user turns) that say what a card (assistant turn) shows at the same time are dropped: one shared content word
    is enough for a lower third; else two, or 60 % of the cue's."""
    turns = fx.table(spark, sf, "conversations")
    words = turns.select("conv_id", "turn", "role", F.explode(F.split("text", fx.SPACE)).alias("w")).withColumn("w", tx.norm(F.col("w")))
    words = words.where((F.col("w") != "") & ~F.col("w").isin(*STOPWORDS)).distinct()
    cues = turns.where("role = 'user'").select("conv_id", "turn").distinct()
    at = F.col("turn") * 10000
    timed = cues.withColumns({"a": at, "b": at + 6000})
    cards = turns.where("role = 'assistant'").select("conv_id", F.col("turn").alias("card")).distinct()
    cards = cards.withColumns({"ws": F.col("card") * 10000 - 6000, "we": F.col("card") * 10000 + 8000, "kind": F.when(F.col("conv_id") % 2 == 0, "lowerthird").otherwise("card")})
    meet = timed.join(cards, "conv_id").where("a < we AND b > ws")
    said = words.where("role = 'user'").select("conv_id", "turn", "w")
    shown = words.where("role = 'assistant'").select("conv_id", F.col("turn").alias("card"), "w")
    shared = meet.join(said, ["conv_id", "turn"]).join(shown, ["conv_id", "card", "w"]).groupBy("conv_id", "turn", "card", "kind").agg(F.count(F.lit(1)).alias("shared"))
    n = said.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n"))
    gone = shared.join(n, ["conv_id", "turn"]).where("kind = 'lowerthird' OR shared >= 2 OR shared / n >= 0.6").select("conv_id", "turn").distinct()
    return cues.join(gone, ["conv_id", "turn"], "left_anti")


# ---- words measured against the sound ----

@query("uncovered_loud_runs", f"""WITH {SPOKEN_SQL}, db AS (SELECT source, i, 20 * log10(level + 1e-9) AS db FROM sound), th AS (SELECT source, quantile_cont(db, 0.9) - 22.0 AS thr FROM db WHERE db > -60 GROUP BY source),
cv AS (SELECT DISTINCT source, unnest(range(greatest(logged_start - 50, 0) // 20, (logged_end + 50) // 20 + 1)) AS i FROM spoken),
rg AS (SELECT source, k, k * 150 AS i0, least(k * 150 + 122, n) AS i1 FROM (SELECT source, n, unnest(range(0, (n - 1) // 150 + 1)) AS k FROM (SELECT source, max(i) + 1 AS n FROM sound GROUP BY source))),
lo AS (SELECT d.source, r.k, r.i1, d.i, d.i - row_number() OVER (PARTITION BY d.source, r.k ORDER BY d.i) AS g FROM db d JOIN th USING (source) JOIN rg r ON r.source = d.source AND d.i >= r.i0 AND d.i < r.i1 LEFT JOIN cv ON cv.source = d.source AND cv.i = d.i WHERE db > thr AND cv.i IS NULL),
ru AS (SELECT source, k, min(i) AS a, CASE WHEN max(i) = any_value(i1) - 1 THEN max(i) ELSE max(i) + 1 END AS b FROM lo GROUP BY source, k, g)
SELECT source, k AS seq, a * 20 AS start_ms, b * 20 AS end_ms FROM ru WHERE (b - a) * 20 >= 350""")
def uncovered_loud_runs(spark, sf):
    """Runs of 0.35 s and more in kept ranges, loud (within 22 dB of the 90th percentile over -60 dB) and under no word. A
    run that reaches a range's last frame ends ahead of that frame."""
    sound = fx.sound(spark, sf)
    words = fx.spoken(sound)
    db = sound.select("source", "i", (20 * F.log10(F.col("level") + 1e-9)).alias("db"))
    line = db.where("db > -60").groupBy("source").agg((F.percentile("db", F.lit(0.9)) - 22.0).alias("thr"))
    covered = words.select("source", F.explode(F.sequence(F.floor(F.greatest(F.col("logged_start") - 50, F.lit(0)) / 20), F.floor((F.col("logged_end") + 50) / 20))).alias("i")).distinct()
    last = sound.groupBy("source").agg((F.max("i") + 1).alias("n"))
    # Ranges are the first 122 of each 150 frames, so a frame knows its own.
    kept = db.withColumn("seq", F.floor(F.col("i") / 150)).where("i % 150 < 122").join(last, "source").withColumn("i1", F.least(F.col("seq") * 150 + 122, "n"))
    loud = kept.join(line, "source").where("db > thr").join(covered, ["source", "i"], "left_anti")
    runs = loud.withColumn("_g", F.col("i") - F.row_number().over(Window.partitionBy("source", "seq").orderBy("i"))).groupBy("source", "seq", "_g")
    ends = runs.agg(F.min("i").alias("a"), (F.max("i") + F.when(F.max("i") == F.first("i1") - 1, 0).otherwise(1)).alias("b"))
    return ends.where("(b - a) * 20 >= 350").select("source", "seq", (F.col("a") * 20).alias("start_ms"), (F.col("b") * 20).alias("end_ms"))


@query("measured_extent", f"""WITH {SPOKEN_SQL}, lg AS (SELECT source, idx, logged_start - 160 AS s, logged_end + (k % 4) * 420 AS e FROM spoken), ps AS (SELECT source, i, sum(level) OVER (PARTITION BY source ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3 AS p, level FROM sound),
th AS (SELECT source, greatest(quantile_cont(level, 0.9) * 0.1, quantile_cont(level, 0.1) * 1.8) AS thr FROM sound GROUP BY source),
ld AS (SELECT l.source, l.idx, l.s, l.e, p.i FROM lg l JOIN th USING (source) JOIN ps p ON p.source = l.source AND p.i >= greatest(l.s, 0) // 20 AND p.i <= l.e // 20 AND p.p > thr),
lr AS (SELECT *, sum(CASE WHEN pi IS NULL OR i - pi > 15 THEN 1 ELSE 0 END) OVER (PARTITION BY source, idx ORDER BY i) AS g FROM (SELECT *, lag(i) OVER (PARTITION BY source, idx ORDER BY i) AS pi FROM ld)),
ru AS (SELECT source, idx, any_value(s) AS s, any_value(e) AS e, min(i) AS a, max(i) AS b FROM lr GROUP BY source, idx, g),
bs AS (SELECT source, idx, arg_max(a, (b - a) * 10000000 - a) AS a, arg_max(b, (b - a) * 10000000 - a) AS b, min(a) AS fa, max(b) AS fb FROM ru GROUP BY source, idx),
mx AS (SELECT l.source, l.idx, l.s, l.e, CASE WHEN b.a IS NULL THEN greatest(l.s, l.e - 100) WHEN l.e - l.s > 1500 THEN b.a * 20 ELSE b.fa * 20 END AS ms, CASE WHEN b.a IS NULL THEN l.e WHEN l.e - l.s > 1500 THEN (b.b + 1) * 20 ELSE (b.fb + 1) * 20 END AS me FROM lg l LEFT JOIN bs b ON b.source = l.source AND b.idx = l.idx),
ns AS (SELECT *, CASE WHEN ms - s > 200 THEN ms ELSE s END AS n0, CASE WHEN e - me > 200 THEN me ELSE e END AS n1 FROM mx)
SELECT source, idx, CASE WHEN n1 <= n0 THEN s ELSE n0 END AS start_ms, CASE WHEN n1 <= n0 THEN e ELSE n1 END AS end_ms FROM ns""")
def measured_extent(spark, sf):
    """The audible extent of words as logged (here 160 ms early, and late by up to 1.3 s)."""
    from loomline.operators.signal import measured_words

    sound = fx.sound(spark, sf)
    logged = fx.spoken(sound).select("source", "idx", (F.col("logged_start") - 160).alias("start_ms"), (F.col("logged_end") + F.col("k") % 4 * 420).alias("end_ms"))
    return measured_words(logged, sound)


@query("phase_verdict", f"""WITH {SPOKEN_SQL}, mv AS (SELECT source, i // 5 AS step, max(CASE WHEN k % 9 = 0 THEN 1 ELSE 0 END) AS live FROM sound GROUP BY source, i // 5), ph AS (SELECT source, step % 4 AS phase, count(*) AS total, CAST(sum(live) AS BIGINT) AS live FROM mv WHERE step % 4 < 3 GROUP BY source, step % 4)
SELECT source, arg_min(live, live / total + phase * 1e-9) AS live, arg_min(total, live / total + phase * 1e-9) AS total, arg_min(live, live / total + phase * 1e-9) <= arg_min(total, live / total + phase * 1e-9) / 3 AS frozen FROM ph GROUP BY source""")
def phase_verdict(spark, sf):
    """The worst of three sampling phases decides whether a picture counts as frozen."""
    sound = fx.sound(spark, sf)
    step = sound.groupBy("source", F.floor(F.col("i") / 5).alias("step")).agg(F.max(F.when(F.col("k") % 9 == 0, 1).otherwise(0)).alias("live"))
    phases = step.withColumn("phase", F.col("step") % 4).where("phase < 3").groupBy("source", "phase").agg(F.count(F.lit(1)).alias("total"), F.sum("live").alias("live"))
    worst = phases.groupBy("source").agg(F.min(F.struct((F.col("live") / F.col("total")).alias("r"), "phase", "live", "total")).alias("m"))
    return worst.select("source", "m.live", "m.total", (F.col("m.live") <= F.col("m.total") / 3).alias("frozen"))


@query("grid_stamp", f"""WITH {WORDS_SQL}, e AS (SELECT source, count(*) AS n, max(end_ms) AS last FROM words GROUP BY source)
SELECT source, CAST(regexp_extract('; grid-offset-total: ' || printf('%.3f', last / 1000.0), '^;\\s*grid-offset-total:\\s*([0-9.]+)', 1) AS DOUBLE) AS stamped FROM e""")
def grid_stamp(spark, sf):
    """The total that a caption file's header carries, read back."""
    from loomline.sources.files import stamp

    ends = fx.words(spark, sf).groupBy("source").agg(F.max("end_ms").alias("last"))
    header = ends.select("source", F.format_string("[Script Info]\n; grid-offset-total: %.3f\n; grid-fps: 30", F.col("last") / 1000.0).alias("text"))
    return header.select("source", stamp(F.col("text"), "grid-offset-total").alias("stamped"))


ASS_SQL = r"""al AS (SELECT conv_id, turn, CASE WHEN turn % 7 = 6 THEN 'Dialogue: 0,0:00:01.00,0:00:02.00,Cap' ELSE 'Dialogue: 0,' || printf('%d:%02d:%02d.%02d', turn // 2, turn * 7 % 60, conv_id % 60, turn * 13 % 100) || ',' || printf('%d:%02d:%02d.%02d', turn // 2, turn * 7 % 60 + 1, conv_id % 60, 0) || ',Cap,,0,0,0,,' || replace(text, chr(10), ' ') END AS value FROM conversations),
af AS (SELECT conv_id, turn, string_split(regexp_replace(value, '^Dialogue: *', ''), ',') AS f FROM al)"""
AT_SQL = "(CAST(regexp_extract({0}, '^(\\d+):', 1) AS BIGINT) * 3600000 + CAST(regexp_extract({0}, ':(\\d+):', 1) AS BIGINT) * 60000 + CAST(regexp_extract({0}, ':(\\d+)\\.', 1) AS BIGINT) * 1000 + CAST(regexp_extract({0}, '\\.(\\d+)$', 1) AS BIGINT) * 10)"


@query("caption_file_parse", f"WITH {ASS_SQL} SELECT conv_id, turn, CASE WHEN len(f) >= 10 THEN {AT_SQL.format('f[2]')} END AS start_ms, CASE WHEN len(f) >= 10 THEN {AT_SQL.format('f[3]')} END AS end_ms, CASE WHEN len(f) >= 10 THEN array_to_string(f[10:], ',') END AS text, len(f) >= 10 AS complete FROM af")
def caption_file_parse(spark, sf):
    """Rows of a caption file, ten fields each, the text with its own commas; a row with fewer is marked."""
    from loomline.sources.files import dialogue_fields

    turn, conv = F.col("turn"), F.col("conv_id")
    clock = lambda m, s, c: F.format_string("%d:%02d:%02d.%02d", F.floor(turn / 2).cast("long"), m, s, c)
    full = F.concat(F.lit("Dialogue: 0,"), clock(turn * 7 % 60, conv % 60, turn * 13 % 100), F.lit(","), clock(turn * 7 % 60 + 1, conv % 60, F.lit(0).cast("long")), F.lit(",Cap,,0,0,0,,"), F.replace("text", F.lit("\n"), F.lit(" ")))
    lines = fx.table(spark, sf, "conversations").select("conv_id", "turn", F.when(turn % 7 == 6, "Dialogue: 0,0:00:01.00,0:00:02.00,Cap").otherwise(full).alias("value"))
    found = dialogue_fields(lines, ["conv_id", "turn"])
    return found.select("conv_id", "turn", *(F.when(F.col("complete"), F.col(c)).alias(c) for c in ("start_ms", "end_ms", "text")), "complete")


@query("clean_text")
def clean_text(spark, sf):
    """Texts as captions would have them, with two corrections."""
    return fx.table(spark, sf, "documents").select("doc_id", F.md5(cp.clean(F.col("text"), (("the the", "the"), ("--", "")))).alias("cleaned"))


@query("rtl_lines", f"WITH {CUE_SQL} SELECT doc_id, n, CASE WHEN regexp_matches(text, '[{RTL}]') THEN '{cp.EMBED}' || text || '{cp.POP}' ELSE text END AS line FROM cue")
def rtl_lines(spark, sf):
    """Lines with letters that run from right to left are pinned to that direction, the others left alone."""
    lines = fx.table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "text"))
    return lines.select("doc_id", F.col("n").cast("long").alias("n"), F.when(cp.has_rtl(F.col("text")), F.concat(F.lit(cp.EMBED), "text", F.lit(cp.POP))).otherwise(F.col("text")).alias("line"))


@query("grade_filters", """SELECT c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN '__AUTO__' WHEN 'BUILDING' THEN 'eq=contrast=1.03:saturation=0.98' WHEN 'FURNITURE' THEN '' WHEN 'MACHINERY' THEN 'eq=gamma=1.02' ELSE lower(c_mktsegment) END AS grade FROM customer""")
def grade_filters(spark, sf):
    """A grade by name, for later, or as a filter."""
    from loomline.sources.files import grade_of

    asked = F.when(F.col("c_mktsegment") == "AUTOMOBILE", "auto").when(F.col("c_mktsegment") == "BUILDING", "subtle").when(F.col("c_mktsegment") == "FURNITURE", "none").when(F.col("c_mktsegment") == "MACHINERY", "eq=gamma=1.02")
    return fx.table(spark, sf, "customer").select("c_custkey", grade_of(asked.otherwise(F.lower("c_mktsegment"))).alias("grade"))


@query("offset_by_source", "SELECT o_orderkey, CAST(coalesce(map {'F': 0.24, 'O': 0.12}[o_orderstatus], 0.0) AS DOUBLE) AS av_offset_s FROM orders")
def offset_by_source(spark, sf):
    """A setting by source, with a default for the sources that have none."""
    offsets = F.create_map(F.lit("F"), F.lit(0.24), F.lit("O"), F.lit(0.12))
    return fx.table(spark, sf, "orders").select("o_orderkey", F.coalesce(F.try_element_at(offsets, F.col("o_orderstatus")), F.lit(0.0)).alias("av_offset_s"))
