"""Queries over word sequences and texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomline.functions import text as tx
from loomline.operators import sequences as sq
from loomline.plans.registry import query
from loomline.sources import fixtures as fx
from loomline.sources.fixtures import WORDS_SQL

N = tx.NORM_SQL.format("text")
NORM_WORDS = f"{WORDS_SQL}, nw AS (SELECT *, {N} AS norm FROM words)"


def lead(k):
    return "norm" if k == 0 else f"lead(norm, {k}) OVER w"


def repeats_sql(n, window, distinct, name="hits", drop_last=False):
    cols = ", ".join(f"{lead(k)} AS n{k}" for k in range(n))
    ok = " AND ".join(f"coalesce(n{k}, '') <> ''" for k in range(n))
    gram = " || ' ' || ".join(f"n{k}" for k in range(n))
    last = f" AND idx < words_n - {n}" if drop_last else ""
    return (f"g{n} AS (SELECT source, idx, words_n, {cols} FROM (SELECT *, count(*) OVER (PARTITION BY source) AS words_n FROM nw) WINDOW w AS (PARTITION BY source ORDER BY idx)), "
            f"{name}{n} AS (SELECT source, idx, CAST({n} AS BIGINT) AS n, back FROM (SELECT source, idx, idx - lag(idx) OVER (PARTITION BY source, {gram} ORDER BY idx) AS back FROM g{n} "
            f"WHERE {ok} AND len(list_distinct([{', '.join(f'n{k}' for k in range(n))}])) >= {distinct}{last}) WHERE back <= {window})")


GATE_SQL = ", ".join(repeats_sql(n, w, max(2, n - 2)) for n, w in sq.GATE)


@query("words_with_clock", f"WITH {WORDS_SQL} SELECT source, idx, text, start_ms, end_ms FROM words")
def words_with_clock(spark, sf):
    return fx.words(spark, sf)


@query("norm_text", f"WITH {NORM_WORDS} SELECT norm, count(*) AS n FROM nw GROUP BY norm")
def norm_text(spark, sf):
    return sq.with_norm(fx.words(spark, sf)).groupBy("norm").agg(F.count(F.lit(1)).alias("n"))


@query("strip_marks", r"SELECT doc_id, length(regexp_replace(text, '[\x{064B}-\x{0652}\x{0640}]', '', 'g')) AS n FROM documents")
def strip_marks(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", F.length(tx.strip_marks(F.col("text"))).cast("long").alias("n"))


@query("time_formats", f"""WITH {WORDS_SQL} SELECT source, idx,
  printf('%02d:%02d.%02d', start_ms // 60000, start_ms // 1000 % 60, start_ms // 10 % 100) AS short,
  printf('%d:%02d:%02d.%02d', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60, start_ms // 10 % 100) AS cue,
  printf('%02d:%02d:%02d,%03d', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60, start_ms % 1000) AS srt FROM words""")
def time_formats(spark, sf):
    w = fx.words(spark, sf)
    return w.select("source", "idx", tx.clock_short(F.col("start_ms")).alias("short"), tx.clock_cue(F.col("start_ms")).alias("cue"), tx.clock_srt(F.col("start_ms")).alias("srt"))


@query("ngram_repeats_gate", f"WITH {NORM_WORDS}, {GATE_SQL} " + " UNION ALL ".join(f"SELECT * FROM hits{n}" for n, _ in sq.GATE))
def ngram_repeats_gate(spark, sf):
    return sq.gate_repeats(sq.with_norm(fx.words(spark, sf)))


@query("ngram_repeats_authoring", f"WITH {NORM_WORDS}, {repeats_sql(4, 70, 1, drop_last=True)} SELECT * FROM hits4")
def ngram_repeats_authoring(spark, sf):
    return sq.repeats(sq.with_norm(fx.words(spark, sf)), [(4, 70, 1)], drop_last=True)


@query("ngram_repeats_greedy")
def ngram_repeats_greedy(spark, sf):
    return sq.spaced(sq.gate_repeats(sq.with_norm(fx.words(spark, sf))))


@query("adjacent_duplicates", f"WITH {NORM_WORDS} SELECT source, idx, text FROM (SELECT *, lag(norm) OVER (PARTITION BY source ORDER BY idx) AS p FROM nw) WHERE p = norm AND length(norm) > 2")
def adjacent_duplicates(spark, sf):
    w = sq.with_norm(fx.words(spark, sf)).withColumn("p", F.lag("norm").over(sq.by_source()))
    return w.where((F.col("p") == F.col("norm")) & (F.length("norm") > 2)).select("source", "idx", "text")


@query("two_word_restart", f"WITH {NORM_WORDS}, x AS (SELECT source, idx, norm AS a, lead(norm) OVER w AS b, lead(norm, 2) OVER w AS c, lead(norm, 3) OVER w AS d FROM nw WINDOW w AS (PARTITION BY source ORDER BY idx)) SELECT source, idx, a, b FROM x WHERE a = c AND b = d AND a <> '' AND b <> '' AND length(a) + length(b) >= 5")
def two_word_restart(spark, sf):
    w = sq.by_source()
    x = sq.with_norm(fx.words(spark, sf)).select("source", "idx", F.col("norm").alias("a"), *(F.lead("norm", k).over(w).alias(c) for k, c in ((1, "b"), (2, "c"), (3, "d"))))
    return x.where("a = c AND b = d AND a <> '' AND b <> '' AND length(a) + length(b) >= 5").select("source", "idx", "a", "b")


PAUSE_SQL = f"""{NORM_WORDS}, pz AS (SELECT source, idx, lead(start_ms) OVER w - end_ms AS gap_ms, list(norm) OVER (PARTITION BY source ORDER BY idx ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS l,
  list(norm) OVER (PARTITION BY source ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS r FROM nw WINDOW w AS (PARTITION BY source ORDER BY idx)), pause AS (SELECT * FROM pz WHERE gap_ms >= 800)"""


@query("restart_stem", f"WITH {PAUSE_SQL}, e AS (SELECT source, idx, gap_ms, l[-1] AS a, r[1] AS b FROM pause) SELECT source, idx, gap_ms FROM e WHERE length(a) >= 4 AND length(b) >= 4 AND a <> b AND (starts_with(a, b) OR starts_with(b, a))")
def restart_stem(spark, sf):
    p = sq.around_pause(sq.with_norm(fx.words(spark, sf)), 800, 10, 10)
    return p.where(sq.stem_restart(F.col("left"), F.col("right"))).select("source", "idx", "gap_ms")


RUN_CASES = " ".join(f"WHEN len(l) >= {j} AND NOT list_contains(l[-{j}:], '') AND ({' OR '.join(f'l[-{j}:] = r[{o + 1}:{o + j}]' for o in range(4))}) THEN {j}" for j in (4, 3, 2))


@query("restart_run", f"WITH {PAUSE_SQL}, e AS (SELECT source, idx, CAST(CASE {RUN_CASES} ELSE 0 END AS BIGINT) AS words_again FROM pause) SELECT * FROM e WHERE words_again > 0")
def restart_run(spark, sf):
    p = sq.around_pause(sq.with_norm(fx.words(spark, sf)), 800, 10, 10)
    return p.select("source", "idx", sq.run_restart(F.col("left"), F.col("right")).alias("words_again")).where("words_again > 0")


#: What a speaker says to whoever cuts the recording.
INSTRUCTIONS = "(احذف|امسح|اقطع|شيل|delete|cut|remove|idiot|sch)"


@query("context_window", f"WITH {WORDS_SQL} SELECT source, idx, context FROM (SELECT source, idx, text, string_agg(text, ' ') OVER (PARTITION BY source ORDER BY idx ROWS BETWEEN 12 PRECEDING AND 13 FOLLOWING) AS context FROM words) WHERE regexp_matches(text, '{INSTRUCTIONS}')")
def context_window(spark, sf):
    """Words by a pattern, with the twelve before and the thirteen after."""
    w = fx.words(spark, sf).withColumn("context", sq.context(None, 12, 13))
    return w.where(F.col("text").rlike(INSTRUCTIONS)).select("source", "idx", "context")


@query("gap_to_previous", f"WITH {WORDS_SQL} SELECT source, idx, gap FROM (SELECT *, start_ms - lag(end_ms) OVER (PARTITION BY source ORDER BY idx) AS gap FROM words) WHERE NOT (end_ms < 20000 OR start_ms > 40000)")
def gap_to_previous(spark, sf):
    """Words in a window of the source, with the gap to the word before, in the window or not."""
    w = fx.words(spark, sf).withColumn("gap", F.col("start_ms") - F.lag("end_ms").over(sq.by_source()))
    return w.where("NOT (end_ms < 20000 OR start_ms > 40000)").select("source", "idx", "gap")


@query("gap_report", f"WITH {WORDS_SQL}, g AS (SELECT source, idx, lead(start_ms) OVER w - end_ms AS gap_ms FROM words WINDOW w AS (PARTITION BY source ORDER BY idx)) SELECT source, count(*) AS gaps, CAST(sum(gap_ms) AS BIGINT) AS total_ms, max(gap_ms) AS longest_ms FROM g WHERE gap_ms >= 300 GROUP BY source")
def gap_report(spark, sf):
    g = sq.gaps(fx.words(spark, sf)).where("gap_ms >= 300")
    return g.groupBy("source").agg(F.count(F.lit(1)).alias("gaps"), F.sum("gap_ms").alias("total_ms"), F.max("gap_ms").alias("longest_ms"))


@query("token_frequency_first_seen", r"""WITH t AS (SELECT doc_id, w, i FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9._-]*')) AS w, generate_subscripts(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9._-]*'), 1) AS i FROM documents))
SELECT w AS token, count(*) AS n, min(doc_id * 1000000 + i - 1) AS first_at, list_sort(list(doc_id * 1000000 + i - 1))[1:8] AS firsts FROM t GROUP BY w""")
def token_frequency_first_seen(spark, sf):
    """Latin tokens: how often, where first, and the first eight places. Each task passes on a count and eight places a
    token, so that hot tokens stay cheap: counts are summed and ranks are limited before the shuffle."""
    docs = fx.table(spark, sf, "documents")
    t = docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("[A-Za-z][A-Za-z0-9._-]*"), 0)).alias("i", "token"))
    t = t.select("token", (F.col("doc_id") * 1_000_000 + F.col("i")).alias("at"))
    counted = t.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first_at"))
    ranked = t.withColumn("k", F.row_number().over(Window.partitionBy("token").orderBy("at"))).where("k <= 8")
    return counted.join(ranked.groupBy("token").agg(F.array_sort(F.collect_list("at")).alias("firsts")), "token")


@query("utterances_gap", f"""WITH {WORDS_SQL}, f AS (SELECT *, CASE WHEN start_ms - lag(end_ms) OVER (PARTITION BY source ORDER BY idx) >= 800 THEN 1 ELSE 0 END AS b FROM words),
u AS (SELECT *, CAST(sum(b) OVER (PARTITION BY source ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS utterance FROM f)
SELECT source, utterance, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n_words, string_agg(text, ' ' ORDER BY idx) AS text FROM u GROUP BY source, utterance""")
def utterances_gap(spark, sf):
    return sq.sessions(fx.words(spark, sf), 800)


# Groups that end at the first word that is over a length, or that ends them for another reason: where each word's group
# would end is known at once, and the groups are a chain of such ends. {0} has {1}, idx, text, start_ms, end_ms, c (letters and
# blanks up to the word's end), may (the length may end a group here) and must (the word ends its group).
CHAIN_SQL = """{0}n AS (SELECT *, min(CASE WHEN must THEN idx END) OVER (PARTITION BY {1} ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS must_at,
  min(CASE WHEN may OR must THEN idx END) OVER (PARTITION BY {1} ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS may_at, min(idx) OVER (PARTITION BY {1}) AS head FROM {0}),
{0}e AS MATERIALIZED (SELECT a.*, least(a.must_at, coalesce(b.may_at, a.must_at)) AS e FROM {0}n a ASOF LEFT JOIN {0}n b ON {2} AND b.c >= a.c - length(a.text) + {3}),
{0}r AS (SELECT {1}, idx AS i, e, 0 AS nr FROM {0}e WHERE idx = head UNION ALL SELECT {4}, x.idx, x.e, q.nr + 1 FROM {0}r q JOIN {0}e x ON {5} AND x.idx = q.e + 1),
{0}g AS (SELECT {4}, q.nr, min(x.start_ms) AS start_ms, max(x.end_ms) AS end_ms, count(*) AS n_words, string_agg(x.text, ' ' ORDER BY x.idx) AS text FROM {0}r q JOIN {0} x ON {5} AND x.idx >= q.i AND x.idx <= q.e GROUP BY {4}, q.nr)"""


def chain_sql(name, keys, least):
    same = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys)
    return CHAIN_SQL.format(name, ", ".join(keys), same("a", "b"), least, ", ".join(f"x.{k}" for k in keys), same("q", "x"))


@query("utterances_gap_len", f"""WITH RECURSIVE {WORDS_SQL}, ut AS (SELECT *, sum(length(text) + 1) OVER (PARTITION BY source ORDER BY idx) AS c, true AS may, coalesce(lead(start_ms) OVER (PARTITION BY source ORDER BY idx) - end_ms >= 800, true) AS must FROM words),
{chain_sql('ut', ['source'], 221)} SELECT source, nr AS seq, start_ms, end_ms, n_words, text FROM utg""")
def utterances_gap_len(spark, sf):
    return sq.grouped(fx.words(spark, sf), sq.stop_utterance)


def cue_ranges(words):
    """What an edit keeps of a text's time: of each three minutes the first two."""
    from loomline.plans.intervals import word_ranges

    return word_ranges(words).withColumn("seq", F.floor(F.col("start_ms") / 180_000))


#: Phrases that stay in one cue and one line.
TOGETHER = ("of the", "in the house")


# Groups of up to k words that a mark ends too: words since the last mark, k at a time.
CHUNK_SQL = """{0}m AS (SELECT *, coalesce(sum(CASE WHEN {2} THEN 1 ELSE 0 END) OVER (PARTITION BY {1} ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM {0}),
{0}p AS (SELECT *, (row_number() OVER (PARTITION BY {1}, seg ORDER BY idx) - 1) // {3} AS part FROM {0}m),
{0}g AS (SELECT {1}, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n_words, string_agg(text, ' ' ORDER BY idx) AS text, min(idx) AS first FROM {0}p GROUP BY {1}, seg, part),
{0}c AS (SELECT *, row_number() OVER (PARTITION BY {1} ORDER BY first) - 1 AS nr FROM {0}g)"""
SRT_SQL = "printf('%02d:%02d:%02d,%03d', {0} // 3600000, {0} // 60000 % 60, {0} // 1000 % 60, {0} % 1000)"


@query("srt_chunks", f"""WITH {WORDS_SQL}, {CHUNK_SQL.format('words', 'source', "regexp_matches(text, '[.,!?;:]$')", 2)}
SELECT source, nr + 1 AS counter, {SRT_SQL.format('start_ms')} AS "from", {SRT_SQL.format('greatest(end_ms, start_ms + 400)')} AS "to", upper(replace(text, 'ß', 'SS')) AS text FROM wordsc""")
def srt_chunks(spark, sf):
    c = sq.grouped(fx.words(spark, sf), sq.stop_srt)
    end = F.greatest("end_ms", F.col("start_ms") + 400)
    return c.select("source", (F.col("seq") + 1).alias("counter"), tx.clock_srt(F.col("start_ms")).alias("from"), tx.clock_srt(end).alias("to"), F.upper("text").alias("text"))


PROSE_SQL = f"""{WORDS_SQL}, ends AS (SELECT source, max(end_ms) AS hi FROM words GROUP BY source),
wr AS (SELECT source, k AS seq, k * 180000 AS start_ms, least(k * 180000 + 120000, hi) AS end_ms FROM (SELECT source, hi, unnest(range(0, hi // 180000 + 1)) AS k FROM ends)),
wo AS (SELECT *, CAST(coalesce(sum(CAST(ceil(round_even((end_ms - start_ms) * 25.0 / 1000.0, 6)) AS BIGINT) * 40) OVER (PARTITION BY source ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS out_ms, start_ms - lag(end_ms) OVER (PARTITION BY source ORDER BY seq) AS removed_ms FROM wr),
said AS (SELECT w.source, r.seq, w.idx, w.text, w.start_ms - r.start_ms + r.out_ms AS start_ms, w.end_ms FROM words w JOIN wo r ON r.source = w.source AND w.end_ms > r.start_ms AND w.end_ms <= r.end_ms),
{CHUNK_SQL.format('said', 'source, seq', "regexp_matches(text, '[،.؟!…]$')", 15)}"""


@query("prose_lines", f"WITH {PROSE_SQL} SELECT source, seq, nr AS n, start_ms AS at_ms, NULL AS removed_ms, text FROM saidc UNION ALL SELECT source, seq, -1, out_ms, removed_ms, '----' FROM wo WHERE removed_ms IS NOT NULL")
def prose_lines(spark, sf):
    words = fx.words(spark, sf)
    return sq.prose(words, cue_ranges(words))


@query("markup_parse", r"""SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, length(html) AS n_chars, CAST(len(regexp_extract_all(html, '<p[ >]')) AS BIGINT) AS paragraphs, CAST(len(regexp_extract_all(html, '<a ')) AS BIGINT) AS links, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages""")
def markup_parse(spark, sf):
    p = fx.table(spark, sf, "pages")
    return p.select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.length("html").cast("long").alias("n_chars"), F.regexp_count("html", F.lit("<p[ >]")).cast("long").alias("paragraphs"),
                    F.regexp_count("html", F.lit("<a ")).cast("long").alias("links"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query("verdict_merge", """WITH v AS (SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) AS r FROM conversations WHERE role = 'assistant') WHERE r = 1),
j AS (SELECT conv_id, CASE turn % 3 WHEN 0 THEN 'reject' WHEN 1 THEN 'adjust' ELSE 'keep' END AS verdict, turn * 10 AS start_to, turn * 10 + length(text) AS end_to FROM v),
f AS (SELECT conv_id, turn, turn * 7 AS start_at, turn * 7 + 5 AS end_at FROM conversations WHERE role = 'user')
SELECT f.conv_id, f.turn, CASE WHEN verdict = 'adjust' THEN start_to ELSE start_at END AS start_at, CASE WHEN verdict = 'adjust' THEN end_to ELSE end_at END AS end_at, coalesce(verdict, 'not verified') AS verifier FROM f LEFT JOIN j USING (conv_id) WHERE coalesce(verdict, '') <> 'reject'""")
def verdict_merge(spark, sf):
    """Findings (user turns) with the last verdict on them (the last assistant turn): rejected ones go, adjusted ones take the
    verdict's times, those without one are marked."""
    turns = fx.table(spark, sf, "conversations")
    last = turns.where("role = 'assistant'").groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("m"))
    turn = F.col("m.turn")
    verdict = F.when(turn % 3 == 0, "reject").when(turn % 3 == 1, "adjust").otherwise("keep")
    judged = last.select("conv_id", verdict.alias("verdict"), (turn * 10).alias("start_to"), (turn * 10 + F.length("m.text")).alias("end_to"))
    found = turns.where("role = 'user'").select("conv_id", "turn", (F.col("turn") * 7).alias("start_at"), (F.col("turn") * 7 + 5).alias("end_at"))
    both = found.join(judged, "conv_id", "left").where(F.coalesce("verdict", F.lit("")) != "reject")
    adjusted = F.col("verdict") == "adjust"
    return both.select("conv_id", "turn", F.when(adjusted, F.col("start_to")).otherwise(F.col("start_at")).alias("start_at"), F.when(adjusted, F.col("end_to")).otherwise(F.col("end_at")).alias("end_at"),
                       F.coalesce("verdict", F.lit("not verified")).alias("verifier"))


@query("zero_length_repair", f"""WITH {WORDS_SQL}, z AS (SELECT source, idx, start_ms, CASE WHEN idx % 7 = 0 THEN start_ms ELSE end_ms END AS end_ms, lead(start_ms) OVER (PARTITION BY source ORDER BY idx) AS nx FROM words)
SELECT source, idx, CASE WHEN end_ms <= start_ms THEN greatest(start_ms + 20, least(start_ms + 40, coalesce(nx, start_ms + 40))) ELSE end_ms END AS end_ms FROM z""")
def zero_length_repair(spark, sf):
    w = fx.words(spark, sf).select("source", "idx", "start_ms", F.when(F.col("idx") % 7 == 0, F.col("start_ms")).otherwise(F.col("end_ms")).alias("end_ms"), F.lead("start_ms").over(sq.by_source()).alias("nx"))
    fixed = F.greatest(F.col("start_ms") + 20, F.least(F.col("start_ms") + 40, F.coalesce("nx", F.col("start_ms") + 40)))
    return w.select("source", "idx", F.when(F.col("end_ms") <= F.col("start_ms"), fixed).otherwise(F.col("end_ms")).alias("end_ms"))


# The texts have no Arabic letters, so of cleaning only what concerns marks is to be seen.
CUES_SQL = f"""{PROSE_SQL}, cw AS (SELECT w.source, r.seq, w.idx, w.text, {N} AS norm, greatest(w.start_ms, r.start_ms) - r.start_ms + r.out_ms AS start_ms, w.end_ms - r.start_ms + r.out_ms AS end_ms FROM words w JOIN wo r ON r.source = w.source AND w.end_ms > r.start_ms AND w.end_ms <= r.end_ms),
cl AS (SELECT *, lag(norm) OVER w AS pn, lead(start_ms) OVER w - end_ms AS gap, sum(length(text) + 1) OVER w AS c FROM cw WINDOW w AS (PARTITION BY source, seq ORDER BY idx)),
ci AS (SELECT *, NOT (norm IN ('of', 'in') OR (norm = 'the' AND coalesce(pn, '') = 'in')) AS may, gap IS NULL OR (NOT (norm IN ('of', 'in') OR (norm = 'the' AND coalesce(pn, '') = 'in')) AND (regexp_matches(text, '[.!؟?…]$') OR gap >= 550)) AS must FROM cl),
{chain_sql('ci', ['source', 'seq'], 46)},
cc AS (SELECT source, seq, nr, start_ms, end_ms, trim(regexp_replace(trim(regexp_replace(array_to_string(list_filter(string_split(text, ' '), lambda x: NOT regexp_full_match(x, '[،,;:.!؟?…-]+')), ' '), ' +([،,;:.!؟?…])', '\\1', 'g')), '[،,;:.!؟?…]+$', '')) AS text FROM cig),
cn AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY start_ms, seq, nr) - 1 AS seq, start_ms, greatest(least(end_ms, start_ms + 7000), start_ms + 550) AS end_ms, text FROM cc WHERE text <> ''),
cue AS (SELECT source, seq, start_ms, least(end_ms, coalesce(lead(start_ms) OVER (PARTITION BY source ORDER BY seq), end_ms)) AS end_ms, text FROM cn)"""


@query("cues", f"WITH RECURSIVE {CUES_SQL} SELECT source, seq, start_ms, end_ms, text FROM cue")
def cues(spark, sf):
    words = fx.words(spark, sf)
    return sq.caption_cues(words, cue_ranges(words), together=TOGETHER)


@query("cue_lines")
def cue_lines(spark, sf):
    words = fx.words(spark, sf)
    return sq.caption_cues(words, cue_ranges(words), together=TOGETHER).withColumn("lines", sq.wrap_udf("text")).select("source", "seq", "lines")
