"""The engine's relations, read from the driver's tables.

words(source, idx, text, start_ms, end_ms)   documents on a made-up clock
points(source, t_ms, value), cuts, spans      events by user; cuts are two hours either side of an error
frames(source, i, level)                      events in order as a regular series
pictures(source, sec, vec)                    embeddings by label
Times are whole milliseconds throughout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
#: Fixed values of the clock: milliseconds for a word, for each of its letters, and for the pause after it.
WORD_MS, LETTER_MS, STOP_MS, COMMA_MS, PAUSE_MS = 40, 60, 900, 300, 20
CUT_MS = 2 * 3600 * 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clocked(tokens: DataFrame) -> DataFrame:
    """tokens(source, idx, text) with start_ms and end_ms."""
    length = F.length("text").cast("long") * LETTER_MS + WORD_MS
    pause = F.when(F.col("text").rlike("[.!?]$"), STOP_MS).when(F.col("text").rlike("[,;]$"), COMMA_MS).otherwise(PAUSE_MS)
    before = Window.partitionBy("source").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(length + pause).over(before), F.lit(0)).cast("long")
    return tokens.withColumn("start_ms", start).withColumn("end_ms", F.col("start_ms") + length)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as arrays of their words, dealt by source."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source"), "text").repartition("source")
    return docs.select("source", F.filter(F.split("text", SPACE), lambda w: w != "").alias("words"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts are dealt by source before they are split, so the windows over words need no further exchange."""
    split = texts(spark, sf_dir).select("source", F.posexplode("words").alias("idx", "text"))
    return clocked(split.withColumn("idx", F.col("idx").cast("long")))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("source"), F.col("turn").alias("seq"), "role", "text")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.floor(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)") / 1000)
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("source"), "event_id", t.alias("t_ms"), "event_type", "value")


def cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = points(spark, sf_dir).where("event_type = 'error'")
    return errors.select("source", (F.col("t_ms") - CUT_MS).alias("start_ms"), (F.col("t_ms") + CUT_MS).alias("end_ms"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("why"))


def pauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second set of intervals: ten minutes before and an hour after each purchase."""
    bought = points(spark, sf_dir).where("event_type = 'purchase'")
    return bought.select("source", (F.col("t_ms") - 600_000).alias("start_ms"), (F.col("t_ms") + 3_600_000).alias("end_ms"), F.concat(F.lit("p"), F.col("event_id").cast("string")).alias("why"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).groupBy("source").agg(F.min("t_ms").alias("lo"), F.max("t_ms").alias("hi"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("source").orderBy("t_ms", "event_id")
    return points(spark, sf_dir).select("source", (F.row_number().over(order) - 1).cast("long").alias("i"), F.col("value").alias("level"))


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("label").orderBy("vec_id")
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("source"), (F.row_number().over(order) - 1).cast("long").alias("sec"), F.col("embedding").alias("vec"))


def sound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings: the order lines of a supplier as 20 ms frames with a level and a number; two stretches of forty frames
    in three are loud."""
    order = Window.partitionBy("source").orderBy("l_orderkey", "l_linenumber", "l_partkey")
    lines = table(spark, sf_dir, "lineitem").withColumn("source", F.col("l_suppkey"))
    frames_ = lines.select("source", (F.row_number().over(order) - 1).cast("long").alias("i"), F.col("l_partkey").alias("k"), "l_extendedprice")
    loud = F.when(F.floor(F.col("i") / 40) % 3 == 0, 2e7).otherwise(2e5)
    return frames_.select("source", "i", "k", (F.col("l_extendedprice") / loud).alias("level"))


def spoken(sound_: DataFrame) -> DataFrame:
    """Words of the recordings, one in twelve loud frames unless its number is a multiple of seven, and none in two of five
    stretches of 120 frames: text, the measured extent start_ms to end_ms and the logged one."""
    w = sound_.where("i % 12 = 0 AND floor(i / 40) % 3 <> 0 AND k % 7 <> 0 AND floor(i / 120) % 5 NOT IN (2, 3)")
    start = F.col("i") * 20 + F.col("k") % 40
    w = w.withColumns({"start_ms": start, "end_ms": start + 90 + F.col("k") % 110})
    return w.select("source", (F.row_number().over(Window.partitionBy("source").orderBy("i")) - 1).cast("long").alias("idx"), "k", F.concat(F.lit("w"), (F.col("k") % 50).cast("string")).alias("text"),
                    "start_ms", "end_ms", (F.col("start_ms") - F.col("k") % 3 * 20).alias("logged_start"), (F.col("end_ms") + F.col("k") % 5 * 30).alias("logged_end"))


def authored(spoken_: DataFrame) -> DataFrame:
    """Cuts as an editor writes them, one for each word whose number leaves 1 modulo 6: from a to b, how much of the tail
    to keep, and which edges may be refined."""
    k = F.col("k")
    return spoken_.where(k % 6 == 1).select("source", F.col("idx").alias("id"), (F.col("start_ms") - 15).alias("a"), (F.col("end_ms") + 35 + k % 3 * 40).alias("b"),
                                            (k % 2 * 50).alias("keep_tail"), (k % 4 != 0).alias("refine_start"), (k % 5 != 0).alias("refine_end"))


def kept_ranges(sound_: DataFrame) -> DataFrame:
    """What an edit keeps of the recordings: of each three seconds the first 2,450 ms."""
    ends = sound_.groupBy("source").agg(((F.max("i") + 1) * 20).alias("hi"))
    k = ends.withColumn("seq", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("hi") - 1) / 3000))))
    return k.select("source", "seq", (F.col("seq") * 3000).alias("start_ms"), F.least(F.col("seq") * 3000 + 2450, F.col("hi")).alias("end_ms"))


#: The same relations as SQL, for the oracles.
SOUND_SQL = """snd AS (SELECT l_suppkey AS source, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS i, l_partkey AS k, l_extendedprice AS v FROM lineitem),
sound AS (SELECT source, i, k, v / CASE WHEN (i // 40) % 3 = 0 THEN 2e7 ELSE 2e5 END AS level FROM snd)"""
SPOKEN_SQL = f"""{SOUND_SQL},
sp0 AS (SELECT source, i, k, i * 20 + k % 40 AS start_ms FROM sound WHERE i % 12 = 0 AND (i // 40) % 3 <> 0 AND k % 7 <> 0 AND (i // 120) % 5 NOT IN (2, 3)),
spoken AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY i) - 1 AS idx, k, 'w' || (k % 50) AS text, start_ms, start_ms + 90 + k % 110 AS end_ms,
  start_ms - k % 3 * 20 AS logged_start, start_ms + 90 + k % 110 + k % 5 * 30 AS logged_end FROM sp0)"""
AUTHORED_SQL = f"""{SPOKEN_SQL},
authored AS (SELECT source, idx AS id, start_ms - 15 AS a, end_ms + 35 + k % 3 * 40 AS b, k % 2 * 50 AS keep_tail, k % 4 <> 0 AS refine_start, k % 5 <> 0 AS refine_end FROM spoken WHERE k % 6 = 1)"""
KEPT_SQL = """ke AS (SELECT source, (max(i) + 1) * 20 AS hi FROM sound GROUP BY source),
kept AS (SELECT source, seq, seq * 3000 AS start_ms, least(seq * 3000 + 2450, hi) AS end_ms FROM (SELECT source, hi, unnest(range(0, (hi - 1) // 3000 + 1)) AS seq FROM ke))"""
WORDS_SQL = rf"""toks AS (SELECT doc_id AS source, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM documents),
w0 AS (SELECT source, i - 1 AS idx, ws[i] AS text FROM (SELECT source, ws, unnest(range(1, len(ws) + 1)) AS i FROM toks)),
w1 AS (SELECT *, {LETTER_MS} * length(text) + {WORD_MS} AS dur, CASE WHEN regexp_matches(text, '[.!?]$') THEN {STOP_MS} WHEN regexp_matches(text, '[,;]$') THEN {COMMA_MS} ELSE {PAUSE_MS} END AS gap FROM w0),
w2 AS (SELECT *, CAST(coalesce(sum(dur + gap) OVER (PARTITION BY source ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms FROM w1),
words AS (SELECT source, idx, text, start_ms, start_ms + dur AS end_ms FROM w2)"""
POINTS_SQL = "points AS (SELECT user_id AS source, event_id, epoch_us(ts) // 1000 AS t_ms, event_type, value FROM events)"
CUTS_SQL = f"""{POINTS_SQL},
cuts AS (SELECT source, t_ms - {CUT_MS} AS start_ms, t_ms + {CUT_MS} AS end_ms, 'e' || event_id AS why FROM points WHERE event_type = 'error'),
pauses AS (SELECT source, t_ms - 600000 AS start_ms, t_ms + 3600000 AS end_ms, 'p' || event_id AS why FROM points WHERE event_type = 'purchase'),
spans AS (SELECT source, min(t_ms) AS lo, max(t_ms) AS hi FROM points GROUP BY source)"""
FRAMES_SQL = f"{POINTS_SQL}, frames AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY t_ms, event_id) - 1 AS i, value AS level FROM points)"
PICTURES_SQL = "pictures AS (SELECT CAST(label AS BIGINT) AS source, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS sec, embedding AS vec FROM embeddings)"
