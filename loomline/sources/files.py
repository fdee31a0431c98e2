"""Sources and sinks: transcripts, cut lists, decisions, caption files, interval rows, silence logs; JSON, captions.

Schemas are declared; nothing is inferred, and no file is executed.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.functions.text import clock_cue, clock_srt

TRANSCRIPT = "language_code string, text string, words array<struct<text string, start double, end double, type string>>"
CUT = "start double, end double, why string, keep_tail double, refine_start boolean, refine_end boolean"
DECISION = "id string, kind string, rm double, keep double, why string, first_removed_word_start double, first_kept_word_start double, reason string"
EDL = ("version int, sources map<string,string>, av_offset_s map<string,double>, grade string, ranges array<struct<source string, start double, end double, beat string, reason string>>, "
       "subtitles string, total_duration_s double")


def ms(seconds: Column) -> Column:
    return F.round(seconds * 1000).cast("long")


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """One row for each timed word: source (the file's name), idx, text, start_ms, end_ms."""
    docs = spark.read.schema(TRANSCRIPT).option("multiLine", True).option("mode", "FAILFAST").json(path)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)
    kept = F.filter("words", lambda w: (w["type"] == "word") & w["start"].isNotNull())
    rows = docs.select(name.alias("source"), F.posexplode(kept).alias("idx", "w"))
    return rows.select("source", F.col("idx").cast("long").alias("idx"), "w.text", ms(F.col("w.start")).alias("start_ms"), ms(F.col("w.end")).alias("end_ms"))


MEASURED = "text string, start double, end double, logged_start double, logged_end double"


def write_measured(words: DataFrame, path: str) -> None:
    """Measured words (source, idx, text, start_ms, end_ms, logged_start, logged_end), in seconds, as JSON lines by source, a
    source's in order."""
    sec = lambda c: F.round(F.col(c) / 1000.0, 3)
    rows = words.select("source", "idx", "text", sec("start_ms").alias("start"), sec("end_ms").alias("end"), sec("logged_start").alias("logged_start"), sec("logged_end").alias("logged_end"))
    rows.repartition("source").sortWithinPartitions("source", "idx").write.partitionBy("source").json(path)


def measured_words(spark: SparkSession, path: str) -> DataFrame:
    """What write_measured wrote: source, idx, text and the four times in ms."""
    rows = spark.read.schema(f"source string, idx long, {MEASURED}").option("mode", "FAILFAST").json(path)
    return rows.select("source", "idx", "text", ms(F.col("start")).alias("start_ms"), ms(F.col("end")).alias("end_ms"), ms(F.col("logged_start")).alias("logged_start"), ms(F.col("logged_end")).alias("logged_end"))


def measured_else_raw(raw: DataFrame, measured: DataFrame, required: bool = False) -> DataFrame:
    """Each word with its measured extent where there is one, else its logged one; required: a source of which no word was
    measured is an error."""
    if required:
        missing = raw.select("source").distinct().join(measured.select("source").distinct(), "source", "left_anti").limit(3).collect()
        if missing:
            raise ValueError(f"not measured: {', '.join(str(r.source) for r in missing)}")
    m = measured.select("source", "idx", F.col("start_ms").alias("m_start"), F.col("end_ms").alias("m_end"))
    return raw.join(m, ["source", "idx"], "left").select("source", "idx", "text", F.coalesce("m_start", "start_ms").alias("start_ms"), F.coalesce("m_end", "end_ms").alias("end_ms"),
                                                          F.col("start_ms").alias("logged_start"), F.col("end_ms").alias("logged_end"))


def cut_list(spark: SparkSession, path: str) -> DataFrame:
    cuts = spark.read.schema(CUT).option("mode", "FAILFAST").json(path)
    return cuts.select(ms(F.col("start")).alias("start_ms"), ms(F.col("end")).alias("end_ms"), "why", F.coalesce("keep_tail", F.lit(0.0)).alias("keep_tail"),
                       F.coalesce("refine_start", F.lit(True)).alias("refine_start"), F.coalesce("refine_end", F.lit(True)).alias("refine_end"))


def decisions(spark: SparkSession, path: str) -> DataFrame:
    """Two spellings of the keys; a flag is no cut."""
    rows = spark.read.schema(DECISION).option("mode", "FAILFAST").json(path)
    return rows.select("id", "kind", ms(F.coalesce("rm", "first_removed_word_start")).alias("rm_ms"), ms(F.coalesce("keep", "first_kept_word_start")).alias("keep_ms"), F.coalesce("why", "reason").alias("why"),
                       (F.col("kind").eqNullSafe("accuracy_flag") | (F.coalesce("keep", "first_kept_word_start") <= F.coalesce("rm", "first_removed_word_start"))).alias("refused"))


def edit_ranges(spark: SparkSession, path: str) -> DataFrame:
    """The ranges of an edit document, in the order they are delivered."""
    doc = spark.read.schema(EDL).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return doc.select(F.posexplode("ranges").alias("seq", "r")).select(F.col("seq").cast("long").alias("seq"), "r.source", ms(F.col("r.start")).alias("start_ms"), ms(F.col("r.end")).alias("end_ms"), "r.beat", "r.reason")


def accept_list(path: str) -> list[dict]:
    """A small file read on the driver; a missing one is empty, a broken one is an error."""
    file = Path(path)
    found = json.loads(file.read_text()) if file.exists() else []
    for entry in found:
        if not entry.get("phrase") or not entry.get("reason"):
            raise ValueError(f"an accepted phrase needs its reason: {entry}")
    return found


def dialogue_fields(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Dialogue rows (value) as keys, start_ms, end_ms, text and complete: whether there are ten fields, the text being all
    that follows the ninth comma."""
    f = F.split(F.regexp_replace("value", "^Dialogue: *", ""), ",", 10)

    def at(c: Column) -> Column:
        p = F.split(c, "[:.]")
        return (((F.try_element_at(p, F.lit(1)).cast("long") * 60 + F.try_element_at(p, F.lit(2)).cast("long")) * 60 + F.try_element_at(p, F.lit(3)).cast("long")) * 1000 + F.try_element_at(p, F.lit(4)).cast("long") * 10)

    return lines.select(*keys, at(F.get(f, 1)).alias("start_ms"), at(F.get(f, 2)).alias("end_ms"), F.get(f, 9).alias("text"), (F.size(f) == 10).alias("complete"))


def captions(spark: SparkSession, path: str) -> DataFrame:
    """Dialogue rows of caption files: file, start_ms, end_ms, text, complete (ten fields)."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), "value").where(F.col("value").startswith("Dialogue:"))
    return dialogue_fields(lines, ["file"])


def interval_rows(lines: DataFrame) -> DataFrame:
    """value: "start end" or "start-end" in seconds; other lines are skipped."""
    pattern = r"^\s*(\d+(?:\.\d+)?)[ -]+(\d+(?:\.\d+)?)\s*$"
    rows = lines.where(F.col("value").rlike(pattern))
    return rows.select(*(ms(F.regexp_extract("value", pattern, i).cast("double")).alias(n) for i, n in ((1, "start_ms"), (2, "end_ms"))))


def silence_log(lines: DataFrame, keys: list[str]) -> DataFrame:
    """value: a log with silence_start and silence_end entries; their pairs in order."""
    num = r"silence_{0}: *(-?\d+(?:\.\d+)?)"
    pairs = F.arrays_zip(F.regexp_extract_all("value", F.lit(num.format("start")), 1).alias("a"), F.regexp_extract_all("value", F.lit(num.format("end")), 1).alias("b"))
    rows = lines.select(*keys, F.posexplode(pairs).alias("seq", "p"))
    return rows.select(*keys, "seq", ms(F.col("p")["a"].cast("double")).alias("start_ms"), ms(F.col("p")["b"].cast("double")).alias("end_ms"))


def edit_document(ranges: DataFrame, sources: dict[str, str] | None = None, offsets: dict[str, float] | None = None, grade: str = "", subtitles: str = "master.ass") -> DataFrame:
    """One JSON document a project from ranges(project, seq, source, start_ms, end_ms, beat, reason), in order. sources: the
    file of each source; offsets: by how many seconds its sound runs ahead."""
    sec = lambda c: F.round(F.col(c) / 1000.0, 2)
    entry = F.struct("seq", "source", sec("start_ms").alias("start"), sec("end_ms").alias("end"), "beat", "reason")
    named = lambda m, kind: F.create_map(*(F.lit(x) for pair in m.items() for x in pair)) if m else F.create_map().cast(f"map<string,{kind}>")
    doc = ranges.groupBy("project").agg(F.array_sort(F.collect_list(entry)).alias("ranges"), F.round(F.sum(F.col("end_ms") - F.col("start_ms")) / 1000.0, 3).alias("total_duration_s"))
    fields = [F.lit(1).alias("version"), named(sources, "string").alias("sources"), named(offsets, "double").alias("av_offset_s"), F.lit(grade).alias("grade"),
              F.transform("ranges", lambda r: r.dropFields("seq")).alias("ranges"), F.array().cast("array<string>").alias("overlays"), F.lit(subtitles).alias("subtitles"), "total_duration_s"]
    return doc.select("project", F.to_json(F.struct(*fields)).alias("value"))


def dialogue_lines(cues: DataFrame) -> DataFrame:
    """Caption file rows: source, seq, value."""
    value = F.format_string("Dialogue: 0,%s,%s,Default,,0,0,0,,%s", clock_cue(F.col("start_ms")), clock_cue(F.col("end_ms")), F.regexp_replace("text", "\n", r"\\N"))
    return cues.select("source", "seq", value.alias("value"))


def srt_entries(cues: DataFrame) -> DataFrame:
    counter = F.row_number().over(Window.partitionBy("source").orderBy("seq"))
    return cues.select("source", "seq", F.format_string("%d\n%s --> %s\n%s\n", counter, clock_srt(F.col("start_ms")), clock_srt(F.col("end_ms")), F.col("text")).alias("value"))


def stamp(text: Column, name: str) -> Column:
    """A number that a caption file's header carries under that name; null if it has none."""
    return F.nullif(F.regexp_extract(text, rf"(?m)^;\s*{name}:\s*([\d.]+)", 1), F.lit("")).cast("double")


def config(path: str) -> dict:
    """A project's settings, read on the driver: a missing file is empty, a broken one is an error."""
    file = Path(path)
    found = json.loads(file.read_text()) if file.exists() else {}
    if not isinstance(found, dict):
        raise ValueError(f"{path} must hold one JSON object")
    return found


def wait_cuts(lines: DataFrame) -> DataFrame:
    """value: rows of a pause-cut table as text, (start, end, 'reason', ..) in seconds; those whose reason names a wait."""
    pattern = r"\(\s*([\d.]+),\s*([\d.]+),\s*'[^']*?[\d.]+s wait"
    found = lines.where(F.col("value").rlike(pattern))
    return found.select(*(ms(F.regexp_extract("value", pattern, i).cast("double")).alias(n) for i, n in ((1, "start_ms"), (2, "end_ms"))))


def pause_cut_lines(cuts: DataFrame) -> DataFrame:
    """pause cuts (source, start_ms, end_ms, why) as rows of a table in seconds: source, start_ms, value."""
    value = F.format_string("    (%8.2f, %8.2f, '%s', 0.0, False, False),", F.col("start_ms") / 1000.0, F.col("end_ms") / 1000.0, "why")
    return cuts.select("source", "start_ms", value.alias("value"))


#: Endings of recordings, the one that is taken first.
ENDINGS = (".mov", ".mp4")


def recordings(folder: str) -> dict[str, str]:
    """take -> file of a project's recordings: names that begin with take, the first ending of ENDINGS where there are two."""
    found: dict[str, str] = {}
    rank = lambda f: (ENDINGS.index(f.suffix.lower()), f.suffix.islower() is False)
    for file in sorted((f for f in Path(folder).glob("take*") if f.suffix.lower() in ENDINGS), key=rank):
        found.setdefault(file.stem, str(file))
    return dict(sorted(found.items()))


def caption_header(title: str, total_ms: int, fps: float, settings: dict) -> str:
    """What stands before a caption file's rows: the grid they were laid on, the picture's size and the style."""
    c = {"play_w": 3840, "play_h": 2160, "font": "Arial", "font_size": 96, "outline": 5, "shadow": 0, "margin_h": 200, "margin_v": 120} | settings
    style = f"Cap,{c['font']},{c['font_size']},&H00FFFFFF,&H00FFFFFF,&H00101010,&H80000000,0,0,0,0,100,100,0,0,1,{c['outline']},{c['shadow']},2,{c['margin_h']},{c['margin_h']},{c['margin_v']},1"
    return "\n".join(["[Script Info]", f"Title: {title} captions", f"; grid-offset-total: {total_ms / 1000:.6f}", f"; grid-fps: {fps:g}", "ScriptType: v4.00+", "WrapStyle: 0", "ScaledBorderAndShadow: yes",
                      f"PlayResX: {c['play_w']}", f"PlayResY: {c['play_h']}", "", "[V4+ Styles]",
                      "Format: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding",
                      f"Style: {style}", "", "[Events]", "Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text", ""])


def caption_style(lines: DataFrame) -> DataFrame:
    """The picture's size and the style of a caption file: file, play_w, play_h, font, font_size, margin_v."""
    v, style = F.col("value"), F.split(F.regexp_replace("value", "^Style: *", ""), ",")
    number = lambda name: F.max(F.when(v.startswith(f"{name}:"), F.regexp_extract(v, r":\s*(\d+)", 1).cast("long")))
    is_style = v.startswith("Style: ")
    return lines.groupBy("file").agg(number("PlayResX").alias("play_w"), number("PlayResY").alias("play_h"), F.max(F.when(is_style, F.get(style, 1))).alias("font"),
                                     F.max(F.when(is_style, F.get(style, 2).cast("long"))).alias("font_size"), F.max(F.when(is_style, F.get(style, 21).cast("long"))).alias("margin_v"))


#: The grades that have a name.
GRADES = {"subtle": "eq=contrast=1.03:saturation=0.98", "neutral_punch": "eq=contrast=1.06:brightness=0.0:saturation=1.0,curves=master='0/0 0.25/0.23 0.75/0.77 1/1'",
          "warm_cinematic": "eq=contrast=1.12:brightness=-0.02:saturation=0.88,colorbalance=rs=0.02:gs=0.0:bs=-0.03:rm=0.04:gm=0.01:bm=-0.02:rh=0.08:gh=0.02:bh=-0.05,curves=master='0/0 0.25/0.22 0.75/0.78 1/1'",
          "none": ""}
AUTO = "__AUTO__"


def grade_of(grade: Column, named: dict[str, str] | None = None) -> Column:
    """A grade as a filter: a name becomes its filter, "auto" is left for later, anything else is a filter as it stands."""
    names = GRADES if named is None else named
    known = F.create_map(*(F.lit(x) for pair in names.items() for x in pair)) if names else F.create_map(F.lit(""), F.lit(""))
    text = F.coalesce(grade, F.lit(""))
    return F.when(text == "auto", AUTO).when(text.rlike(r"^[a-zA-Z0-9_\-]+$"), F.coalesce(F.try_element_at(known, text), text)).otherwise(text)
