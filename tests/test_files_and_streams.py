"""Sources, sinks and streams on small files."""

import json
import time

import pytest
from pyspark.sql import functions as F

from loomline.sources import files
from loomline.streaming import utterances as st


def test_transcript_scan(spark, tmp_path):
    words = [{"text": "a", "start": 0.5, "end": 0.75, "type": "word"}, {"text": " ", "start": 0.6, "end": 0.7, "type": "spacing"}, {"text": "b", "start": None, "end": 1.0, "type": "word"}, {"text": "c", "start": 1.0, "end": 1.25, "type": "word"}]
    (tmp_path / "take1.json").write_text(json.dumps({"language_code": "en", "text": "a c", "words": words}))
    got = [tuple(r) for r in files.transcripts(spark, str(tmp_path / "*.json")).orderBy("idx").collect()]
    assert got == [("take1", 0, "a", 500, 750), ("take1", 1, "c", 1000, 1250)]
    raw = files.transcripts(spark, str(tmp_path / "*.json"))
    both = files.measured_else_raw(raw, raw.where("idx = 0").withColumn("end_ms", F.lit(700).cast("long")))
    assert [r.end_ms for r in both.orderBy("idx").collect()] == [700, 1250]


def test_cuts_decisions_and_ranges(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"start": 1.5, "end": 2, "why": "x"}\n{"start": 3, "end": 4, "why": "y", "refine_end": false}')
    got = files.cut_list(spark, str(tmp_path / "c.json")).orderBy("start_ms").collect()
    assert [(r.start_ms, r.refine_start, r.refine_end) for r in got] == [(1500, True, True), (3000, True, False)]
    (tmp_path / "d.json").write_text('{"rm": 1, "keep": 2, "why": "a"}\n{"first_removed_word_start": 3, "first_kept_word_start": 2.5, "reason": "b"}\n{"rm": 1, "keep": 2, "kind": "accuracy_flag"}')
    assert [r.refused for r in files.decisions(spark, str(tmp_path / "d.json")).collect()] == [False, True, True]
    (tmp_path / "e.json").write_text(json.dumps({"version": 1, "ranges": [{"source": "s", "start": 5.0, "end": 6.0, "beat": "B"}, {"source": "s", "start": 1.0, "end": 2.0}]}))
    ranges = files.edit_ranges(spark, str(tmp_path / "e.json"))
    assert [r.start_ms for r in ranges.orderBy("seq").collect()] == [5000, 1000]
    doc = json.loads(files.edit_document(ranges.withColumn("project", F.lit("p"))).first().value)
    assert [r["start"] for r in doc["ranges"]] == [5.0, 1.0] and doc["total_duration_s"] == 2.0


def test_captions_round_trip(spark, tmp_path):
    cues = spark.createDataFrame([(1, 0, 1230, 4560, "one, two"), (1, 1, 5000, 6000, "three")], "source long, seq long, start_ms long, end_ms long, text string")
    lines = [r.value for r in files.dialogue_lines(cues).orderBy("seq").collect()]
    (tmp_path / "x.ass").write_text("[Events]\n" + "\n".join(lines) + "\nDialogue: broken\n")
    got = files.captions(spark, str(tmp_path / "x.ass")).collect()
    assert sorted((r.start_ms, r.end_ms, r.text) for r in got if r.complete) == [(1230, 4560, "one, two"), (5000, 6000, "three")]
    assert sum(not r.complete for r in got) == 1
    assert files.srt_entries(cues).orderBy("seq").first().value == "1\n00:00:01,230 --> 00:00:04,560\none, two\n"


def test_text_rows(spark, tmp_path):
    lines = spark.createDataFrame([("1.5-2",), ("x",), ("3 4.25",)], "value string")
    assert sorted(tuple(r) for r in files.interval_rows(lines).collect()) == [(1500, 2000), (3000, 4250)]
    log = spark.createDataFrame([("k", "silence_start: 1.5 silence_end: 2.25 | silence_start: 4 silence_end: 5")], "name string, value string")
    assert [(r.seq, r.start_ms, r.end_ms) for r in files.silence_log(log, ["name"]).collect()] == [(0, 1500, 2250), (1, 4000, 5000)]
    assert files.accept_list(str(tmp_path / "none.json")) == []
    (tmp_path / "a.json").write_text('[{"phrase": "x"}]')
    with pytest.raises(ValueError):
        files.accept_list(str(tmp_path / "a.json"))


def run(query, name, tmp_path, rows):
    q = query.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"cp-{name}")).start()
    until = time.time() + 60  # timeouts keep a stateful query busy, so it is stopped when its rows are there
    while time.time() < until and query.sparkSession.table(name).count() < rows and q.isActive:
        time.sleep(0.5)
    q.stop()


def test_streams(spark, tmp_path):
    spark.createDataFrame([(1, f"2024-01-0{d} 00:00:00", "a", 1.0) for d in (1, 2, 9)], "user_id long, t string, event_type string, value double").select(
        "user_id", F.to_timestamp("t").alias("ts"), "event_type", "value").write.parquet(str(tmp_path / "e"))
    events = spark.readStream.schema("user_id long, ts timestamp, event_type string, value double").parquet(str(tmp_path / "e"))
    run(st.gap_sessions(events, "2 days", "1 hour"), "gaps", tmp_path, 1)
    assert [(r.user_id, r.n) for r in spark.table("gaps").collect()] == [(1, 2)]
    run(st.tumbling_counts(events, "1 day", "1 hour"), "days", tmp_path, 2)
    assert spark.table("days").count() == 2
    rows = [(1, 0, "one", 0, 100), (1, 1, "two", 120, 200), (1, 2, "three", 1200, 1300), (2, 0, "x", 0, 10)]
    spark.createDataFrame(rows, "source long, idx long, text string, start_ms long, end_ms long").coalesce(1).write.parquet(str(tmp_path / "w"))
    words = spark.readStream.schema("source long, idx long, text string, start_ms long, end_ms long").parquet(str(tmp_path / "w"))
    run(st.utterances(words), "said", tmp_path, 1)
    assert [(r.source, r.seq, r.text, r.n_words) for r in spark.table("said").collect()] == [(1, 0, "one two", 2)]
