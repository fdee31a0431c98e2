"""The batch operators' streaming relatives: gap sessions with late data, and utterances as a custom stateful operator."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def gap_sessions(events: DataFrame, gap: str, late: str) -> DataFrame:
    """events(user_id, ts TIMESTAMP, value): one row for each run of events without a pause of gap; rows later than late
    are dropped by the watermark."""
    found = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return found.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def tumbling_counts(events: DataFrame, width: str, late: str) -> DataFrame:
    found = events.withWatermark("ts", late).groupBy("event_type", F.window("ts", width).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return found.select("event_type", F.col("w.start").alias("start"), "n")


def utterances(words: DataFrame, pause_ms: int = 800, longest: int = 220, idle_ms: int = 60_000) -> DataFrame:
    """words(source, idx, text, start_ms, end_ms) in order of idx within each source: an utterance ends at a pause or
    when it is longer than longest letters. An unfinished one waits in state and is given out after idle_ms without
    words; the state of a source holds that one utterance only."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        source = key[0]
        seq, start, end, n, text = state.get if state.exists else (0, 0, 0, 0, "")
        out = []
        if state.hasTimedOut:
            if n:
                yield pd.DataFrame([(source, seq, start, end, n, text)], columns=COLUMNS)
            state.update((seq + 1 if n else seq, 0, 0, 0, ""))
            return
        for part in parts:
            for row in part.sort_values("idx").itertuples():
                if n and (row.start_ms - end >= pause_ms or len(text) > longest):
                    out.append((source, seq, start, end, n, text))
                    seq, n, text = seq + 1, 0, ""
                if not n:
                    start = row.start_ms
                n, end, text = n + 1, row.end_ms, f"{text} {row.text}".strip()
        state.update((seq, int(start), int(end), n, text))
        state.setTimeoutDuration(idle_ms)
        if out:
            yield pd.DataFrame(out, columns=COLUMNS)

    return words.groupBy("source").applyInPandasWithState(step, SCHEMA, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


COLUMNS = ["source", "seq", "start_ms", "end_ms", "n_words", "text"]
SCHEMA = "source long, seq long, start_ms long, end_ms long, n_words long, text string"
STATE = "seq long, start_ms long, end_ms long, n_words long, text string"
