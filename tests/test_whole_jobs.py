"""Queries that do the whole job, held against their oracles and plain counts."""

import random
import re

from loomline import catalogue
from loomline.operators import edges, sequences
from loomline.plans import gate
from tests.same import oracle_rows, rows


def save(spark, tmp_path, **tables):
    for name, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_topic_overlap_by_card_and_time(spark, tmp_path):
    turns = [(1, 0, "user", "Alpha beta gamma delta"), (1, 1, "assistant", "alpha, BETA!"), (1, 5, "user", "alpha beta gamma"), (2, 0, "user", "One two three four five"), (2, 1, "assistant", "one"),
             (3, 0, "user", "one two three four five"), (3, 1, "assistant", "one six"), (4, 0, "user", "the of"), (4, 1, "assistant", "the of"), (5, 0, "user", None), (5, 1, "assistant", "x")]
    at = save(spark, tmp_path, conversations=(turns, "conv_id long, turn long, role string, text string"))
    got = sorted((r.conv_id, r.turn) for r in catalogue.QUERIES["topic_overlap_suppression"](spark, at).collect())
    # Two shared words drop (1, 0); (1, 5) comes too late for the card; one is enough for the lower third of 2, not for the
    # card of 3; words without content and no words at all share nothing.
    assert got == [(1, 5), (3, 0), (4, 0), (5, 0)]


def test_token_frequency_lists_every_latin_token(spark, sf_dir, duck, tmp_path):
    name = "token_frequency_first_seen"
    assert rows(catalogue.QUERIES[name](spark, sf_dir)) == oracle_rows(duck, catalogue.ORACLES[name])
    docs = [(3, "a b2.c-d_e a"), (2, "x " + "a " * 9), (1, "9a. é"), (4, ""), (5, None)]
    got = {r.token: (r.n, r.first_at, r.firsts) for r in catalogue.QUERIES[name](spark, save(spark, tmp_path, documents=(docs, "doc_id long, text string"))).collect()}
    assert got == {"a": (11, 2_000_001, [2_000_000 + i for i in range(1, 9)]), "a.": (1, 1_000_000, [1_000_000]), "b2.c-d_e": (1, 3_000_001, [3_000_001]), "x": (1, 2_000_000, [2_000_000])}


def test_time_formats_takes_every_word(spark, sf_dir, duck, tmp_path):
    name = "time_formats"
    got = rows(catalogue.QUERIES[name](spark, sf_dir))
    assert got == oracle_rows(duck, catalogue.ORACLES[name])
    assert sum(got[1].values()) == catalogue.QUERIES["words_with_clock"](spark, sf_dir).count()
    docs = [(1, "a bb c."), (2, "x")]
    few = catalogue.QUERIES[name](spark, save(spark, tmp_path, documents=(docs, "doc_id long, text string"))).collect()
    assert sorted((r.source, r.idx, r.srt) for r in few) == [(1, 0, "00:00:00,000"), (1, 1, "00:00:00,120"), (1, 2, "00:00:00,300"), (2, 0, "00:00:00,000")]


def test_edges_of_cuts_between_words(spark, tmp_path):
    # Words at 0-640, 660-1300, 1320-1480 and 1500-1780: a head cut, and decisions that touch and so are one.
    docs = [(1, "abcdefghij klmnopqrst uv wxyz"), (2, "a bb abcdefghi"), (3, "x")]
    got = catalogue.QUERIES["edge_from_words"](spark, save(spark, tmp_path, documents=(docs, "doc_id long, text string"))).collect()
    one, two = sorted(got, key=lambda r: r.source)
    # Removed words 0 to 2: the next one starts 20 ms after the last; no lead-in of 250 ms fits.
    assert (one.i, one.j, one.why, one.a_ms, one.b_ms, one.before, one.dropped, one.after) == (0, 3, "d0 | d1", 0, 1490, "", "abcdefghij klmnopqrst uv", "wxyz")
    # The last word of all: the cut has no end of its own.
    assert (two.i, two.j, two.a_ms, two.b_ms, two.before, two.after, two.collapsed) == (2, 3, 290, None, "a bb", "", False)


def dealt(df):
    """What a query's own exchanges are dealt by."""
    return re.findall(r"hashpartitioning\(([^()]*?), \d+\)", re.sub(r"#\d+L?", "", df._jdf.queryExecution().executedPlan().toString()))


def test_accepted_grams_send_no_words(spark, sf_dir):
    hits = gate.gram_hits(spark, sf_dir)
    # Texts are dealt by source, and nothing after that by a word's place.
    assert dealt(hits) and set(dealt(hits)) == {"source"}


def test_cuts_between_words_send_no_words(spark, sf_dir, tmp_path):
    assert set(dealt(catalogue.QUERIES["edge_from_words"](spark, sf_dir))) == {"source"}
    # Decisions that overlap and touch are one cut, one that reaches past the last word is none; words on both sides stay.
    texts = "a b c d e f g h i j k".split()
    words = [(1, i, t, 100 * i, 100 * i + 60, {2: 4, 3: 5, 5: 6, 9: 12}.get(i), f"d{i}" if i in (2, 3, 5, 9) else None) for i, t in enumerate(texts)]
    got = edges.word_cuts(spark.createDataFrame(words, "source long, idx long, text string, start_ms long, end_ms long, j long, why string")).collect()
    assert [(r.i, r.j, r.why, r.before, r.dropped, r.after, r.a_ms, r.b_ms) for r in got] == [(2, 6, "d2 | d3 | d5", "a b", "c d e f", "g h i j", 180, 580)]


def test_repeats_sort_hashes_alone(spark, sf_dir, tmp_path):
    plan = re.sub(r"#\d+L?", "", catalogue.QUERIES["ngram_repeats_authoring"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString())
    # No sort holds a word: one row is the place and one hash, then the place and two hashes of the run.
    assert "lead(CASE WHEN" not in plan and "xxhash64(norm" not in plan.split("Sort [source ASC NULLS FIRST, idx ASC NULLS FIRST]")[0]
    assert plan.count("Window [") == 2
    rng = random.Random(3)
    docs = {s: [rng.choice("abc") for _ in range(150)] for s in range(4)}
    words = spark.createDataFrame([(s, i, w) for s, ws in docs.items() for i, w in enumerate(ws)], "source long, idx long, norm string")
    for sought, drop in (((4, 70, 1),), True), (((3, 8, 2), (6, 40, 3), (4, 5, 1)), False):
        want = set()
        for s, ws in docs.items():
            for n, window, distinct in sought:
                for i in range(len(ws) - n + (0 if drop else 1)):
                    last = [j for j in range(i) if ws[j : j + n] == ws[i : i + n]]
                    if last and i - last[-1] <= window and len(set(ws[i : i + n])) >= distinct:
                        want.add((s, i, n, i - last[-1]))
        assert {tuple(r) for r in sequences.repeats(words, list(sought), drop_last=drop).collect()} == want


def test_nearest_quiet_point_takes_every_frame(spark, sf_dir, duck):
    name = "nearest_quiet_point"
    got = rows(catalogue.QUERIES[name](spark, sf_dir))
    assert got == oracle_rows(duck, catalogue.ORACLES[name])
    assert sum(got[1].values()) == spark.read.parquet(f"{sf_dir}/events.parquet").count()
