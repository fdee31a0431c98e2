"""Rules of edges, captions, accepts and folds against plain versions."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from loomline.functions import captions as cp
from loomline.operators import accepts as ac
from loomline.operators import edges as ed
from loomline.operators import sequences as sq
from loomline.sources import files


def words_of(seed, n=60, gap=60):
    rng, t, out = random.Random(seed), 0, []
    for i in range(n):
        t += rng.randint(0, gap)
        end = t + rng.randint(20, 300)
        out.append((1, i, f"w{i}", t, end))
        t = end
    return out


@pytest.mark.parametrize("forward", [True, False])
def test_points_walk_out_of_words(spark, forward):
    words = words_of(3)
    points = [(1, i, t) for i, t in enumerate(range(0, words[-1][4] + 200, 7))]

    def walk(t, slack, rounds, after, before):
        for _ in range(rounds):
            hit = next((w for w in words if w[3] + slack < t < w[4] - slack), None)
            if hit is None:
                break
            t = hit[4] + after if after is not None else hit[3] - before
        return t

    w, p = spark.createDataFrame(words, "source long, idx long, text string, start_ms long, end_ms long"), spark.createDataFrame(points, "source long, id long, t long")
    got = {r.id: r.t for r in ed.snapped(p, w, forward).collect()}
    assert got == {i: walk(t, 10, 8, 50 if forward else None, 50) for _, i, t in points}
    assert {r.id: r.t for r in ed.settled(p, w).collect()} == {i: walk(t, 0, 4, None, 10) for _, i, t in points}
    assert ed.snapped(p.where("false"), w, forward).count() == 0
    assert {r.id: r.t for r in ed.snapped(p, w.where("false"), forward).collect()} == {i: t for _, i, t in points}


def plain_clean(text, corrections=()):
    for a, b in corrections:
        text = text.replace(a, b)
    text = re.sub("(?<![ء-ي])[ء-ي]\\s*-\\s*(?=[ء-ي])", "", text)
    out = []
    for token in text.split():
        core = token
        while core and core[-1] in cp.MARKS:
            core = core[:-1]
        if "-" in core and any("ء" <= c <= "ي" for c in core):
            if core.endswith("-"):
                continue
            token = core[core.rindex("-") + 1 :] + token[len(core) :]
        if not token or (len(token) == 1 and "ء" <= token <= "ي" and token != cp.ALONE) or all(c in cp.MARKS + "-" for c in token):
            continue
        out.append(token)
    text = re.sub(f"\\s+([{cp.MARKS}])", "\\1", " ".join(out)).strip()
    while text and text[-1] in cp.MARKS:
        text = text[:-1]
    return text.strip()


def test_clean_texts(spark):
    rng = random.Random(2)
    bits = ["شرح", "هون", "ال-الجهاز", "زاو-", "فواتير--", "م -مشروع", "ت-تجهز", "،", "و", "ب", "well-known", "x-", "--", ".claude", "end.", "a", "؟", "آآآ،", "2024-01-02", "مـ-ملف،", "word ,", "…"]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randint(0, 9))) for _ in range(400)] + ["", " ", "،،", "a-ب- ج"]
    corrections = (("آآآ", ""), ("well-known", "known"))
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").select("i", "t", cp.clean(F.col("t")).alias("a"), cp.clean(F.col("t"), corrections).alias("b")).collect()
    for r in got:
        assert (r.a, r.b) == (plain_clean(r.t), plain_clean(r.t, corrections)), r.t


def test_right_to_left_letters(spark):
    points = [c for c in range(0x20, 0x30000) if not 0xD800 <= c < 0xE000]
    got = {r.c for r in spark.createDataFrame([(c, chr(c)) for c in points], "c long, t string").where(cp.has_rtl(F.col("t"))).collect()}
    assert got == {c for c in points if unicodedata.bidirectional(chr(c)) in ("R", "AL") and unicodedata.category(chr(c)).startswith("L")}
    assert cp.embedded("10 minutes, later،") == "10 minutes, later،" and cp.embedded("قبل Claude") == f"{cp.EMBED}قبل Claude{cp.POP}"


def test_wrapped_lines():
    assert cp.wrap("one two three four five six seven eight") == ["one two three four five", "six seven eight"]
    assert cp.wrap("short") == ["short"] and cp.wrap("") == []
    # A prefix goes down to its word; a short last word is not left alone; a phrase stays in one line.
    assert [x.strip(cp.EMBED + cp.POP) for x in cp.wrap("الهدف من هذا إنه هو الـ graphic designer")] == ["الهدف من هذا إنه هو", "الـ graphic designer"]
    assert cp.wrap("the quick brown fox jumped to", 24) == ["the quick brown fox", "jumped to"]
    assert cp.wrap("we meet again on 22 October", 19, 2, ("22 October",)) == ["we meet again on", "22 October"]
    for text in ("a b c d e f g h i j k l m n o p q r s t u v w x y z a b c d", "word " * 30):
        lines = cp.wrap(text)
        assert len(lines) <= 2 and " ".join(lines).split() == text.split()


def test_accepted_phrases(spark):
    table = lambda *p: spark.createDataFrame([(x, "why") for x in p], "phrase string, reason string")
    found = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a", "x", "c"]), (3, ["b", "c", "d"]), (4, ["q"])], "id long, gram array<string>")
    left = lambda *p: sorted(r.id for r in ac.gram_not_listed(found, table(*p), "gram").collect())
    assert left("A b!") == [2, 3, 4]  # begins the gram
    assert left("b  c d e") == [1, 2, 4]  # the gram begins the phrase
    assert left("a", "q") == [1, 2, 3, 4]  # one word accepts nothing
    assert sorted(r.id for r in ac.run_not_listed(found, table("a B c", "b c"), "gram").collect()) == [2, 3, 4]
    texts = spark.createDataFrame([(1, "so  so"), (2, "so so so")], "id long, t string")
    assert [r.id for r in ac.not_listed(texts, table(" so so "), "t").collect()] == [2]
    with pytest.raises(ValueError):
        ac.checked(spark.createDataFrame([("x", " ")], "phrase string, reason string"))


def test_greedy_suppression(spark):
    rng = random.Random(8)
    hits = [(s, rng.randint(3, 6), rng.randint(0, 400)) for s in range(3) for _ in range(150)]
    want = []
    for s in range(3):
        stays = []
        for n, i in sorted({(-n, i) for x, n, i in hits if x == s}):
            if all(abs(i - j) >= 8 for j, _ in stays):
                stays.append((i, -n))
        want += [(s, i, n) for i, n in stays]
    got = sq.spaced(spark.createDataFrame(hits, "source long, n long, idx long")).collect()
    assert sorted((r.source, r.idx, r.n) for r in got) == sorted(want)


def test_project_files(spark, tmp_path):
    assert files.config(str(tmp_path / "none.json")) == {}
    (tmp_path / "p.json").write_text('{"render": {"fps": 25}}')
    assert files.config(str(tmp_path / "p.json"))["render"]["fps"] == 25
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(ValueError):
        files.config(str(tmp_path / "bad.json"))
    for name in ("take2.mp4", "take1.mp4", "take1.mov", "other.mov", "take3.txt"):
        (tmp_path / name).write_text("")
    assert {k: v.rsplit("/", 1)[1] for k, v in files.recordings(str(tmp_path)).items()} == {"take1": "take1.mov", "take2": "take2.mp4"}
    cuts = spark.createDataFrame([(1, 1230, 4560, "5.2s wait, trimmed to 1.2s"), (1, 5000, 6000, "0.90s wordless")], "source long, start_ms long, end_ms long, why string")
    lines = files.pause_cut_lines(cuts)
    assert [tuple(r) for r in files.wait_cuts(lines).collect()] == [(1230, 4560)]
    header = files.caption_header("x", 12345, 30.0, {"font": "Noto"})
    (tmp_path / "m.ass").write_text(header)
    text = spark.createDataFrame([(header,)], "value string")
    assert text.select(files.stamp(F.col("value"), "grid-offset-total").alias("a"), files.stamp(F.col("value"), "grid-fps").alias("b"), files.stamp(F.lit("none"), "grid-fps").alias("c")).first() == (12.345, 30.0, None)
    style = files.caption_style(spark.read.text(str(tmp_path / "m.ass")).withColumn("file", F.lit("m"))).first()
    assert (style.play_w, style.play_h, style.font, style.font_size, style.margin_v) == (3840, 2160, "Noto", 96, 120)
    grades = spark.createDataFrame([("subtle",), ("auto",), (None,), ("eq=gamma=1.1",), ("other",), ("none",)], "g string").select(files.grade_of(F.col("g")).alias("g"))
    assert [r.g for r in grades.collect()] == [files.GRADES["subtle"], files.AUTO, "", "eq=gamma=1.1", "other", ""]


def plain_groups(rows, ends):
    """Groups of (start, end, text): a list of texts grows until ends says so."""
    out, now = [], []
    for i, row in enumerate(rows):
        now.append(row)
        if i + 1 == len(rows) or ends(now, rows[i + 1]):
            out.append((now[0][0], now[-1][1], len(now), " ".join(x[2] for x in now)))
            now = []
    return out


def spoken_rows(seed, n=400):
    rng, t, out = random.Random(seed), 0, []
    for _ in range(n):
        text = rng.choice(["in", "the", "house", "Of", "THE", "a-b", "الـ", "و", "word.", "what?", "long, ", "x…", "abcdefghijkl"]).strip()
        out.append((t, t + 40 + 20 * len(text), text))
        t = out[-1][1] + rng.choice([10, 10, 10, 549, 550, 800, 900])
    return out


def test_folds_against_plain_ones(spark):
    rows = spoken_rows(4)
    df = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "source long, idx long, start_ms long, end_ms long, text string")
    joined = lambda now: " ".join(x[2] for x in now)
    phrases = [["in", "the", "house"], ["of", "the"]]

    def begun(now):
        tail = [sq.plain_norm(x) for x in joined(now).split()]
        return any(tail[-k:] == p[:k] for p in phrases for k in range(1, len(p)))

    rules = {
        sq.stop_utterance: lambda now, after: after[0] - now[-1][1] >= 800 or len(joined(now)) > 220,
        sq.stop_srt: lambda now, after: len(now) >= 2 or now[-1][2][-1] in ".,!?;:",
        sq.stop_prose: lambda now, after: now[-1][2][-1] in "،.؟!…" or len(now) >= 15,
        sq.cue_stop(("in the house", "of the")): lambda now, after: now[-1][2] not in cp.PREFIXES and not begun(now) and (now[-1][2][-1] in ".!؟?…" or len(joined(now)) >= 46 or after[0] - now[-1][1] >= 550),
    }
    for stop, ends in rules.items():
        got = [(r.start_ms, r.end_ms, r.n_words, r.text) for r in sq.grouped(df, stop).orderBy("seq").collect()]
        assert got == plain_groups(rows, ends)


def test_captions_of_ranges(spark):
    rows = spoken_rows(6, 250)
    df = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "source long, idx long, start_ms long, end_ms long, text string")
    ranges = [(1, k, k * 9000 + 500, k * 9000 + 7510) for k in range(rows[-1][1] // 9000 + 1)]
    got = [(r.start_ms, r.end_ms, r.text) for r in sq.caption_cues(df, spark.createDataFrame(ranges, "source long, seq long, start_ms long, end_ms long"), size=5000).orderBy("seq").collect()]
    want, out = [], 0
    for _, _, a, b in ranges:
        inside = [(max(s, a) - a + out, e - a + out, t) for s, e, t in rows if a < e <= b]
        ends = lambda now, after: now[-1][2] not in cp.PREFIXES and (now[-1][2][-1] in ".!؟?…" or len(" ".join(x[2] for x in now)) >= 46 or after[0] - now[-1][1] >= 550)
        for s, e, _, text in plain_groups(inside, ends):
            if plain_clean(text):
                want.append([s, max(min(e, s + 7000), s + 550), plain_clean(text)])
        out += -(-(b - a) * 25 // 1000) * 40
    for x, y in zip(want, want[1:]):
        x[1] = min(x[1], y[0])
    assert got == [tuple(x) for x in want]


def test_edits_are_written_or_refused(spark, tmp_path):
    from loomline.operators.gates import GateError
    from loomline.plans import chains

    words = spark.createDataFrame([(1, 0, "a", 100, 400), (1, 1, "b", 900, 1300), (1, 2, "c", 2000, 2400)], "source long, idx long, text string, start_ms long, end_ms long")
    spans = spark.createDataFrame([(1, 3000)], "source long, dur_ms long")
    cuts = spark.createDataFrame([(1, 600, 1500, "b goes"), (1, 1400, 1700, "and more"), (1, 2900, 2950, "too short")], "source long, na long, nb long, why string")
    ranges = ed.ranges_of(cuts, words, spans)
    assert [(r.start_ms, r.end_ms, r.label, r.reason) for r in ranges.orderBy("seq").collect()] == [(0, 600, "SEG-00", "Resumes after cutting: b goes + and more"), (1700, 3000, "SEG-01", "tail")]
    chains.write_edit(ranges, cuts, words, str(tmp_path / "edit"), sources={"1": "take1.mov"}, offsets={"1": 0.24})
    import json

    doc = json.loads(spark.read.parquet(str(tmp_path / "edit")).first().value)
    assert [(r["start"], r["end"]) for r in doc["ranges"]] == [(0.0, 0.6), (1.7, 3.0)] and doc["sources"] == {"1": "take1.mov"} and doc["av_offset_s"] == {"1": 0.24} and doc["total_duration_s"] == 1.9
    wrong = ranges.withColumn("end_ms", F.when(F.col("seq") == 0, 300).otherwise(F.col("end_ms")))
    with pytest.raises(GateError):
        chains.write_edit(wrong, cuts, words, str(tmp_path / "never"))
    with pytest.raises(GateError):
        chains.untightened(cuts.withColumn("why", F.lit("wait")))
    built, edits = spark.createDataFrame([(1, 5), (2, 9), (3, 1)], "source long, built_at long"), spark.createDataFrame([(1, 6), (2, 8)], "source long, edited_at long")
    assert sorted(r.source for r in chains.stale(built, edits).collect()) == [1, 3]


def test_slivers_and_protected_gaps(spark):
    words = spark.createDataFrame([(1, 0, "a", 5000, 5050)], "source long, idx long, text string, start_ms long, end_ms long")
    spans = spark.createDataFrame([(1, 10_000)], "source long, dur_ms long")
    cuts = spark.createDataFrame([(1, 1000, 2000, "x"), (1, 2080, 3000, "y"), (1, 3040, 4990, "z"), (1, 5060, 6000, "u"), (1, 6400, 6500, "short")], "source long, na long, nb long, why string")
    # 80 ms without a word and 40 ms go, 70 ms with a word stay; the cut under 150 ms is passed over.
    assert [(r.start_ms, r.end_ms) for r in ed.ranges_of(cuts, words, spans).orderBy("seq").collect()] == [(0, 1000), (4990, 5060), (6000, 10_000)]


def test_prose_of_a_cut(spark):
    rows = [(1, i, f"w{i}" + ("." if i % 4 == 3 else ""), i * 100, i * 100 + 80) for i in range(60)]
    words = spark.createDataFrame(rows, "source long, idx long, text string, start_ms long, end_ms long")
    ranges = spark.createDataFrame([(1, 0, 0, 1000), (1, 1, 3050, 4000), (2, 0, 0, 500)], "source long, seq long, start_ms long, end_ms long")
    got = [tuple(r)[1:] for r in sq.prose(words, ranges, size=700).orderBy("source", "seq", "n").collect()]
    assert got == [(0, 0, 0, None, "w0 w1 w2 w3."), (0, 1, 400, None, "w4 w5 w6 w7."), (0, 2, 800, None, "w8 w9"), (1, -1, 1000, 2050, "----"),
                   (1, 0, 950, None, "w30 w31."), (1, 1, 1150, None, "w32 w33 w34 w35."), (1, 2, 1550, None, "w36 w37 w38 w39.")]


def test_measured_words_round_trip(spark, tmp_path):
    rows = [("take1", 0, "a", 500, 750, 480, 800), ("take1", 1, "b", 1000, 1250, 1000, 1250), ("take2", 0, "c", 0, 90, 0, 300)]
    words = spark.createDataFrame(rows, "source string, idx long, text string, start_ms long, end_ms long, logged_start long, logged_end long")
    files.write_measured(words, str(tmp_path / "m"))
    assert sorted(map(tuple, files.measured_words(spark, str(tmp_path / "m")).collect())) == rows
    raw = words.select("source", "idx", "text", F.col("logged_start").alias("start_ms"), F.col("logged_end").alias("end_ms"))
    assert files.measured_else_raw(raw, words.where("source = 'take1'")).count() == 3
    with pytest.raises(ValueError):
        files.measured_else_raw(raw, words.where("source = 'take1'"), required=True)


def test_a_check_that_crashes_has_failed(spark):
    from loomline.operators import gates

    rows = spark.createDataFrame([(1, 5), (2, 50)], "id long, n long")
    checks = {"small": lambda r: gates.findings(r, {"large": "n > 10"}, ["id"]), "fine": lambda r: gates.findings(r, {"negative": "n < 0"}, ["id"]), "broken": lambda r: gates.findings(r, {"x": "no_such_column > 0"}, ["id"])}
    got = gates.passes(checks, rows)
    assert got["small"]["failed"] == {"large": 1} and got["fine"]["passed"] and not got["broken"]["passed"]
    assert gates.exit_status(got) == 2
    assert gates.exit_status(gates.passes(checks, rows.where("false"))) == 3  # nothing measured


def test_rebuilt_ranges_are_within_the_first(spark, sf_dir):
    """The chain's ranges are in order, apart, and within what the speech cuts alone leave; pauses were cut out of them."""
    from loomline import catalogue

    first = [(r.source, r.start_ms, r.end_ms) for r in catalogue.QUERIES["ranges_from_cuts"](spark, sf_dir).collect()]
    got = sorted((r.source, r.seq, r.start_ms, r.end_ms) for r in catalogue.QUERIES["rebuilt_ranges"](spark, sf_dir).collect())
    assert sum(e - s for *_, s, e in got) < sum(e - s for _, s, e in first)
    for (a, i, s, e), (b, j, s2, _) in zip(got, got[1:]):
        assert e - s > 50 and (a != b or (j == i + 1 and s2 > e))
    assert all(any(a == b and s2 <= s and e <= e2 for b, s2, e2 in first) for a, _, s, e in got)
