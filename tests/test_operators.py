"""Properties of the interval algebra, folds against plain Python, gates against planted defects."""

import random

import pytest
from pyspark.sql import functions as F

from loomline.functions.text import norm
from loomline.operators import gates, joins
from loomline.operators import intervals as iv
from loomline.operators import sequences as sq


def made(seed, n, sources=3, span=5000, longest=400):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        a = rng.randrange(span)
        out.append((rng.randrange(sources), a, a + rng.randint(1, longest)))
    return out


def covered(rows, source, span=6000):
    mask = [False] * span
    for s, a, b in rows:
        if s == source:
            mask[a:b] = [True] * (b - a)
    return mask


def table(spark, rows):
    return spark.createDataFrame(rows, "source long, start_ms long, end_ms long")


def pick(df):
    return [(r.source, r.start_ms, r.end_ms) for r in df.collect()]


@pytest.mark.parametrize("seed", [1, 2])
def test_union_and_complement_split_the_whole(spark, seed):
    rows = made(seed, 40)
    merged = iv.union(table(spark, rows))
    spans = spark.createDataFrame([(s, 0, 6000) for s in range(4)], "source long, lo long, hi long")
    kept, cut = pick(iv.complement(merged, spans)), pick(merged)
    for s in range(4):
        mask = covered(rows, s)
        assert covered(cut, s) == mask
        assert covered(kept, s) == [not x for x in mask]
    assert sorted(pick(iv.union(merged))) == sorted(cut)
    assert (3, 0, 6000) in kept  # no cuts: the whole span


def test_intersect_and_subtract(spark):
    a, b = pick(iv.union(table(spark, made(3, 30)), 1)), pick(iv.union(table(spark, made(4, 30)), 1))
    both = pick(iv.intersect(table(spark, a), table(spark, b), 100))
    rest = pick(iv.subtract(table(spark, a), table(spark, b), 1, 100))
    for s in range(3):
        x, y = covered(a, s), covered(b, s)
        assert covered(both, s) == [p and q for p, q in zip(x, y)]
        assert covered(rest, s) == [p and not q for p, q in zip(x, y)]


def test_touching_and_bridged(spark):
    df = table(spark, [(1, 0, 10), (1, 10, 20), (1, 25, 30)])
    assert len(pick(iv.union(df, 0))) == 3
    assert len(pick(iv.union(df, 1))) == 2
    assert len(pick(iv.union(df, 6))) == 1


def test_quantise_rounds_before_it_rounds_up(spark):
    got = spark.createDataFrame([(71_700,), (71_701,), (0,)], "ms long").select(iv.quantised(F.col("ms"), 30.0).alias("q")).collect()
    assert [r.q for r in got] == [2151, 2152, 0]


def test_empty_inputs(spark):
    none = table(spark, [])
    assert pick(iv.union(none)) == []
    assert pick(iv.intersect(none, none, 10)) == []


def test_asof_prefers_equal_times(spark):
    left = spark.createDataFrame([(1, 10), (1, 9), (1, 0), (2, 5)], "source long, t long")
    right = spark.createDataFrame([(1, 5, "a"), (1, 10, "b")], "source long, s long, v string")
    back = {(r.source, r.t): r.v for r in joins.asof(left, right, "t", "s", ["v"]).collect()}
    ahead = {(r.source, r.t): r.v for r in joins.asof(left, right, "t", "s", ["v"], "forward").collect()}
    assert back == {(1, 10): "b", (1, 9): "a", (1, 0): None, (2, 5): None}
    assert ahead == {(1, 10): "b", (1, 9): "b", (1, 0): "a", (2, 5): None}


def words(spark, texts):
    rows, t = [], 0
    for i, w in enumerate(texts):
        rows.append((1, i, w, t, t + 100))
        t += 1000 if w.endswith(".") else 120
    return spark.createDataFrame(rows, "source long, idx long, text string, start_ms long, end_ms long")


def test_greedy_suppression_against_a_loop(spark):
    rng = random.Random(5)
    df = sq.with_norm(words(spark, [rng.choice(["ab", "cd", "ef", "gh"]) for _ in range(150)]))
    hits = sq.gate_repeats(df)
    got = sorted((r.idx, r.n) for r in sq.spaced(hits).collect())
    stand = []
    for n, i in sorted({(-r.n, r.idx) for r in hits.collect()}):
        if all(abs(i - j) >= sq.SPACING for j, _ in stand):
            stand.append((i, -n))
    assert got == sorted(stand)


def test_folds(spark):
    texts = ["one", "two.", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve."]
    found = sq.grouped(words(spark, texts), sq.stop_cue).orderBy("seq").collect()
    assert found[0].text == "one two." and " ".join(r.text for r in found) == " ".join(texts)
    assert sum(r.n_words for r in found) == len(texts)
    timed = sq.cue_times(sq.grouped(words(spark, texts), sq.stop_cue)).orderBy("seq").collect()
    assert all(a.end_ms <= b.start_ms for a, b in zip(timed, timed[1:]))


def test_common_order():
    assert sq.common_order(["a", "b", "c"], ["b", "x", "c"]) == 2
    assert sq.common_order([], ["a"]) == 0


def test_text_functions(spark):
    assert spark.createDataFrame([("Él-ـx!",)], "t string").select(norm(F.col("t"))).first()[0] == "élx"


def test_gates_refuse_planted_defects(spark, tmp_path):
    good = table(spark, [(1, 0, 10)])
    with pytest.raises(gates.GateError):
        gates.publish(good, str(tmp_path / "x"), {"stray": good})
    gates.publish(good, str(tmp_path / "y"), {"stray": good.where("false")})
    assert spark.read.parquet(str(tmp_path / "y")).count() == 1
    found = gates.findings(good, {"too short": "end_ms - start_ms < 20", "negative": "start_ms < 0"}, ["source"])
    assert gates.report(good, found) == {"measured": 1, "failed": {"too short": 1}, "passed": False}
    assert not gates.report(good.where("false"), found.where("false"))["passed"]
    with pytest.raises(ValueError):
        gates.accepted(found, [{"phrase": "x"}], "failed")
    assert gates.accepted(found, [{"phrase": "too short", "reason": "known"}], "failed").count() == 0
