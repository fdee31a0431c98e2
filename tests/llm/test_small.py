"""Edge cases and plain versions of the text operators."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.llm import decontamination, jaccard, language_model, mixing, pii, quality, registry, secrets, suffix_dedup, token_counts, toxicity
from loomline.llm.hashing import shingle_sets
from tests.same import oracle_rows, rows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = ("the way of the river and the house on the hill is long and it was quiet in the morning when the people of the village went to the market with "
         "their bread and their fruit and came back in the evening with what they had bought for the children and for the old who wait at the door ")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, ties, repeated rows and one long text."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    data = [(1, PROSE, "en", "a", 1), (1, PROSE, "en", "a", 1), (2, None, None, None, None), (3, "", "en", "b", 0), (None, PROSE + "x", "en", None, 3),
            (4, long, "xx", "b", 5), (5, " \t\n", "fr", "a", 3), (6, PROSE.upper(), "en", "a", 1), (7, "ß É 日本 " + PROSE, "de", "c", 9)]
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def items(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def test_operators_take_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    clash = odd.withColumns({"size": F.lit("x"), "kept": F.lit(1), "_row": F.lit(2), "key": F.lit(3), "n_words": F.lit("y"), "taken": F.lit(0), "_text": F.lit("z")})
    runs = {
        "mix": mixing.mix_sources, "mix whole": lambda d: mixing.mix_sources(d, texts=True), "secrets": secrets.find_secrets, "quality": quality.assess,
        "tokens": token_counts.count_tokens, "jaccard": jaccard.jaccard_groups, "pii": lambda d: pii.pseudonymise(d, "k"), "repeats": suffix_dedup.cut_repeats,
        "model": language_model.score_texts, "toxicity": lambda d: toxicity.score(d, toxicity.train(d, labels)),
    }
    for name, run in runs.items():
        assert run(none).count() == 0, name
        assert run(odd).count() == odd.count(), name
        assert run(clash).count() == odd.count(), name
    # Values: ids with nulls, empties and ties are told apart, and clashing columns change nothing.
    pick = lambda df, *cols: sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    for name, columns in (("jaccard", ("doc_id", "n_shingles", "component_id")), ("tokens", ("doc_id", "n_bytes", "n_tokens", "over_limit")), ("repeats", ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")),
                          ("quality", ("doc_id", "n_words", "kept")), ("model", ("doc_id", "n_tokens", "n_known", "train_tokens")), ("secrets", ("doc_id", "n_assign", "spans"))):
        assert pick(runs[name](odd), *columns) == pick(runs[name](clash), *columns), name
        assert runs[name](none).dtypes == runs[name](odd).dtypes, name
    by = {r.doc_id: r for r in jaccard.jaccard_groups(odd).collect()}
    assert [(by[i].n_shingles, by[i].component_id) for i in (2, 3, 5)] == [(0, 2), (0, 3), (0, 5)]
    assert by[6].component_id == by[1].component_id == by[7].component_id == by[None].component_id == 1 and by[4].component_id == 4 and by[4].n_shingles == 977
    cut = {r.doc_id: r for r in suffix_dedup.cut_repeats(odd).collect()}
    assert cut[1].n_removed == cut[1].n_bytes > 200 and cut[2].n_removed == cut[3].n_removed == 0 and cut[4].n_removed == cut[4].n_bytes
    tokens = {r.doc_id: r for r in token_counts.count_tokens(odd).collect()}
    assert tokens[2].n_tokens == tokens[3].n_tokens == 0 and tokens[4].over_limit
    kept = {r.doc_id: r for r in quality.assess(odd).collect()}
    assert not any(kept[i].kept for i in (2, 3, 4, 5)) and kept[1].n_words == 59
    bench = items(spark, [PROSE, None, "", "two words"])
    for docs in (odd, clash, none):
        assert {(r.doc_id, r.item_id) for r in decontamination.search(docs, bench).collect()} == (set() if docs is none else {(1, 0), (6, 0), (7, 0), (None, 0)})
    assert decontamination.search(odd, bench.where("false")).count() == 0
    assert sorted(r.doc_id for r in decontamination.clean(clash, bench).collect()) == [2, 3, 4, 5]
    assert decontamination.clean(clash, bench).columns == clash.columns


def test_registered_oracles(spark, sf_dir, duck):
    for name, sql in registry.ORACLES.items():
        assert rows(registry.QUERIES[name](spark, sf_dir)) == oracle_rows(duck, sql), name


# ---- mixing ----


def test_mixing_fills_to_the_targets(spark):
    rng = random.Random(3)
    data = [(i, " ".join(["w"] * rng.randint(0, 60)), "en", rng.choice(["a", "b", "c", None]) if i > 5 else "z", 0) for i in range(400)]
    got = mixing.mix_sources(spark.createDataFrame(data, SCHEMA)).collect()
    by = {}
    for r in got:
        by.setdefault(r.source, [r.target, r.source_size, 0])[2] += r.taken
        assert r.taken <= 3 * r.size
    assert all(abs(taken - target) <= 1 for target, _, taken in by.values())
    assert abs(sum(t for t, _, _ in by.values()) - sum(r.size for r in got)) < 1e-6
    assert by["z"][0] == 3 * by["z"][1]  # the small source is clamped


# ---- toxicity ----


def test_machine_learns_pairs():
    rng = np.random.default_rng(1)
    texts, labels = [], []
    for _ in range(1500):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = [f"w{k}" for k in rng.integers(0, 50, 12)] + ["insult"] * a + ["people"] * b
        texts.append(toxicity.features(" ".join(words)))
        labels.append(int(a and b))
    m = toxicity.fit(texts, labels)
    score = lambda t: m.logit(np.array([m.place[s] for s in toxicity.features(t) if int(s) in m.place], np.int64))
    assert score("insult people w1") > 0 > max(score("insult w1"), score("people w1"), score("w1"))


def test_toxicity_scores_row_by_row(spark, odd):
    """The operator's scores are the machine's for each text alone, whatever the batches."""
    texts = [f"{'you idiot' if i % 3 == 0 else 'kind words'} number{i % 7} {PROSE[: i % 50]}" for i in range(120)]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)] + [(500, None, None, None, None), (501, "", "en", "b", 0)], SCHEMA)
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(120)], "doc_id long, quality int, toxic int")
    machine = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs.repartition(5), machine).collect()}
    for i, text in [*enumerate(texts), (500, ""), (501, "")]:
        logit = machine.logit(np.array([machine.place[s] for s in toxicity.features(text) if int(s) in machine.place], np.int64))
        assert abs(got[i].score - 1 / (1 + np.exp(-logit))) < 1e-4 and got[i].predicted == int(got[i].score >= 0.5), i
    assert sum((got[i].score >= 0.5) == (i % 3 == 0) for i in range(120)) >= 114


def test_toxicity_held_out(spark):
    import os

    base = "/root/testdata/sf0.1" if os.path.isdir("/root/testdata/sf0.1") else None
    if not base:
        pytest.skip("no tables")
    labels = spark.read.parquet(f"{base}/labels.parquet")
    got = toxicity.query(spark, base).where("held_out").join(labels, "doc_id").select("toxic", "predicted").collect()
    result = toxicity.accuracy([(r.toxic, r.predicted) for r in got])
    assert result["recall"] > 0.9 and result["precision"] > 0.95, result


# ---- secrets ----


def plain_base(text):
    out = []
    for kind, pattern, ok in ((0, secrets.ASSIGN, lambda m: len(m[2]) >= 6), (1, secrets.ACCESS, lambda m: len(m[0]) >= 20), (2, secrets.HEX, lambda m: len(m[0]) >= 24)):
        out += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if ok(m)]
    return sorted(out)


def test_base_spans_are_those_of_the_plain_patterns():
    rng = random.Random(7)
    bits = ["token", "API_KEY", "Secret", "passwd", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGHIJKLMNOP1234", "0123456789abcdef", "deadbeef", "é", "ſecret=abcdefgh", "x", "\n", "ABCDEF"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert secrets.base_spans(text) == plain_base(text), text


def test_secrets_learn_from_every_candidate(spark, monkeypatch):
    # 3,000 candidates without a secret, and as many with one, of different classes of characters; some of each are held.
    code = lambda i: "q1" + f"{i:012b}".replace("0", "z")
    docs = [(i, f"see {code(i)} or password: {code(i)}") for i in range(3000)]
    seen = []
    monkeypatch.setattr(secrets, "network", lambda *sides: seen.append(sides))
    secrets.fitted(spark.createDataFrame(docs, "doc_id long, text string"))
    held = [zlib.crc32(str(i).encode()) % 5 == 0 for i, _ in docs]
    for side, found in zip((False, True), seen[0]):
        own = {x for (_, text), h in zip(docs, held) if h == side for x in secrets.labelled([text])}
        assert len(own) == 2 * sum(h == side for h in held) and set(found) == own and len(found) == len(own)


def test_secrets_of_a_table(spark, tmp_path):
    """The query's columns against the plain patterns, and its learned spans against the network on each candidate alone."""
    rng = random.Random(12)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    key = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    shapes = [lambda: f'token = "{hexes(40)}"', lambda: f"export X={key(32)}", lambda: "AKIA" + key(16).upper(), lambda: f"pwd=\"{key(12)}\"", lambda: "see page-of-the-book-2", lambda: f"mail ann{rng.randint(1, 99)}@mail7.example.com",
              lambda: hexes(23), lambda: f"Secret: {key(5)}", lambda: "x" * 70 + "1", lambda: key(150)]
    texts = [" ".join(f"{PROSE[: rng.randint(0, 30)]} {rng.choice(shapes)()}" for _ in range(rng.randint(0, 4))) for _ in range(150)] + [None, "", "é token=abcdef123456 é"]
    spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], SCHEMA).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in secrets.query(spark, str(tmp_path)).collect()}
    net = secrets.fitted(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    for i, text in enumerate(t or "" for t in texts):
        base = plain_base(text)
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(k == kind for _, k, _ in base) for kind in range(3))
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in base).encode()).hexdigest()
        alone = [(s, 3, e) for s, e in secrets.candidates(text) if not any(a < e and s < b for a, _, b in base) and secrets.judge(net, np.array(secrets.windows(text, s, e))).max() >= net["threshold"]]
        assert got[i].spans == ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(base + alone)), text
    assert net["recall"] >= secrets.RECALL and net["false_rate"] <= 0.02 and net["n_held"] > 0


def test_network_finds_and_leaves():
    net = secrets.network()
    assert net["recall"] >= secrets.RECALL and net["false_rate"] <= 0.02
    text = 'auth= "ghp_a8Fk39dkGH3k2k3kdkfk3kdkfLsd9" and uuid 550e8400-e29b-41d4-a716-446655440000'
    (found, _), (clean, _) = secrets.scan([text, "an ordinary line, see page-of-the-book-2 and mail the.19@mail5.example.com"], net)
    assert [(s, k) for s, k, _ in found] == [(text.index("ghp_"), 3)] and clean == []


def test_a_long_candidate_is_seen_whole():
    text = "q" * 15 + "1" + "q" * 500 + "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY9x8Z7"
    assert len(secrets.windows(text, 0, len(text))) == len(range(0, len(text) - secrets.INSIDE, secrets.INSIDE // 2)) + 1


# ---- decontamination ----


def test_search_against_all_pairs(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(3))
    tests = [" ".join(word() for _ in range(rng.randint(3, 60))) for _ in range(25)]
    docs = []
    for i in range(150):
        ws = [word() for _ in range(rng.randint(0, 400))]
        part = rng.choice(tests).split()
        cut = rng.randint(0, max(1, len(part) // 3))
        ws[len(ws) // 2 : len(ws) // 2] = part[cut:] if i % 3 else part[: len(part) // 2] + ["zz"] + part[len(part) // 2 :]
        docs.append((i, " ".join(ws), "en", "a", 0))
    got = {(r.doc_id, r.item_id, r.n_item, r.n_shared) for r in decontamination.search(spark.createDataFrame(docs, SCHEMA), items(spark, tests)).collect()}
    grams = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    want = set()
    for i, t, *_ in docs:
        for j, b in enumerate(tests):
            g = grams(b)
            n = len(g & grams(t))
            if g and 100 * n >= 80 * len(g):
                want.add((i, j, len(g), n))
    assert got == want and want


# ---- token counts ----


def test_tokens_and_cache(spark, odd, tmp_path):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=token_counts.tokenizer_path("piece_bpe_32k.model"))
    cache = f"file://{tmp_path}/cache"
    got = token_counts.count_tokens(odd, cache).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()), len(model.encode(r.text or ""))) for r in odd.collect())
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert spark.read.parquet(cache).count() == odd.select(F.coalesce("text", F.lit(""))).distinct().count()
    again = token_counts.count_tokens(odd.limit(100), cache)
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in again.collect()) == want
    assert spark.read.parquet(cache).count() == odd.select(F.coalesce("text", F.lit(""))).distinct().count()
    other = token_counts.count_tokens(odd, cache, token_counts.tokenizer_path("byte_bpe_50k.json"))
    assert other.where("doc_id = 3").first().n_tokens == 0


def test_token_counts_over_splits(spark, tmp_path):
    """Equal texts in several files: each is encoded by one split, and the query finds all of them in its cache after that."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=token_counts.tokenizer_path("piece_bpe_32k.model"))
    rng = random.Random(5)
    texts = [f"{PROSE[: rng.randint(1, 90)]} {rng.randint(0, 30)}" for _ in range(300)] + ["", None, "copy"] * 20
    rng.shuffle(texts)
    spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], SCHEMA).repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    cache = f"file://{tmp_path}/cache"
    want = sorted((i, len((t or "").encode()), len(model.encode(t or "")), False) for i, t in enumerate(texts))
    for _ in range(2):
        assert sorted(map(tuple, token_counts.query(spark, str(tmp_path), cache).collect())) == want
        assert spark.read.parquet(cache).count() == len({t or "" for t in texts})


# ---- jaccard ----


def test_sets_and_index_never_miss():
    a, b, *rest = shingle_sets(["A b c d e f", "a B c D e\tf", "", " ", None, "x", "x y"])
    assert np.array_equal(a, b) and [len(r) for r in rest] == [0, 0, 0, 1, 1]
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 4, 5, 6, 9, 12, 20, 50, 150, 400):
        for _ in range(30):
            x = rng.integers(0, 2**63, n).astype(np.uint64)
            k = int(rng.integers(0, n // 4 + 2))
            gone = int(rng.integers(0, min(k, n) + 1))
            y = np.concatenate([x[gone:], rng.integers(0, 2**63, k - gone).astype(np.uint64)])
            if len(y) and 100 * (n - gone) >= 80 * (n + k - gone):
                kept = []
                for z in (np.sort(x), np.sort(y)):  # each leaves out its dearest lists, here the largest keys
                    keys, allowed = jaccard.index_keys(z), jaccard.allowances(z)
                    by = [np.sort(keys[keys & np.uint64(3) == s]) for s in range(4)]
                    kept.append(np.concatenate([own[: max(0, len(own) - (allowed >> 16 * s & 0xFFFF))] for s, own in enumerate(by)]))
                assert np.intersect1d(*kept).size


def test_words_are_told_apart():
    """Words of 2,048 letters that differ by the signs of the Thue-Morse sequence, and words that share long beginnings."""
    signs = [bin(i).count("1") % 2 for i in range(2048)]
    a, b = "".join("ab"[s] for s in signs), "".join("ba"[s] for s in signs)
    words = [a, b, a[:300], b[:300], a[:299], "a", "aa", "a" * 8, "a" * 9, "a" * 16, "a" * 17, "b" + "a" * 16]
    assert len(np.unique(np.concatenate(shingle_sets(words)))) == len(words)
    assert np.array_equal(*shingle_sets([f" {a}\n{b} ", f"{a} {b}"]))


def plain_groups(texts, percent=80):
    sets = []
    for t in texts:
        ws = (t or "").encode().translate(jaccard.shingle_sets.__globals__["LOWER"]).split()
        sets.append({tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else ({tuple(ws)} if ws else set()))
    label = list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [(i, len(s), root(i)) for i, s in enumerate(sets)]


def test_groups_against_all_pairs_with_a_passage_everywhere(spark, monkeypatch):
    """A passage in most documents makes long lists; chains of edits make long components."""
    monkeypatch.setattr(jaccard, "LONG", 3)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(40)]
    texts = []
    for i in range(160):
        own = [word() for _ in range(rng.randint(1, 60))]
        texts.append(own + passage if i % 4 else own)
    for i in range(80):
        ws = list(rng.choice(texts))
        for _ in range(rng.randint(0, 2)):
            ws[rng.randrange(len(ws))] = word()
        texts.append(ws)
    texts = [" ".join(t) for t in texts]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], SCHEMA)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_groups(docs).collect())
    assert got == plain_groups(texts)
    stay = sorted(r.doc_id for r in jaccard.first_of_groups(docs).collect())
    assert stay == sorted({c for _, _, c in got})


def test_first_of_groups_with_repeated_rows(spark, odd):
    got = sorted((r.doc_id if r.doc_id is not None else -1) for r in jaccard.first_of_groups(odd.where("doc_id IN (1, 2, 3, 5)")).collect())
    assert got == [1, 2, 3, 5]
    # An id with two texts: each group keeps one document.
    data = [(0, PROSE, "en", "a", 0), (1, PROSE + "end", "en", "a", 0), (1, "five other words of text here", "en", "a", 0), (None, PROSE, "en", "a", 0)]
    stay = jaccard.first_of_groups(spark.createDataFrame(data, SCHEMA)).collect()
    assert sorted((r.doc_id, len(r.text)) for r in stay) == [(0, len(PROSE)), (1, 29)]
    # Two texts of one id that are close to nothing: both stay.
    data2 = [(1, " ".join(f"a{i}" for i in range(2)), "en", "a", 0), (1, " ".join(f"b{i}" for i in range(15)), "en", "a", 0)]
    assert jaccard.first_of_groups(spark.createDataFrame(data2, SCHEMA)).count() == 2
    bench = items(spark, ["five other words of text here"])
    assert sorted(len(r.text) for r in decontamination.clean(spark.createDataFrame(data, SCHEMA), bench).collect()) == [len(PROSE), len(PROSE), len(PROSE) + 3]


# ---- pii ----


def test_pseudonyms_keep_formats_and_link():
    text = "Call +1 (743) 555-3824 or mail Ann.Lee42@Mail3.example.com, card 4539 1488 0343 6467, host 10.2.30.4, born 1987-03-09, 3/25/1999, 123-45-6789."
    new, spans = pii.replace(text)
    assert {k for k, _, _ in spans} == set(pii.KINDS) and len(spans) == 7
    assert all(text[s:e] not in new for _, s, e in spans)
    assert pii.replace(new, "decrypt")[0] == text
    assert pii.replace(text)[0] == new and pii.replace(text, key="other")[0] != new
    a, b = (pii.replace(f"x {v} y")[0] for v in ("4539148803436467", "4539148803436467"))
    assert a == b and pii.luhn(a.split()[1]) == 0


def test_pseudonyms_of_a_table(spark, odd, monkeypatch):
    """Row by row what replace() gives for a key of the table's, the same value alike in all rows, and back again; no key, no
    pseudonyms."""
    rng = random.Random(9)
    cards, mails = ["4539 1488 0343 6467", "4111111111111111", "1234 5678 9012 3456"], ["ann.lee@mail3.example.com", "bo@x.org"]
    rows_ = [(i, f"{PROSE[: rng.randint(0, 40)]} {rng.choice(cards)} or {rng.choice(mails)}, born {rng.randint(1950, 2005)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}", "en", "a", i) for i in range(60)] + [(60, None, None, None, None), (61, "", "en", "b", 0)]
    docs = spark.createDataFrame(rows_, SCHEMA)
    got = {r.doc_id: r for r in pii.pseudonymise(docs, "table").collect()}
    for i, text, *rest in rows_:
        new, spans = pii.replace(text, "encrypt", "table") if text is not None else (None, [])
        assert (got[i].text, got[i].lang, got[i].source, got[i].n_chars) == (new, *rest)
        assert got[i].pii_spans == ",".join(f"{k}:{s}:{e}" for k, s, e in spans) and got[i].n_card == sum(k == "card" for k, _, _ in spans)
    back = pii.pseudonymise(pii.pseudonymise(docs, "table", report=False), "table", "decrypt", False)
    assert sorted((r.doc_id, r.text) for r in back.collect() if r.text) == sorted((i, t) for i, t, *_ in rows_ if t)
    monkeypatch.delenv(pii.KEY_VARIABLE, raising=False)
    with pytest.raises(ValueError):
        pii.pseudonymise(docs)
    monkeypatch.setenv(pii.KEY_VARIABLE, "table")
    assert pii.pseudonymise(docs).where("doc_id = 0").first().text == got[0].text


def test_what_does_not_validate_stays():
    for text in ("id 2123465659789240 is", "1987-13-40", "999.1.1.1", "000-12-3456", "version 1.2.3", "a@b", "", "no digits here"):
        new, spans = pii.replace(text)
        assert (new == text and not spans) == (pii.luhn("2123465659789240") != 0 or "2123465659789240" not in text), text


@pytest.mark.parametrize("size", [1, 2, 7, 10, 100, 1000, 73049])
def test_feistel_is_a_permutation(size):
    f = pii.Feistel(size, "k")
    n = min(size, 3000)
    assert all(f.decrypt(f.encrypt(x)) == x for x in range(n))
    assert len({f.encrypt(x) for x in range(n)}) == n and all(0 <= f.encrypt(x) < size for x in range(n))


# ---- suffix dedup ----


def plain_cut(texts, length=200):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        mask = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                mask[i : i + length] = b"\1" * length
        spans = sum(1 for i, m in enumerate(mask) if m and not (i and mask[i - 1]))
        out.append((len(t), sum(mask), spans, hashlib.sha256(bytes(c for c, m in zip(t, mask) if not m)).hexdigest()))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_against_all_positions(spark, seed, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 3000)
    rng = random.Random(seed)
    make = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    shared = [make(rng.choice([150, 199, 200, 201, 230, 340, 500])) for _ in range(6)]
    texts = [make(rng.randint(0, 700)) + rng.choice(shared) + make(rng.randint(0, 300)) + rng.choice(shared) for _ in range(60)] + ["", "ab" * 300, "x" * 199, "x" * 200, "y" * 201]
    texts += texts[:4]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r for r in suffix_dedup.cut_repeats(docs).collect()}
    for i, want in enumerate(plain_cut([t.encode() for t in texts])):
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want, i
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256


def test_repeats_in_hard_texts(spark, monkeypatch):
    """Texts that differ by the signs of the Thue-Morse sequence, periodic ones, and ones that are cut into many pieces."""
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 3000)
    signs = [bin(i).count("1") % 2 for i in range(2048)]
    a, b = "".join("ab"[s] for s in signs), "".join("ba"[s] for s in signs)
    rng = random.Random(4)
    make = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    far, shared = make(21_000), make(700)
    texts = [a, b, "ab" * 2000, "x" * 6500, "z" * 250, far, make(900) + far[5_900:6_200] + make(9000), shared + make(8000) + shared, make(6_000), "y" * 199, ""]
    texts.append(texts[8])
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r for r in suffix_dedup.cut_repeats(docs.repartition(3)).collect()}
    for i, want in enumerate(plain_cut([t.encode() for t in texts])):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == want, i
    # One copy alone: nothing of either is removed, though they are made of the same letters.
    two = spark.createDataFrame([(0, a[:150] + make(60), "en", "a", 0), (1, b[:150] + make(60), "en", "a", 0)], SCHEMA)
    assert [r.n_removed for r in suffix_dedup.cut_repeats(two).collect()] == [0, 0]


def test_equal_fingerprints_of_different_bytes_are_noticed(spark, monkeypatch):
    """With fingerprints that tell nothing apart every window has a false partner, and no result is given."""
    monkeypatch.setattr(suffix_dedup.Block, "prints", lambda self, at, length: np.full(len(at), 7, np.uint64))
    job = suffix_dedup.Job(200, 1)
    texts = [("a" * 200 + "b") * 1, ("c" * 201)]
    made = [next(suffix_dedup._packed(1 << 20, 200)(iter([pa_batch([(i, t)])]))).to_pylist()[0] for i, t in enumerate(texts)]
    blocks = [suffix_dedup.Block(m | {"block": i}, 200, job.bases) for i, m in enumerate(made)]
    empty = {"copies": [], "ranks": []}
    monkeypatch.setattr(suffix_dedup.Job, "places", lambda self, block, mail: np.array([0], np.int64))
    bodies = [suffix_dedup.spread(i, b.prints(np.array([0]), 200), 1)[0] for i, b in enumerate(blocks)]
    ties = suffix_dedup.shared_keys([x[2] for x in bodies], [x[3] for x in bodies], [0, 1])
    for i, other in ((0, 1), (1, 0)):
        runs = job.runs(blocks[i], empty | {"ties": [{"part": 0, "body": ties[i], "n": 1}]}).to_pylist()[0]
        asked = [r for r in next(suffix_dedup._questions(iter([job.runs(blocks[i], empty | {"ties": [{"part": 0, "body": ties[i], "n": 1}]})]))).to_pylist() if r["block"] == other]
        reply = job.answer(blocks[other], empty | {"asked": [a | {"asker": i} for a in asked]}).to_pylist()
        out = job.finish(blocks[i].row, {"runs": [runs], "copies": [], "replies": [{"asker": other, "body": reply[0]["body"]}]}, False)
        assert out.to_pylist()[0]["bad"] > 0


def pa_batch(rows):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], ["doc_id", "text"])


def test_cover_has_every_difference():
    assert {(a - b) % suffix_dedup.PERIOD for a in suffix_dedup.COVER for b in suffix_dedup.COVER} == set(range(suffix_dedup.PERIOD))


# ---- quality ----


def test_quality_keeps_prose_and_drops_shouting(spark):
    rng = random.Random(6)
    vocabulary = PROSE.split()
    prose = lambda: " ".join(rng.choice(vocabulary) for _ in range(120))
    data = [(i, prose(), "en", "a", 0) for i in range(40)] + [(100, prose().upper().replace(" ", "!! "), "en", "a", 0), (101, "### " * 60, "en", "a", 0), (102, "too short", "en", "a", 0)]
    got = {r.doc_id: r for r in quality.assess(spark.createDataFrame(data, SCHEMA)).collect()}
    assert all(got[i].kept for i in range(40))
    assert not any(got[i].kept for i in (100, 101, 102)) and got[101].base_failed and not got[100].base_failed
    assert quality.passing(spark.createDataFrame(data, SCHEMA)).count() == 40


# ---- language model ----


def test_model_counts_and_sums_to_one(spark, monkeypatch):
    import math

    monkeypatch.setattr(language_model, "BLOCK_BYTES", 400)
    rng = random.Random(8)
    texts = [" ".join(rng.choices(["a", "b", "C", "d", "e"], [8, 4, 2, 1, 1], k=rng.randint(0, 30))) for _ in range(80)]
    data = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    train = [t.lower().split() + [None] for i, t in enumerate(texts) if not language_model.held_out(i)]
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    # Texts of one word, scored by the same model: held-out ids, so that the counts stay.
    held = [i for i in range(1000, 3000) if language_model.held_out(i)][:7]
    probe = [*(w for w in c if w), "unknown"]
    data += [(i, w, "en", "s", 0) for i, w in zip(held, probe)] + [(held[6], "", "en", "s", 0)]
    got = {r.doc_id: r for r in language_model.score_texts(spark.createDataFrame(data, SCHEMA)).collect()}
    for i, t in enumerate(texts):
        ws = t.lower().split() + [None]
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(c[w] > 0 for w in ws), n, language_model.held_out(i))
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel_tol=1e-9, abs_tol=1e-9)
    # P(end | start) comes from the empty text; P(w | start) P(end | w) from the others: at most 1 in all, all positive.
    total = sum(10 ** got[i].score for i in held)
    assert 0 < total <= 1 + 1e-9 and got[held[len(probe) - 1]].score < 0


def plain_model(texts, sweeps, burn_in, seed):
    """P(w | u) by a sampler that keeps every customer at a table and seats them one at a time, averaged over its sweeps."""
    rng = random.Random(seed)
    seqs = [[None, *t.lower().split(), None] for t in texts]
    pairs = Counter((u, w) for s in seqs for u, w in zip(s, s[1:]))
    vocabulary = {w for _, w in pairs}
    discount = lambda c: language_model._discount(sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values()))
    d, v = discount(pairs), len(vocabulary) + 1
    desks = {p: [] for p in pairs}  # sizes of tables
    parent = {w: [] for w in vocabulary}
    t_of, d0 = Counter(), 0.5
    size = lambda tabs: sum(tabs)

    def p0(w):
        n, t = sum(map(size, parent.values())), sum(map(len, parent.values()))
        return (size(parent[w]) - d0 * len(parent[w]) + (1 + d0 * t) / v) / (1 + n)

    def sit(tabs, fresh, disc):
        x = rng.random() * (fresh + sum(tabs) - disc * len(tabs))
        for k, n in enumerate(tabs):
            x -= n - disc
            if x < 0:
                tabs[k] += 1
                return False
        tabs.append(1)
        return True

    def leave(tabs):
        k = rng.choices(range(len(tabs)), tabs)[0]
        tabs[k] -= 1
        if not tabs[k]:
            del tabs[k]
            return True
        return False

    sit_parent = lambda w: sit(parent[w], (1 + d0 * sum(map(len, parent.values()))) / v, d0)
    total = Counter()
    for sweep in range(sweeps + 1):
        for (u, w), c in pairs.items():
            for _ in range(c):
                if sweep and leave(desks[u, w]):
                    t_of[u] -= 1
                    leave(parent[w])
                if sit(desks[u, w], (1 + d * t_of[u]) * p0(w), d):
                    t_of[u] += 1
                    sit_parent(w)
        if not sweep:
            d0 = discount({w: size(t) for w, t in parent.items()})
        for w in vocabulary:
            for _ in range(size(parent[w])):
                leave(parent[w])
                sit_parent(w)
        if sweep > burn_in:
            cu = Counter()
            for (u, _), c in pairs.items():
                cu[u] += c
            for u in cu:
                for w in vocabulary:
                    tabs = desks.get((u, w), [])
                    total[u, w] += (sum(tabs) - d * len(tabs) + (1 + d * t_of[u]) * p0(w)) / (1 + cu[u])
    return {k: x / (sweeps - burn_in) for k, x in total.items()}


def test_model_agrees_with_one_customer_at_a_time(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choices("abcdefgh", [12, 8, 5, 3, 2, 1, 1, 1], k=rng.randint(3, 14))) for _ in range(40)]
    train = [i for i in range(2000) if not language_model.held_out(i)][:40]
    held = [i for i in range(2000) if language_model.held_out(i)]
    vocabulary = sorted({w for t in texts for w in t.split()})
    # Texts of one and two words: their scores hold P(w | start) and P(w | u).
    probes = vocabulary + [f"{u} {w}" for u in vocabulary[:4] for w in vocabulary]
    data = [(i, t, "en", "s", 0) for i, t in zip(train, texts)] + [(i, t, "en", "s", 0) for i, t in zip(held, probes)]
    got = {r.doc_id: r for r in language_model.score_texts(spark.createDataFrame(data, SCHEMA), 6, 30).collect()}
    want = plain_model(texts, 150, 30, 1)
    for i, probe in zip(held, probes):
        seq = [None, *probe.split(), None]
        plain = sum(np.log10(want[u, w]) for u, w in zip(seq, seq[1:]))
        assert abs(got[i].score - plain) < 0.06 * len(seq), (probe, got[i].score, plain)
        assert np.isclose(got[i].perplexity, 10 ** (-got[i].score / got[i].n_tokens))


def test_predictive_probabilities_sum_to_one():
    """P(. | u) over the known words and the unknown, from counts, tables and totals that belong together."""
    rng = np.random.default_rng(2)
    c = rng.integers(0, 6, (5, 7))
    t = np.array([[0 if x == 0 else 1 + rng.integers(0, x) for x in row] for row in c])
    customers, own, d = t.sum(0), t.sum(1), 0.7
    t0 = np.minimum(np.maximum(1, customers // 2), customers)
    parent = language_model.Parent(7, customers.sum(), t0.sum(), 0.6)
    p = parent.p(customers.astype(float), t0.astype(float))
    rest = parent.p(np.zeros(1), np.zeros(1))[0]
    assert np.isclose(p.sum() + rest, 1)
    for u in range(5):
        pu = (c[u] - d * t[u] + (language_model.THETA + d * own[u]) * p) / (language_model.THETA + c[u].sum())
        assert np.isclose(pu.sum() + (language_model.THETA + d * own[u]) * rest / (language_model.THETA + c[u].sum()), 1)


def test_seating_has_a_table_and_no_more_than_customers():
    rng = np.random.default_rng(1)
    c = np.array([1, 2, 5, 80, 5000, 0])
    t = language_model.joined(c, np.full(6, 0.5), 0.6, rng)
    again = language_model.sat_again(c, t, lambda: np.full(6, 0.5), 0.6, 20, rng)
    back = language_model.moved(c, again, c // 3, np.full(6, 0.5), 0.6, rng)
    for n, x in ((c, t), (c, again), (c // 3, back)):
        assert np.all(x <= n) and np.all(x[n > 0] >= 1) and x[5] == 0
    assert t[4] > 1


def test_gibbs_steps_leave_the_seating_as_it_is():
    """Tables after many steps are spread as after a first seating, whose distribution is exact: 6 customers of one dish,
    nobody else, so that a first seating is the posterior."""
    rng = np.random.default_rng(5)
    n, c, d, theta = 40_000, 6, 0.5, 1.0
    first = np.ones(n, np.int64)
    for k in range(1, c):
        first += rng.random(n) < (theta + d * first) / (theta + k)
    # The restaurant is the dish alone: a new table weighs theta + d t, which the step sees through fresh().
    t = np.ones(n, np.int64)

    def step(t):
        now = [t.copy()]
        return language_model.sat_again(np.full(n, c), t, lambda: theta + d * now[0], d, 1, rng, lambda by: now.__setitem__(0, now[0] + by))

    for _ in range(60):
        t = step(t)
    a, b = (np.bincount(x, minlength=c + 1) / n for x in (first, t))
    assert np.abs(a - b).max() < 0.012


def test_pack_round_trip():
    a, b = np.array([0, 5, 2**63, 7], np.uint64), np.zeros(0, np.uint32)
    x, y = language_model.unpack(language_model.pack(a, b))
    assert np.array_equal(x, a) and len(y) == 0
