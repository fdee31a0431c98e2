"""corpus_pipeline.run against a plain version of its five stages. Texts have under fifty words, where the quality rules
are the base rules alone; the distances of longer texts are held against op9's oracle."""

import hashlib
import math
import random
from collections import Counter
from fractions import Fraction

import corpus_pipeline
from loomline.llm import mixing, pii, quality
from tests.llm.test_small import SCHEMA, plain_groups


def plain_quality(docs):
    def stays(text):
        ws = text.split()
        runs = [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
        n = Counter(runs)
        again = {i + k for i, r in enumerate(runs) if n[r] > 1 for k in range(5)}
        return len(ws) >= quality.MIN_WORDS and 100 * len(again) <= quality.MAX_REPEAT_PERCENT * len(ws)

    return [d for d in docs if stays(d[1])]


def plain_near_duplicates(docs):
    docs = sorted(docs)
    return [d for d, (i, _, root) in zip(docs, plain_groups([d[1] for d in docs])) if i == root]


def plain_decontamination(docs, bench):
    grams = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    held = lambda t: any(g and 100 * len(g & grams(t)) >= 80 * len(g) for g in map(grams, bench))
    return [d for d in docs if not held(d[1])]


def plain_pii(docs):
    return [(d[0], pii.replace(d[1])[0], *d[2:]) for d in docs]


def plain_mixing(docs):
    """(doc_id, text, taken): targets by water-filling in fractions, then whole repetitions and one in digest order."""
    by = {}
    for d in docs:
        by.setdefault(d[3], []).append(d)
    n = {s: sum(len(d[1].split()) for d in ds) for s, ds in by.items()}
    weight = {s: mixing.WEIGHTS[i % len(mixing.WEIGHTS)] for i, s in enumerate(sorted(by))}
    cap, clamped, level = {s: n[s] * mixing.MAX_EPOCHS for s in by}, None, Fraction(0)
    while clamped != (under := {s for s in by if cap[s] <= level * weight[s]}):
        clamped, level = under, Fraction(sum(n.values()) - sum(cap[s] for s in under), sum(weight[s] for s in by if s not in under))
    out = []
    for s, ds in by.items():
        target = min(cap[s], level * weight[s])
        whole = target // n[s]
        rest = math.floor(target - whole * n[s] + Fraction(1, 2))
        digest = lambda d: hashlib.md5(f"{mixing.SEED}|{d[0]}|{hashlib.md5(d[1].encode()).hexdigest()}".encode()).hexdigest()
        for d in sorted(ds, key=digest):
            size = len(d[1].split())
            part = min(size, rest)
            rest -= part
            out.append((d[0], d[1], whole * size + part))
    return out


def test_run_against_the_plain_stages(spark, tmp_path):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    prose = lambda n: [word() for _ in range(n)]
    bench = [" ".join(prose(12)) for _ in range(4)] + ["two words"]
    texts = [prose(rng.randint(10, 48)) for _ in range(60)]
    texts += [prose(4), prose(9), prose(6) * 4, prose(5) * 2 + prose(30)]
    texts += [t[:-1] + [word()] for t in texts[:12] if len(t) > 20]
    texts += [prose(12) + b.split() + prose(9) for b in bench[:3]] + [prose(9) + bench[3].split()[:8] + prose(9)]
    personal = ["+1 (826) 555-4081 190.137.223.204", "ann.lee@mail3.example.com", "born 1987-03-09", "4539 1488 0343 6467", "+1 (826) 555-4081 2019"]
    texts += [prose(8) + p.split() + prose(12) for p in personal]
    rng.shuffle(texts)
    docs = [(i, " ".join(t), "en", rng.choice("aabcc") if i > 3 else "z", 0) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    want, left = docs, [len(docs)]
    for stage in (plain_quality, plain_near_duplicates, lambda d: plain_decontamination(d, bench), plain_pii):
        want = stage(want)
        left.append(len(want))
    assert left[0] > left[1] > left[2] > left[3] == left[4]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.text, r.taken) for r in got) == sorted(plain_mixing(want))
    assert {(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in got} == set(want)
