"""Toxicity: a factorization machine over hashed terms, so that pairs of terms count beyond what each term does."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.exchange import small_batches
from loomline.llm.shared import tables

BITS = 20
FACTORS = 8
#: The model is fitted on at most so many labelled rows, those with the least digests of their ids.
TRAIN_ROWS = 12_000
#: Hashed terms that the model keeps: those whose presence tells most about the label.
TERMS = 4096
#: A term is kept only if it was seen in so many training documents.
LEAST_DOCS = 4
EPOCHS, BATCH, RATE, DECAY = 12, 128, 0.05, 1e-4
PREFIXES = (4, 6)

TERM = re.compile(r"\w+")


def slots_of(word: str) -> tuple[int, ...]:
    """Hashed features of a lower-case word: itself and its beginnings, each in a name space of its own."""
    mask = (1 << BITS) - 1
    found = [zlib.crc32(word.encode("utf-8", "surrogatepass")) & mask]
    for n in PREFIXES:
        if len(word) >= n:
            found.append(zlib.crc32(f"{n}^{word[:n]}".encode("utf-8", "surrogatepass")) & mask)
    return tuple(found)


def features(text: str) -> np.ndarray:
    """The distinct hashed terms of the whole text."""
    found: set[int] = set()
    for word in set(TERM.findall(text.lower())):
        found.update(slots_of(word))
    return np.fromiter(found, np.int32, len(found))


class Machine:
    """score = b + sum of w + sum over pairs <v_i, v_j>, over the kept terms that are present."""

    def __init__(self, slots: np.ndarray, bias: float, w: np.ndarray, v: np.ndarray):
        self.slots, self.bias, self.w, self.v = slots, bias, w, v
        self.place = {int(s): i for i, s in enumerate(slots)}

    def logit(self, at: np.ndarray) -> float:
        v = self.v[at]
        s = v.sum(0)
        return float(self.bias + self.w[at].sum() + 0.5 * (s @ s - (v * v).sum()))


def choose(rows: list[np.ndarray], y: np.ndarray, terms: int, least: int) -> np.ndarray:
    """The slots with the largest gain of log-likelihood (G statistic) over the label."""
    n1, n0 = max(int(y.sum()), 1), max(int(len(y) - y.sum()), 1)
    seen, toxic = np.zeros(1 << BITS, np.int32), np.zeros(1 << BITS, np.int32)
    for row, label in zip(rows, y):
        seen[row] += 1
        if label:
            toxic[row] += 1
    at = np.flatnonzero(seen >= least)
    a, n = toxic[at].astype(float), seen[at].astype(float)
    p, q = n1 / (n1 + n0), 1 - n1 / (n1 + n0)
    g = a * np.log(np.maximum(a, 1e-9) / (n * p)) + (n - a) * np.log(np.maximum(n - a, 1e-9) / (n * q))
    order = np.lexsort((at, -g))[:terms]
    return np.sort(at[order[g[order] > 6.0]])


def fit(texts: list[np.ndarray], labels: list[int], factors: int = FACTORS, terms: int = TERMS) -> Machine:
    """Adagrad on the logistic loss. texts are feature arrays; the result depends on their order alone."""
    y = np.array(labels, float)
    rng = np.random.default_rng(3)
    slots = choose(texts, y, terms, LEAST_DOCS) if len(y) else np.zeros(0, np.int32)
    rate = min(max(float(y.mean()) if len(y) else 0.0, 1e-3), 1 - 1e-3)
    bias, w, v = float(np.log(rate / (1 - rate))), np.zeros(len(slots)), rng.normal(0, 0.01, (len(slots), factors))
    machine = Machine(slots, bias, w, v)
    if not len(slots):
        return machine
    rows = [np.searchsorted(slots, t[np.isin(t, slots)]) for t in texts]
    gb, gw, gv = 1e-8, np.full(len(slots), 1e-8), np.full(v.shape, 1e-8)
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(len(y)), max(1, len(y) // BATCH)):
            db, dw, dv = 0.0, np.zeros_like(w), np.zeros_like(v)
            for i in part:
                at = rows[i]
                s = v[at].sum(0)
                z = machine.bias + w[at].sum() + 0.5 * (s @ s - (v[at] ** 2).sum())
                d = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[i]
                db += d
                dw[at] += d
                dv[at] += d * (s - v[at])
            db, dw, dv = db / len(part), dw / len(part) + DECAY * w, dv / len(part) + 10 * DECAY * v
            gb, gw, gv = gb + db * db, gw + dw * dw, gv + dv * dv
            machine.bias -= RATE * db / gb**0.5
            w -= 8 * RATE * dw / np.sqrt(gw)
            v -= RATE * dv / np.sqrt(gv)
    return machine


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """At most so many labelled documents outside the held-out fifth, by the digest of their ids."""
    name = F.col("doc_id").cast("string")
    one = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    own = docs.select("doc_id", "text").where(F.crc32(name) % 5 != 0)
    picked = one.where(F.crc32(name) % 5 != 0).orderBy(F.md5(name), "doc_id").limit(rows)
    # limit() bounds picked, so its broadcast is bounded too.
    return own.join(F.broadcast(picked), "doc_id").select("doc_id", "_toxic", F.coalesce("text", F.lit("")).alias("text"))


def _to_features(batches):
    for batch in batches:
        rows = [features(t).tobytes() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_toxic").cast(pa.int32()), pa.array(rows, pa.binary())], ["doc_id", "toxic", "slots"])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Machine:
    """Fits on a bounded sample of labelled rows. Repeated rows of an id count once, with the higher label."""
    small_batches(docs.sparkSession)
    found = training_rows(docs, labels, rows).mapInArrow(_to_features, "doc_id long, toxic int, slots binary").collect()
    once = {r.doc_id: r for r in sorted(found, key=lambda r: (r.doc_id, r.slots))}
    order = sorted(once.values(), key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id))
    return fit([np.frombuffer(r.slots, np.int32) for r in order], [int(bool(r.toxic)) for r in order])


def _score_batches(machine: Machine):
    def run(batches):
        known: dict[str, tuple[int, ...]] = {}
        place = machine.place
        for batch in batches:
            scores = []
            for text in batch.column("text").to_pylist():
                at: set[int] = set()
                for word in set(TERM.findall((text or "").lower())):
                    got = known.get(word)
                    if got is None:
                        if len(known) > 200_000:  # a memo only; a word that falls out is hashed anew
                            known.clear()
                        got = known[word] = tuple(place[s] for s in slots_of(word) if s in place)
                    if got:
                        at.update(got)
                z = machine.logit(np.fromiter(sorted(at), np.int64, len(at)))
                scores.append(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return run


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs (doc_id, text).

    Only the text is scored. A null or empty text has no terms and gets the machine's base rate; texts are read whole;
    repeated rows are rows of the result; a null id is not held out. An empty table gives an empty result. Without
    labels the machine gives every text the same low score.
    """
    small_batches(docs.sparkSession)
    scored = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(_score_batches(machine), "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(tables(sf_dir, "documents"))
    labels = spark.read.parquet(tables(sf_dir, "labels"))
    return score(docs, train(docs, labels))


def accuracy(pairs: list[tuple[int, int]]) -> dict[str, float]:
    """Precision and recall of (label, predicted) pairs."""
    n = Counter(pairs)
    return {"precision": n[1, 1] / max(1, n[1, 1] + n[0, 1]), "recall": n[1, 1] / max(1, n[1, 1] + n[1, 0])}
