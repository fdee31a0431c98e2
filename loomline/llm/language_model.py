"""LM scoring by a hierarchical Pitman-Yor model with Chinese-restaurant seating, sampled by Gibbs.

Each word is a restaurant for the words that follow it; all of them share one parent restaurant, whose base is uniform over
the known words and one unknown. A pair (u, w) seen c times has c customers at t tables in u's restaurant, and each table
sends one customer to the parent. The seating enters the probabilities by t alone, so the state is t, with the sizes of
tables summed out: a customer of the pair sits alone with probability S(c - 1, t - 1) / S(c, t), S being the generalised
Stirling numbers of the discount. In a sweep customers of every pair get up, one after the other, and sit down again given
the present tables of their restaurant and the parent's; then the parent's customers do. After the burn-in each sweep gives
a sample, and predictive probabilities

    P(w | u) = (c - d t + (theta + d T_u) P(w)) / (theta + c_u)
    P(w)     = (n_w - d0 t_w + (theta0 + d0 T) / (V + 1)) / (theta0 + n)

are averaged over the samples. Each sums to 1 over the known words and the unknown. Discounts follow from how many pairs
were seen once and twice.

Pairs are dealt to desks by u, those of a frequent u by the whole pair, so that no restaurant is one task's. Desks work at a
time; between sweeps they send the tables of their pairs by word, and get back what the others' came to. A pair seen once
has one table whatever happens: it is counted once and not sent again. Counts are of all training tokens: nothing is pruned.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.exchange import Mail, all_rows, answered, arrow_rows, blocks, by_parts, lean, pack, part_of, parts_for, posted, steps, unpack
from loomline.llm.hashing import LOWER, U, chunks, mix, word_hashes
from loomline.llm.shared import Scratch, tables

THETA, THETA0 = 1.0, 1.0
#: Sweeps before the first sample, samples, and customers of a pair that get up in a sweep.
BURN_IN, SAMPLES, MOVES = 3, 3, 8
#: Up to so many customers S(c, t) is tabled; beyond it a customer sits alone with probability d (t - 1) / (c - 1), which S
#: tends to, and customers that come or go do so in groups of a sixteenth of those seated.
TABLED = 1024
BLOCK_BYTES = 3 << 20
#: The end of a text, a token that no word hashes to but by chance.
END = 0x5851F42D4C957F2D
FOLDS, HELD = 5, 1
ROW = "part int, block long, n int, body binary"


def held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD


def rows(found: list[tuple]) -> pa.RecordBatch:
    part, block, n, body = zip(*found) if found else ([], [], [], [])
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(block, pa.int64()), pa.array(n, pa.int32()), pa.array(body, pa.binary())], ["part", "block", "n", "body"])


def in_batches(found, size: int = 4 << 20):
    """Rows, the body last, as batches of about so many bytes."""
    held, bytes_ = [], 0
    for row in found:
        held.append(row)
        bytes_ += len(row[-1])
        if bytes_ > size:
            yield rows(held)
            held, bytes_ = [], 0
    if held:
        yield rows(held)


def by_part(batches) -> dict[int, list[dict]]:
    """A task's rows by part; a part is worked on alone."""
    got, out = all_rows(batches), {}
    for i, p in enumerate(got.get("part", [])):
        out.setdefault(p, []).append({k: v[i] for k, v in got.items()})
    return out


def whole(x: np.ndarray) -> np.ndarray:
    """Steps of sorted numbers added up again."""
    return np.cumsum(x, dtype=np.uint64).astype(np.int64)


def ints(x: np.ndarray) -> np.ndarray:
    """Counts in as few bytes as they take."""
    return x.astype(np.uint32 if not len(x) or x.max() < 1 << 32 else np.uint64)


# ---- blocks ----


class Block:
    """A block's tokens: the hashes of the words of each text, then END."""

    def __init__(self, row):
        self.ids = row["ids"]
        ends = np.cumsum([0, *row["lens"]])
        texts = [row["data"][s:e].translate(LOWER) for s, e in zip(ends[:-1], ends[1:])]
        tokens, counts = [], []
        for first, last in chunks(texts):
            words, offsets = word_hashes(texts[first:last])
            n = np.diff(offsets)
            tokens.append(np.insert(words, offsets[1:], U(END)))
            counts.append(n + 1)
        self.tokens = np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)
        n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(n)])
        self.held = np.array([held_out(i) for i in self.ids], bool)
        self.train = np.repeat(~self.held, n)
        self.words, self.at = np.unique(self.tokens, return_inverse=True)
        self.at = self.at.reshape(-1)

    def known(self, answers: list[dict], bits: int) -> None:
        """Reads the answers: count and id of each distinct word (id -1 where it isn't in the training texts). An id is the
        word's part and, in so many bits, its rank there."""
        got = [(a["part"], *unpack(a["body"])) for a in sorted(answers, key=lambda a: a["part"])]
        self.count = np.concatenate([c for _, c, _ in got]).astype(np.int64) if got else np.zeros(0, np.int64)
        self.id = np.concatenate([whole(i) + (p << bits) for p, _, i in got]) if got else np.zeros(0, np.int64)
        self.id[self.count == 0] = -1

    def pairs(self, desks: int, often: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs of known words (u << 32 | w), ordered by desk, with their desks, how often they are in training
        texts, and each token's place among them (-1: u or w isn't known)."""
        w = self.id[self.at]
        u, cu = np.empty_like(w), np.empty_like(w)
        end = np.searchsorted(self.words, U(END)) if len(self.words) else 0
        before = np.empty(len(w), np.int64)
        before[1:] = self.at[:-1]
        before[self.offsets[:-1]] = end
        u, cu = self.id[before], self.count[before]
        self.before = before
        both = (u >= 0) & (w >= 0)
        keys, first, back = np.unique((u[both].astype(np.uint64) << U(32)) | w[both].astype(np.uint64), return_index=True, return_inverse=True)
        count = np.bincount(back.reshape(-1), self.train[both], len(keys)).astype(np.int64)
        # The restaurant of a frequent word is spread over all desks.
        desk = part_of(mix(np.where(cu[both][first] > often, keys, keys >> U(32)), 31), desks)
        order = np.argsort(desk, kind="stable")
        rank = np.empty(len(keys), np.int64)
        rank[order] = np.arange(len(keys))
        place = np.full(len(w), -1, np.int64)
        place[both] = rank[back.reshape(-1)]
        self.context_known = u >= 0
        return keys[order], desk[order], count[order], place


def runs_of(sorted_parts: np.ndarray):
    """(part, first, last) of each run of equal numbers."""
    first = np.flatnonzero(np.diff(sorted_parts, prepend=-1))
    yield from zip(sorted_parts[first].tolist(), first.tolist(), [*first[1:].tolist(), len(sorted_parts)])


def _send_words(parts: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row)
                count = np.bincount(b.at, b.train, len(b.words)).astype(np.uint32)
                yield rows([(p, row["block"], e - s, pack(steps(b.words[s:e]), count[s:e])) for p, s, e in by_parts(b.words, parts)])

    return run


def _answer_words(batches):
    """Counts and ranks within the part for each block; the part's known words and tokens as a row of block -1."""
    for p, got in by_part(batches).items():
        sent = [unpack(g["body"]) for g in got]
        keys = np.concatenate([np.cumsum(k, dtype=np.uint64) for k, _ in sent])
        words, back = np.unique(keys, return_inverse=True)
        total = np.bincount(back.reshape(-1), np.concatenate([c for _, c in sent]), len(words)).astype(np.int64)
        ids = np.maximum(np.cumsum(total > 0) - 1, 0)
        ends = np.cumsum([0, *(g["n"] for g in got)])
        places = [back.reshape(-1)[s:e] for s, e in zip(ends[:-1], ends[1:])]
        yield from in_batches((p, g["block"], g["n"], pack(ints(total[own]), steps(ids[own].astype(np.uint32)))) for g, own in zip(got, places))
        yield rows([(p, -1, int((total > 0).sum()), int(total.sum()).to_bytes(8, "little"))])


class Sizes:
    """What the tasks of a run share."""

    def __init__(self, words: int, tokens: int, bits: int, word_parts: int, desks: int):
        self.words, self.tokens, self.bits, self.word_parts, self.desks = words, tokens, bits, word_parts, desks
        self.often = tokens / (4 * desks)


def _send_pairs(sizes: Sizes, mail: str):
    def run(batches):
        box = Mail(mail)
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row)
                b.known(box.of(row["block"]), sizes.bits)
                keys, desk, count, _ = b.pairs(sizes.desks, sizes.often)
                yield rows([(p, row["block"], e - s, pack(steps(keys[s:e]), ints(count[s:e]))) for p, s, e in runs_of(desk)])

    return run


DESK = "part int, state binary, fixed binary, counts binary, asked array<struct<block: bigint, n: int, body: binary>>, once long, twice long"
ASKED = pa.list_(pa.struct([("block", pa.int64()), ("n", pa.int32()), ("body", pa.binary())]))


def _desks(batches):
    """One row for each desk. state: its training pairs seen twice or more, with counts and one table each. fixed: how often
    each word is u, and w, of a pair seen once. counts, of all pairs that were sent, and where those of each block are."""
    for p, got in by_part(batches).items():
        sent = [unpack(g["body"]) for g in got]
        keys = np.concatenate([np.cumsum(k, dtype=np.uint64) for k, _ in sent])
        pairs, back = np.unique(keys, return_inverse=True)
        total = np.bincount(back.reshape(-1), np.concatenate([c for _, c in sent]), len(pairs)).astype(np.int64)
        many, one = total > 1, pairs[total == 1]
        us, tu = np.unique(one >> U(32), return_counts=True)
        ws, tw = np.unique(one & U(0xFFFFFFFF), return_counts=True)
        state = pack(steps(pairs[many]), ints(total[many]), np.ones(int(many.sum()), np.uint32))
        fixed = pack(steps(us), ints(tu), steps(ws), ints(tw))
        asked, at = [], 0
        for g in got:
            asked.append({"block": g["block"], "n": g["n"], "body": pack(steps(back.reshape(-1)[at : at + g["n"]].astype(np.uint32)))})
            at += g["n"]
        yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([state], pa.binary()), pa.array([fixed], pa.binary()), pa.array([pack(ints(total))], pa.binary()), pa.array([asked], ASKED),
                                          pa.array([len(one)], pa.int64()), pa.array([int((total == 2).sum())], pa.int64())], ["part", "state", "fixed", "counts", "asked", "once", "twice"])


# ---- seating ----


@lru_cache(maxsize=4)
def alone_table(d: float, most: int = TABLED) -> np.ndarray:
    """For c customers at t tables (row c, column t) the probability that a given one sits alone."""
    s = np.full((most + 1, most + 1), -np.inf)
    s[1, 1] = 0.0
    t = np.arange(most + 1)
    with np.errstate(invalid="ignore", divide="ignore"):
        for c in range(2, most + 1):
            stay = np.log(np.maximum(c - 1 - d * t[1:c], 0)) + s[c - 1, 1:c]
            s[c, 1:c] = np.logaddexp(stay, s[c - 1, : c - 1])
            s[c, c] = s[c - 1, c - 1]
        out = np.zeros((most + 1, most + 1), np.float32)
        out[1:, 1:] = np.nan_to_num(np.exp(s[:-1, :-1] - s[1:, 1:]), nan=0.0)
    out[1, 1] = 1.0
    return out


def alone(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    few = c <= TABLED
    p = np.where(few, 0.0, d * (t - 1) / np.maximum(c - 1, 1))
    p[few] = alone_table(d)[c[few], t[few]]
    return p


def joined(c: np.ndarray, fresh: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Tables after c customers of a dish sat down one after the other; fresh: the weight of a new table."""
    return moved(np.minimum(c, 1), np.minimum(c, 1), c, fresh, d, rng)


def moved(n: np.ndarray, t: np.ndarray, to: np.ndarray, fresh: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Tables when a dish's customers go from n at t tables to so many: one after the other, in groups beyond TABLED."""
    n, t = n.astype(np.int64).copy(), t.astype(np.int64).copy()
    todo = np.flatnonzero(n != to)
    while len(todo):
        a, b, k = n[todo], to[todo], t[todo]
        step = np.minimum(np.abs(b - a), np.where(a > TABLED, a // 16, 1))
        up = b > a
        chance = np.where(up, fresh[todo] / (fresh[todo] + np.maximum(a - d * k, 0)), 0.0)
        chance[~up] = alone(a[~up], k[~up], d)
        change = rng.binomial(step, np.clip(np.where(a == 0, 1.0, chance), 0.0, 1.0))
        n[todo] = np.where(up, a + step, a - step)
        # A dish with customers has a table, and not more tables than customers.
        t[todo] = np.clip(np.where(up, k + change, k - change), np.minimum(n[todo], 1), n[todo])
        todo = todo[n[todo] != to[todo]]
    return t


def sat_again(c: np.ndarray, t: np.ndarray, fresh, d: float, moves: int, rng: np.random.Generator, changed=None) -> np.ndarray:
    """moves times a customer of each dish gets up and sits down again. fresh(): the weights of a new table just then;
    changed(by): what to do when a dish's tables have changed by so many."""
    t = t.astype(np.int64).copy()
    for _ in range(moves if len(c) else 0):
        gone = rng.random(len(c)) < alone(c, t, d)
        t -= gone
        if changed is not None:
            changed(-gone.astype(np.int64))
        new = fresh()
        come = rng.random(len(c)) * (new + np.maximum(c - 1 - d * t, 0)) < new
        come = (come | (t == 0)) & (c > 0)
        t += come
        if changed is not None:
            changed(come.astype(np.int64))
    return t


def by_word(keys: np.ndarray) -> tuple:
    """The distinct words of pairs as u and as w, and each pair's place among them."""
    us, ub = np.unique(keys >> U(32), return_inverse=True)
    ws, wb = np.unique(keys & U(0xFFFFFFFF), return_inverse=True)
    return us, ub.reshape(-1), ws, wb.reshape(-1)


def letters(part: int, us, tu, ws, tw, sizes: Sizes) -> list[tuple]:
    """Rows to the word parts with sums by u and by w."""
    pu, pw = (us >> U(sizes.bits)).astype(np.int64), (ws >> U(sizes.bits)).astype(np.int64)
    at_u, at_w = ({p: (s, e) for p, s, e in runs_of(x)} for x in (pu, pw))
    out = []
    for p in sorted(at_u.keys() | at_w.keys()):
        (a, b), (c, e) = at_u.get(p, (0, 0)), at_w.get(p, (0, 0))
        out.append((p, part, b - a, pack(steps(us[a:b].astype(np.uint64)), ints(tu[a:b]), steps(ws[c:e].astype(np.uint64)), ints(tw[c:e]))))
    return out


def _send_fixed(sizes: Sizes):
    def run(batches):
        for batch in batches:
            for row in batch.select(["part", "fixed"]).to_pylist():
                us, tu, ws, tw = unpack(row["fixed"])
                yield rows(letters(row["part"], np.cumsum(us, dtype=np.uint64), tu.astype(np.int64), np.cumsum(ws, dtype=np.uint64), tw.astype(np.int64), sizes))

    return run


def _send_sums(sizes: Sizes):
    """The tables of a desk's pairs by u and by w."""

    def run(batches):
        for batch in batches:
            for row in batch.select(["part", "state"]).to_pylist():
                keys, _, t = unpack(row["state"])[:3]
                us, ub, ws, wb = by_word(np.cumsum(keys, dtype=np.uint64))
                yield rows(letters(row["part"], us, np.bincount(ub, t, len(us)).astype(np.int64), ws, np.bincount(wb, t, len(ws)).astype(np.int64), sizes))

    return run


WORDS = "part int, block long, n int, body binary, customers long, tables long, once long, twice long"
WORD_KINDS = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
WORD_NAMES = ["part", "block", "n", "body", "customers", "tables", "once", "twice"]


def word_rows(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*found), WORD_KINDS)], WORD_NAMES)


def summed(sent: list[dict], n: int, start: int) -> tuple[np.ndarray, np.ndarray]:
    own, customers = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for g in sent:
        us, tu, ws, tw = unpack(g["body"])
        own[whole(us) - start] += tu.astype(np.int64)
        customers[whole(ws) - start] += tw.astype(np.int64)
    return own, customers


def _fixed_words(sizes: Sizes):
    """A word part's first state: tables of pairs seen once, by u and by w, and nothing else yet."""

    def run(batches):
        for p, got in by_part(batches).items():
            n = next(g["n"] for g in got if g["block"] < 0)
            own, customers = summed([g for g in got if g["block"] >= 0], n, p << sizes.bits)
            zero = np.zeros(n, np.uint32)
            yield word_rows([(p, -1, n, pack(ints(own), ints(customers), zero, zero, zero), 0, 0, 0, 0)])

    return run


def _sit_parent(sizes: Sizes, d0: float, total: float, turn: int, keep: bool):
    """A word part between two sweeps: tables in each word's restaurant and customers in the parent are added up anew; the
    parent's customers come or go as they changed, and get up and sit down again. Replies for each desk: the tables of the
    restaurants it asked for, the customers and tables of the words. keep: the state is a sample."""

    def run(batches):
        for p, got in by_part(batches).items():
            state = next(g for g in got if g["block"] < 0)
            own0, customers0, _, was, t, *samples = unpack(state["body"])
            sent = [g for g in got if g["block"] >= 0]
            own, customers = summed(sent, state["n"], p << sizes.bits)
            own, customers = own + own0.astype(np.int64), customers + customers0.astype(np.int64)
            rng = np.random.default_rng([p, turn, 1])
            fresh = np.full(state["n"], (THETA0 + d0 * total) / (sizes.words + 1))
            t = moved(was.astype(np.int64), t.astype(np.int64), customers, fresh, d0, rng)
            t = sat_again(customers, t, lambda: fresh, d0, min(MOVES, 4), rng)
            mine = [ints(own), ints(customers), ints(t)]
            yield word_rows([(p, -1, state["n"], pack(own0, customers0, *mine, *samples, *(mine if keep else [])), int(customers.sum()), int(t.sum()), int((customers == 1).sum()), int((customers == 2).sum()))])
            for i in range(0, len(sent), 16):
                replies = []
                for g in sent[i : i + 16]:
                    us, _, ws, _ = unpack(g["body"])
                    u, w = whole(us) - (p << sizes.bits), whole(ws) - (p << sizes.bits)
                    replies.append((p, g["block"], g["n"], pack(ints(own[u]), ints(customers[w]), ints(t[w])), 0, 0, 0, 0))
                yield word_rows(replies)

    return run


class Parent:
    """The totals that every part needs: P(w) from a word's customers and tables."""

    def __init__(self, words: int, customers: float, tables_: float, d0: float):
        self.words, self.n, self.t, self.d0 = words, customers, tables_, d0

    def p(self, customers: np.ndarray, tables_: np.ndarray) -> np.ndarray:
        return (customers - self.d0 * tables_ + (THETA0 + self.d0 * self.t) / (self.words + 1)) / (THETA0 + self.n)


def _sweep(parent: Parent, d: float, turn: int, mail: str, first: bool, keep: bool):
    """A desk's sweep (the first one: all customers sit down). keep: its tables are a sample."""

    def run(batches):
        box = Mail(mail)
        for batch in batches:
            for row in batch.select(["part", "state"]).to_pylist():
                keys, c, t, *samples = unpack(row["state"])
                us, ub, ws, wb = by_word(np.cumsum(keys, dtype=np.uint64))
                got = [unpack(a["body"]) for a in sorted(box.of(row["part"] << 32), key=lambda a: a["from"])]
                own, customers, parents = (np.concatenate([g[k] for g in got]).astype(np.float64) if got else np.zeros(0) for k in range(3))
                chance = parent.p(customers, parents)[wb] if len(wb) else np.zeros(0)
                count = c.astype(np.int64)
                rng = np.random.default_rng([row["part"], turn, 0])

                def changed(by):
                    np.add(own, np.bincount(ub, by, len(us)), out=own)

                fresh = lambda: (THETA + d * own[ub]) * chance
                if first:
                    t = joined(count, fresh(), d, rng)
                else:
                    t = sat_again(count, t.astype(np.int64), fresh, d, MOVES, rng, changed)
                state = pack(keys, c, ints(t), *samples, *([ints(t)] if keep else []))
                yield pa.RecordBatch.from_arrays([pa.array([row["part"]], pa.int32()), pa.array([state], pa.binary())], ["part", "state"])

    return run


# ---- answers and scores ----


def _answer_pairs(mail: str):
    """For each block its pairs' counts and, of those seen twice or more, the tables in each sample."""

    def run(batches):
        box = Mail(mail)
        for batch in batches:
            for row in batch.to_pylist():
                c = unpack(row["counts"])[0]
                found = box.of(row["part"] << 32)
                samples = unpack(found[0]["state"])[3:] if found else []
                rank = np.cumsum(c > 1) - 1

                def answer(ask):
                    own = whole(unpack(ask["body"])[0])
                    count = c[own]
                    many = rank[own[count > 1]]
                    return row["part"], ask["block"], ask["n"], pack(ints(count), *(s[many] for s in samples))

                yield from in_batches(map(answer, row["asked"]))

    return run


def _answer_words_last(mail: str):
    """For each block, by its words: tables in the word's restaurant, customers and tables in the parent, in each sample."""

    def run(batches):
        box, part, samples = Mail(mail), None, []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["part"] != part:  # a part's rows follow each other
                    part, found = row["part"], box.of(row["part"] << 32)
                    samples = unpack(found[0]["body"])[5:] if found else []
                ids = whole(unpack(row["body"])[1])
                out.append((row["part"], row["block"], row["n"], pack(*(s[ids] if len(s) else np.zeros(len(ids), np.uint32) for s in samples))))
            yield from in_batches(out)

    return run


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"


def _score(sizes: Sizes, parents: list[Parent], d: float, words: str, of_words: str, pairs: str):
    def run(batches):
        boxes = [Mail(path) for path in (words, of_words, pairs)]
        for batch in batches:
            for row in batch.to_pylist():
                known, stats, seated = (sorted(box.of(row["block"]), key=lambda a: a["part"]) for box in boxes)
                b = Block(row)
                b.known(known, sizes.bits)
                keys, desk, _, place = b.pairs(sizes.desks, sizes.often)
                count = b.count[b.at]
                p = np.zeros(len(count))
                got = [unpack(a["body"]) for a in stats]
                given = [unpack(a["body"]) for a in seated]
                c = np.concatenate([g[0] for g in given]).astype(np.float64) if given else np.zeros(0)
                cu = b.count[b.before].astype(np.float64)
                pair = place >= 0
                for s, parent in enumerate(parents):
                    own, customers, tabs = (np.concatenate([g[3 * s + k] for g in got]).astype(np.float64) if got else np.zeros(0) for k in range(3))
                    unknown = parent.p(np.zeros(1), np.zeros(1))[0]
                    base = np.where(b.count > 0, parent.p(customers, tabs), unknown)[b.at]
                    t = np.minimum(c, 1)
                    if given:
                        t[c > 1] = np.concatenate([g[1 + s] for g in given])
                    add = np.zeros(len(base))
                    add[pair] = (c - d * t)[place[pair]]
                    p += np.where(b.context_known, (add + (THETA + d * own[b.before]) * base) / (THETA + cu), base)
                log = np.log10(p / len(parents))
                plain = np.log10((count + 0.5) / (sizes.tokens + 0.5 * (sizes.words + 1)))
                run_ = lambda x: np.add.reduceat(x, b.offsets[:-1]) if len(x) else np.zeros(0)
                n, score = np.diff(b.offsets), run_(log).astype(float)
                yield pa.RecordBatch.from_arrays([pa.array(b.ids, pa.int64()), pa.array(b.held), pa.array(n), pa.array(run_((count > 0).astype(np.int64)).astype(np.int64)), pa.array(np.full(len(b.ids), sizes.tokens), pa.int64()),
                                                  pa.array(run_(plain).astype(float)), pa.array(score), pa.array(10.0 ** (-score / np.maximum(n, 1)))],
                                                 ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    return run


def _discount(once: int | None, twice: int | None) -> float:
    return min(0.95, max(0.05, (once or 0) / max(1, (once or 0) + 2 * (twice or 0))))


def score_texts(docs: DataFrame, burn_in: int = BURN_IN, samples: int = SAMPLES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity for every row of docs (doc_id, text).

    Tokens are the words, A-Z lower-cased, and one end for each text. Counts come from the rows whose crc32 of the
    doc_id as text is not 1 modulo 5 (a null id is among them). score is the log10 probability of the text under the
    averaged predictive probabilities, base_score under smoothed word counts, perplexity 10 to the minus score by tokens.
    Words are told apart by 64-bit hashes.

    A null or empty text is its end only. Texts are read whole. Repeated rows count and score each for itself. Without
    training rows every token is the one unknown and both scores are 0. An empty table gives an empty result.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "model")
    with arrow_rows(spark, 16, 8 << 20):
        table = blocks(docs, scratch, BLOCK_BYTES)
        size = table.agg(F.sum(F.octet_length("data"))).first()[0] or 0

        word_parts, desks = parts_for(spark, size // 4), parts_for(spark, size * 2)
        words = scratch.keep(answered(table.mapInArrow(lean(_send_words(word_parts)), ROW), word_parts, _answer_words, ROW), "words")
        own = words.where("block < 0")
        n_words, most = own.agg(F.sum("n"), F.max("n")).first()
        tokens = own.mapInArrow(lean(_token_sums), "n long").agg(F.sum("n")).first()[0] or 0
        bits = max(1, int(most or 1).bit_length())
        if word_parts << bits > 1 << 32:
            raise ValueError("more than 2 ** 32 distinct words")
        sizes = Sizes(n_words or 0, tokens, bits, word_parts, desks)
        mail = posted(words.where("block >= 0"), scratch, "of_blocks")

        desk = scratch.keep(answered(table.mapInArrow(lean(_send_pairs(sizes, mail)), ROW), desks, _desks, DESK), "desk")
        d = _discount(*desk.agg(F.sum("once"), F.sum("twice")).first())

        # The words' first state: what pairs seen once come to.
        fixed = desk.select("part", "fixed").mapInArrow(lean(_send_fixed(sizes)), ROW)
        begin = own.select("part", "block", "n", F.lit(b"").alias("body"))
        state = scratch.keep(answered(fixed.unionByName(begin), word_parts, _fixed_words(sizes), WORDS), "words0")
        seats = desk.select("part", "state")
        parents: list[Parent] = []
        total, d0 = float(n_words or 0), 0.5
        for turn in range(burn_in + samples + 1):
            keep = turn > burn_in
            sent = seats.mapInArrow(lean(_send_sums(sizes)), ROW)
            both = sent.unionByName(state.where("block < 0").select("part", "block", "n", "body"))
            state = scratch.keep(answered(both, word_parts, _sit_parent(sizes, d0, total, turn, keep), WORDS), f"words{turn + 1}")
            customers, tables_, once, twice = state.agg(*(F.sum(c) for c in ("customers", "tables", "once", "twice"))).first()
            parent = Parent(n_words or 0, float(customers or 0), float(tables_ or 0), d0)
            if keep:
                parents.append(parent)
            scratch.drop(f"words{turn}", *([f"replies{turn - 1}"] if turn else []))
            if turn == burn_in + samples:
                break
            if not turn:
                d0 = _discount(once, twice)
            total = parent.t
            replies = posted(state.where("block >= 0").select((F.shiftleft("block", 32)).alias("block"), F.col("part").alias("from"), "body"), scratch, f"replies{turn}")
            # A desk's sample is what its sums of the next turn are.
            seats = scratch.keep(seats.mapInArrow(lean(_sweep(parent, d, turn, replies, not turn, turn >= burn_in)), "part int, state binary"), f"seats{turn}")
            if turn:
                scratch.drop(f"seats{turn - 1}")
        tables_of = posted(seats.select(F.shiftleft(F.col("part").cast("long"), 32).alias("block"), "state"), scratch, "tables")
        pairs = posted(desk.select("part", "counts", "asked").mapInArrow(lean(_answer_pairs(tables_of)), ROW), scratch, "pairs")
        stats = posted(state.where("block < 0").select(F.shiftleft(F.col("part").cast("long"), 32).alias("block"), "body"), scratch, "stats")
        of_words = posted(words.where("block >= 0").mapInArrow(lean(_answer_words_last(stats)), ROW), scratch, "of_words")
        scratch.drop("desk", "tables", "stats", "words")
        done = scratch.keep(table.mapInArrow(lean(_score(sizes, parents, d, mail, of_words, pairs)), SCORED), "result")
    scratch.drop_but("result")
    return done


def _token_sums(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([int.from_bytes(b, "little") for b in batch.column("body").to_pylist()], pa.int64())], ["n"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(tables(sf_dir, "documents")))
