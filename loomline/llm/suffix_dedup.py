"""Removal of repeated passages by blockwise suffix sorting with a difference cover.

A passage is a string of LENGTH bytes that starts at two places or more. Offsets that lie in a difference cover modulo
PERIOD are the sample: for any two places there is a shift under PERIOD that brings both into it. So if a passage starts
at both, two sampled suffixes after them agree in their first LENGTH - PERIOD + 1 bytes. First the sample is ranked:
suffixes that agree so far are of one rank. Only suffixes shortly before a sample with a shared rank can repeat; these are
sorted bucket by bucket, and those that tie with another are repeated.

Ranks and ties are told by fingerprints of the bytes compared (polynomials modulo two primes at bases drawn anew for each
run), in whose order the buckets are cut; which suffix comes first in the alphabet doesn't matter here. No byte goes by
fingerprints alone: of each stretch of ties windows that cover it are held against the window of another block with the
same fingerprint, by digests of their bytes. Copies of whole texts are told by SHA-256.

A task holds one block of text or one bucket of fingerprints. Texts over BLOCK_BYTES are cut into pieces that overlap.
"""

from __future__ import annotations

import hashlib
import random
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.exchange import Mail, all_rows, answered, arrow_rows, by_parts, lean, pack, parts_for, posted, steps, unpack
from loomline.llm.hashing import U, mix
from loomline.llm.shared import Scratch, tables

LENGTH = 200
# A perfect difference cover; every residue modulo 133 is a difference of two of its members.
PERIOD = 133
COVER = (1, 11, 16, 40, 41, 43, 52, 60, 74, 78, 121, 128)
# The two largest primes under 2 ** 31. Prefix sums of a block stay under 2 ** 63.
PRIMES = (2_147_483_647, 2_147_483_629)

BLOCK_BYTES = 2 << 20
#: A block's pieces of texts: the row's number and id, the whole text's size and digest, where the piece starts, how many
#: bytes are its own (the rest belongs to the next piece too), and how many it has.
BLOCKS = "block long, rows array<bigint>, ids array<bigint>, sizes array<bigint>, digests array<binary>, starts array<bigint>, own array<int>, lens array<int>, data binary"
KINDS = [pa.int64(), *(pa.list_(t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32())), pa.binary()]
NAMES = ["block", "rows", "ids", "sizes", "digests", "starts", "own", "lens", "data"]
SENT = "part int, block long, body binary, n int"
RUNS = "block long, body binary"
ASKED = "block long, asker long, body binary"
CUT = "row long, piece long, doc_id long, size long, spans string, n_removed long, n_spans long, kept_sha256 string, kept binary, bad long"
DIGEST = 16


def _packed(size: int, length: int):
    """Rows of texts into blocks of about that many bytes."""

    def run(batches):
        task = (TaskContext.get().partitionId() if TaskContext.get() else 0)
        number, row, held, pieces = task << 32, task << 40, 0, []

        def block():
            lists = [list(c) for c in zip(*(p[:-1] for p in pieces))]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip([number, *lists, b"".join(p[-1] for p in pieces)], KINDS)], NAMES)

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = (text or "").encode("utf-8", "surrogatepass")
                digest = hashlib.sha256(text).digest() if len(text) >= length else None
                for start in range(0, max(1, len(text)), size):
                    own = min(size, len(text) - start)
                    data = text[start : start + own + length - 1]
                    if held and held + len(data) > size + length:
                        yield block()
                        number, held, pieces = number + 1, 0, []
                    pieces.append((row, i, len(text), digest, start, own, len(data), data))
                    held += len(data)
                row += 1
        if pieces:
            yield block()

    return run


@lru_cache(maxsize=1)
def powers(n: int, bases: tuple[int, int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each prime the powers of its base up to n, and of the base's inverse."""
    out = []
    for p, base in zip(PRIMES, bases):
        pair = []
        for b in (base, pow(base, -1, p)):
            x = np.ones(1, np.uint64)
            while len(x) <= n:  # doubling
                x = np.concatenate([x, x * U(pow(b, len(x), p)) % U(p)])
            pair.append(x[: n + 1].astype(np.uint32))
        out.append(tuple(pair))
    return out


class Block:
    """One block's pieces as fingerprinted bytes."""

    def __init__(self, row, length: int, bases: tuple[int, int]):
        self.length, self.data = length, row["data"]
        self.row = row
        self.lens, self.own = np.asarray(row["lens"], np.int64), np.asarray(row["own"], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lens)]).astype(np.int64)
        n = len(self.data)
        self.sums = []
        letters = np.frombuffer(self.data, np.uint8).astype(np.uint64) + U(1)
        for up, down in powers(max(BLOCK_BYTES * 5 // 4, 1 << n.bit_length() if n > BLOCK_BYTES * 5 // 4 else 0), bases):
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(letters * up[:n], out=total[1:])
            self.sums.append((total, down))
        self.of = np.repeat(np.arange(len(self.lens), dtype=np.int32), self.lens)
        at = np.arange(n, dtype=np.int64)
        self.left = (np.repeat(self.starts[1:], self.lens) - at).astype(np.int32)  # bytes from here to the piece's end
        self.inner = (at - np.repeat(self.starts[:-1], self.lens)) < np.repeat(self.own, self.lens)  # the piece's own

    def prints(self, at: np.ndarray, length: int) -> np.ndarray:
        h = [(total[at + length] - total[at]) % U(p) * down[at] % U(p) for (total, down), p in zip(self.sums, PRIMES)]
        return mix(h[0] << U(31) | h[1], length)

    def sample(self) -> tuple[np.ndarray, np.ndarray]:
        """The sampled places of texts that are long enough, and the fingerprints of what follows them. A place in the bytes
        that two pieces share counts for both, which only makes it a place to look at."""
        table = np.zeros(PERIOD, bool)
        table[list(COVER)] = True
        depth = self.length - PERIOD + 1
        offset = np.arange(len(self.data), dtype=np.int64) - (self.starts[:-1] - np.asarray(self.row["starts"], np.int64))[self.of]
        long = np.asarray(self.row["sizes"], np.int64) >= self.length
        at = np.flatnonzero(table[offset % PERIOD] & (self.left >= depth) & long[self.of])
        return at, self.prints(at, depth)

    def candidates(self, shared: np.ndarray, skip: np.ndarray) -> np.ndarray:
        """Own places whose passage may repeat: within PERIOD before a sample with a shared rank, in texts not skipped."""
        step = np.zeros(len(self.data) + 1, np.int32)
        low = np.maximum(shared - PERIOD + 1, self.starts[self.of[shared]])
        np.add.at(step, low, 1)
        np.add.at(step, shared + 1, -1)
        return np.flatnonzero((np.cumsum(step[:-1]) > 0) & (self.left >= self.length) & self.inner & ~skip[self.of])

    def digest(self, at: int) -> bytes:
        return hashlib.blake2b(self.data[at : at + self.length], digest_size=DIGEST).digest()


def spread(block: int, keys: np.ndarray, parts: int) -> list[tuple]:
    """Rows (part, block, body, n) with the distinct keys in order, and a bit for each that is there twice or more."""
    own, count = np.unique(keys, return_counts=True)
    return [(p, block, pack(steps(own[s:e]), np.packbits(count[s:e] > 1)), e - s) for p, s, e in by_parts(own, parts)]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    part, block, body, n = zip(*rows) if rows else ([], [], [], [])
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(block, pa.int64()), pa.array(body, pa.binary()), pa.array(n, pa.int32())], ["part", "block", "body", "n"])


def shared_keys(bodies: list[bytes], ns: list[int], blocks: list[int] | None = None) -> list[bytes]:
    """For each body a bit for each key: whether it is there twice or in another body. With blocks also, for the keys that
    are, another block that has it (its own, if it is there twice and nowhere else)."""
    sent = [unpack(b) for b in bodies]
    keys = np.concatenate([np.cumsum(k, dtype=np.uint64) for k, _ in sent])
    own = np.concatenate([np.unpackbits(b, count=n).astype(bool) for (_, b), n in zip(sent, ns)])
    order = np.argsort(keys)
    tie = np.concatenate([[False], keys[order[1:]] == keys[order[:-1]], [False]])
    twice = own.copy()
    twice[order[tie[1:] | tie[:-1]]] = True
    cut = np.cumsum([0, *ns])
    out = [np.packbits(twice[s:e]).tobytes() for s, e in zip(cut[:-1], cut[1:])]
    if blocks is None:
        return out
    # The first holder of a key stands for it; the first one itself asks the second.
    holder = np.repeat(np.array(blocks, np.int64), ns)
    first = np.flatnonzero(~tie[:-1])
    lead = np.repeat(first, np.diff(np.append(first, len(keys))))
    asks = np.where(np.arange(len(keys)) == lead, np.where(tie[1:], np.minimum(lead + 1, len(keys) - 1), lead), lead)
    partner = np.empty(len(keys), np.int64)
    partner[order] = holder[order[asks]]
    return [len(b).to_bytes(4, "little") + b + pack(partner[s:e][twice[s:e]].view(np.uint64)) for b, s, e in zip(out, cut[:-1], cut[1:])]


def _answer(partners: bool):
    def run(batches):
        got = all_rows(batches)
        by: dict[int, list[int]] = {}
        for i, p in enumerate(got.get("part", [])):
            by.setdefault(p, []).append(i)
        for p, at in by.items():
            blocks = [got["block"][i] for i in at]
            bits = shared_keys([got["body"][i] for i in at], [got["n"][i] for i in at], blocks if partners else None)
            yield _rows([(p, b, x, got["n"][i]) for i, b, x in zip(at, blocks, bits)])

    return run


def told(answers: list[dict], keys: np.ndarray) -> np.ndarray:
    """Whether each of a block's keys is shared, from the answers to its distinct keys."""
    own, back = np.unique(keys, return_inverse=True)
    bits = [np.unpackbits(np.frombuffer(a["body"], np.uint8), count=a["n"]) for a in sorted(answers, key=lambda a: a["part"])]
    flat = np.concatenate(bits).astype(bool) if bits else np.zeros(0, bool)
    assert len(flat) == len(own), "an answer is missing"
    return flat[back.reshape(-1)] if len(own) else np.zeros(0, bool)


def told_partners(answers: list[dict], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """told, and the partner of each key that is shared (0 for the others)."""
    split = [(int.from_bytes(a["body"][:4], "little"), a) for a in answers]
    shared = told([a | {"body": a["body"][4 : 4 + n]} for n, a in split], keys)
    own, back = np.unique(keys, return_inverse=True)
    flat = np.zeros(len(own), np.int64)
    twice = np.zeros(len(own), bool)
    twice[back.reshape(-1)[shared]] = True
    listed = [unpack(a["body"][4 + n :])[0].view(np.int64) for n, a in sorted(split, key=lambda x: x[1]["part"])]
    flat[twice] = np.concatenate(listed) if listed else np.zeros(0, np.int64)
    return shared, flat[back.reshape(-1)] if len(own) else np.zeros(0, np.int64)


class Job:
    """What the tasks of a run share."""

    def __init__(self, length: int, seed: int):
        rng = random.Random(seed)
        self.length, self.bases = length, tuple(rng.randrange(1 << 20, p - 1) for p in PRIMES)
        self.paths: dict[str, str] = {}

    def over_blocks(self, f, *mail: str):
        """f(block, its mail by name, ..) over the rows of a table of blocks, as a function for mapInArrow."""

        def run(batches):
            boxes = {name: Mail(self.paths[name]) for name in mail}
            for batch in batches:
                for row in batch.to_pylist():
                    yield f(Block(row, self.length, self.bases), {name: box.of(row["block"]) for name, box in boxes.items()})

        return lean(run)

    def places(self, block: Block, mail: dict) -> np.ndarray:
        """The block's places to compare: not in texts that are a copy of an earlier one."""
        firsts = {c["digest"]: c["first"] for c in mail["copies"]}
        later = np.array([firsts.get(d, r) != r for d, r in zip(block.row["digests"], block.row["rows"])], bool)
        at, keys = block.sample()
        return block.candidates(at[told(mail["ranks"], keys)], later)

    def send_sample(self, parts: int):
        return self.over_blocks(lambda block, mail: _rows(spread(block.row["block"], block.sample()[1], parts)))

    def send_places(self, parts: int):
        return self.over_blocks(lambda block, mail: _rows(spread(block.row["block"], block.prints(self.places(block, mail), self.length), parts)), "copies", "ranks")

    def runs(self, block: Block, mail: dict) -> pa.RecordBatch:
        """A block's stretches of ties, and windows that cover them with their fingerprints and partners."""
        at = self.places(block, mail)
        keys = block.prints(at, self.length)
        shared, partner = told_partners(mail["ties"], keys)
        at, keys, partner = at[shared], keys[shared], partner[shared]
        fresh = np.flatnonzero(np.diff(at, prepend=-2) != 1)
        last = np.append(fresh[1:], len(at))[: len(fresh)] - 1
        # Every LENGTH-th place of a stretch and its last one.
        inside = np.arange(len(at)) - np.repeat(fresh, last - fresh + 1) if len(at) else np.zeros(0, np.int64)
        chosen = inside % self.length == 0
        chosen[last] = True
        body = pack(at[fresh].astype(np.uint64), at[last].astype(np.uint64), at[chosen].astype(np.uint64), keys[chosen], partner[chosen].view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array([block.row["block"]], pa.int64()), pa.array([body], pa.binary())], ["block", "body"])

    def answer(self, block: Block, mail: dict) -> pa.RecordBatch:
        """To each block that asks, for its keys the digest of a window of this block with that fingerprint; to itself of
        another window than the one it asks for."""
        out = []
        if mail["asked"]:
            at = self.places(block, mail)
            keys = block.prints(at, self.length)
            order = np.argsort(keys)
            at, keys = at[order], keys[order]
            for ask in mail["asked"]:
                wanted, own = unpack(ask["body"])
                first = np.searchsorted(keys, wanted)
                second = np.minimum(first + 1, max(len(keys) - 1, 0))
                found = at[np.minimum(first, max(len(keys) - 1, 0))]
                if ask["asker"] == block.row["block"]:
                    found = np.where((found == own.astype(np.int64)) & (keys[second] == wanted), at[second], found)
                out.append((ask["asker"], block.row["block"], b"".join(block.digest(int(p)) for p in found)))
        to, of, body = zip(*out) if out else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array(of, pa.int64()), pa.array(body, pa.binary())], ["block", "asker", "body"])

    def cut(self, with_bytes: bool):
        return self.over_pieces(with_bytes)

    def over_pieces(self, with_bytes: bool):
        """Every piece's removed spans; whole texts finished, pieces of long ones with their own bytes. bad: windows whose
        bytes aren't their partner's."""

        def run(batches):
            boxes = {name: Mail(self.paths[name]) for name in ("copies", "runs", "replies")}
            for batch in batches:
                for row in batch.to_pylist():
                    mail = {name: box.of(row["block"]) for name, box in boxes.items()}
                    yield self.finish(row, mail, with_bytes)

        return lean(run)

    def finish(self, row: dict, mail: dict, with_bytes: bool) -> pa.RecordBatch:
        data, length = row["data"], self.length
        first, last, at, keys, partner = unpack(mail["runs"][0]["body"]) if mail["runs"] else [np.zeros(0, np.uint64)] * 5
        first, last, at, partner = (x.astype(np.int64) for x in (first, last, at, partner.view(np.int64)))
        # The replies come in the order of the questions to each partner.
        replies = {r["asker"]: r["body"] for r in mail["replies"]}
        bad = 0
        for p in np.unique(partner).tolist():
            body = replies[p]
            for k, i in enumerate(np.flatnonzero(partner == p).tolist()):
                own = hashlib.blake2b(data[at[i] : at[i] + length], digest_size=DIGEST).digest()
                bad += own != body[k * DIGEST : (k + 1) * DIGEST]
        step = np.zeros(len(data) + 1, np.int32)
        np.add.at(step, first, 1)
        np.add.at(step, last + length, -1)
        gone = np.cumsum(step[:-1]) > 0
        copied = {c["digest"] for c in mail["copies"]}
        begin = np.concatenate([[0], np.cumsum(row["lens"])])
        out = []
        for i, (s, e) in enumerate(zip(begin[:-1].tolist(), begin[1:].tolist())):
            mask, text = gone[s:e], data[s:e]
            if row["digests"][i] in copied and row["digests"][i] is not None:
                mask = np.ones(e - s, bool)
            start, whole = row["starts"][i], row["sizes"][i] <= row["lens"][i] and row["starts"][i] == 0
            out.append(finished(row["rows"][i], start, row["ids"][i], row["sizes"][i], mask, text, with_bytes) if whole else
                       (row["rows"][i], start, row["ids"][i], row["sizes"][i], spans_of(mask, start), None, None, None, text[: row["own"][i]]))
        cols = [*zip(*out)] if out else [[]] * 9
        bads = [bad] + [0] * (len(out) - 1) if out else []
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([*cols, bads], CUT_KINDS)], CUT_NAMES)


CUT_NAMES = ["row", "piece", "doc_id", "size", "spans", "n_removed", "n_spans", "kept_sha256", "kept", "bad"]
CUT_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int64()]


def edges_of(mask: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))) if mask.any() else np.zeros(0, np.int64)


def spans_of(mask: np.ndarray, start: int = 0) -> str:
    edge = edges_of(mask) + start
    return ",".join(f"{a}:{b}" for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist()))


def finished(row, piece, doc_id, size, mask, text, with_bytes):
    edge = edges_of(mask)
    kept = np.frombuffer(text, np.uint8)[~mask].tobytes() if len(edge) else text
    return row, piece, doc_id, size, spans_of(mask), int(mask.sum()), len(edge) // 2, hashlib.sha256(kept).hexdigest(), kept if with_bytes else None


def _joined(with_bytes: bool):
    """Pieces of long texts, a text's in order: one row for each text. Only its removed spans and what is kept are held."""

    def run(batches):
        now, parts, spans = None, [], []

        def done():
            merged: list[list[int]] = []
            for a, b in sorted(spans):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            text = b"".join(parts)
            mask = np.zeros(len(text), bool)
            for a, b in merged:
                mask[a:b] = True
            return finished(now[0], 0, now[1], len(text), mask, text, with_bytes)

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if now is None or r["row"] != now[0]:
                    if now is not None:
                        out.append(done())
                    now, parts, spans = (r["row"], r["doc_id"]), [], []
                parts.append(r["kept"])
                spans += [tuple(map(int, x.split(":"))) for x in r["spans"].split(",") if x]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([*zip(*out), [0] * len(out)], CUT_KINDS)], CUT_NAMES)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip([*done(), 0], CUT_KINDS)], CUT_NAMES)

    return run


def _questions(batches):
    """From a block's windows what it asks of each partner."""
    for batch in batches:
        out = []
        for block, body in zip(batch.column("block").to_pylist(), batch.column("body").to_pylist()):
            _, _, at, keys, partner = unpack(body)
            for p in np.unique(partner).tolist():
                mine = partner == p
                out.append((np.int64(p), block, pack(keys[mine], at[mine])))
        to, of, bodies = zip(*out) if out else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array(of, pa.int64()), pa.array(bodies, pa.binary())], ["block", "asker", "body"])


def cut_repeats(docs: DataFrame, length: int = LENGTH, with_bytes: bool = True, seed: int | None = None) -> DataFrame:
    """One row for each row of docs (doc_id, text) without the bytes of repeated passages.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start:end in bytes, comma-joined) and kept, the
    remaining bytes (null unless with_bytes; they may end within a character). length must be PERIOD at least. A byte
    goes if a string of length bytes over it also starts elsewhere in any text, its own included; passages never cross
    texts. All occurrences go, the first too. The result doesn't depend on seed, which draws the fingerprints' bases; should
    two different windows ever share a fingerprint, the run starts over with other bases.

    Null texts count as empty; empty and short texts have no passage. Repeated rows are copies of each other and lose
    everything if they are long enough. A long text is worked on in pieces and put together at the end, where one task holds
    it. Empty tables give empty results.
    """
    if length < PERIOD:
        raise ValueError(f"length must be {PERIOD} at least")
    spark = docs.sparkSession
    for _ in range(4):
        scratch, job = Scratch(spark, "repeats"), Job(length, random.SystemRandom().getrandbits(60) if seed is None else seed)
        seed = None
        with arrow_rows(spark):
            done, bad = _cut(docs, job, scratch, with_bytes)
        if not bad:
            return done
        scratch.drop()
    raise RuntimeError("windows with different bytes share their fingerprints again and again")


def _cut(docs: DataFrame, job: Job, scratch: Scratch, with_bytes: bool) -> tuple[DataFrame, int]:
    spark, length = docs.sparkSession, job.length
    base = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    table = scratch.keep(base.mapInArrow(lean(_packed(BLOCK_BYTES, length)), BLOCKS), "blocks")
    size = table.agg(F.sum(F.octet_length("data"))).first()[0] or 0

    # Texts that are copies of each other as a whole: a digest comes once from each block.
    named = table.select("block", F.explode(F.arrays_zip("digests", "rows", "starts")).alias("t")).where("t.digests IS NOT NULL AND t.starts = 0")
    held = named.groupBy("block", F.col("t.digests").alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.min("t.rows").alias("first"))
    twice = held.groupBy("digest").agg(F.sum("n").alias("n"), F.min("first").alias("first")).where("n > 1").select("digest", "first")
    # Every block that has a piece of such a text is told.
    pieces = table.select("block", F.explode(F.array_distinct("digests")).alias("digest")).where("digest IS NOT NULL")
    job.paths["copies"] = posted(pieces.join(twice, "digest"), scratch, "copies")

    parts = parts_for(spark, size * len(COVER) * 8 // PERIOD)
    ranks = answered(table.mapInArrow(job.send_sample(parts), SENT), parts, _answer(False), SENT)
    job.paths["ranks"] = posted(ranks, scratch, "ranks")
    parts = parts_for(spark, size * 2)
    ties = answered(table.mapInArrow(job.send_places(parts), SENT), parts, _answer(True), SENT)
    job.paths["ties"] = posted(ties, scratch, "ties")
    # Stretches of ties, questions about their windows, and what the partners answer.
    runs = scratch.keep(table.mapInArrow(job.over_blocks(job.runs, "copies", "ranks", "ties"), RUNS), "stretches")
    job.paths["runs"] = posted(runs, scratch, "runs")
    job.paths["asked"] = posted(runs.mapInArrow(lean(_questions), ASKED), scratch, "asked")
    scratch.drop("ties", "stretches")
    job.paths["replies"] = posted(table.mapInArrow(job.over_blocks(job.answer, "copies", "ranks", "asked"), ASKED), scratch, "replies")
    done = scratch.keep(table.mapInArrow(job.cut(with_bytes), CUT), "cut")
    bad = done.agg(F.sum("bad")).first()[0] or 0
    whole, long = done.where("n_removed IS NOT NULL"), done.where("n_removed IS NULL")
    long = long.repartition("row").sortWithinPartitions("row", "piece").mapInArrow(lean(_joined(with_bytes)), CUT)
    result = whole.unionByName(long).select("doc_id", F.col("size").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256", "spans", "kept")
    scratch.drop("blocks", "copies", "ranks", "runs", "asked", "replies")
    return result, bad


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(tables(sf_dir, "documents"))
    return cut_repeats(docs, with_bytes=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
