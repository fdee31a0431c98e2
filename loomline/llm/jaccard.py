"""N-gram Jaccard join by universe-partition pigeonhole: exact, without comparing all pairs.

Sets of similar size form a size band. In a band, a hash deals the universe of shingles into m segments. Two sets that
reach the similarity differ in at most H shingles, so with m = H + 1 + spare segments at least 1 + spare segments are
identical in both. Each set is indexed by its segments' contents.

Allocation by cost: each set leaves out as many segments as the spare ones, empty ones first and then those whose content
most sets share. Of the identical segments of a pair, spare at least are dearer than the cheapest one, for either set, so
neither leaves that one out and its list finds the pair. A set that shares no more segments than the spare ones with all
others, as passages that many documents carry make it do, is in no list any more. A set with more empty segments than
spare ones leaves none out and has the empty ones indexed after all, each together with the one-deletion neighbourhood of
the segment after it: the differences can be laid round a ring so that a first segment has none and it and the next have at
most floor(2H / m) <= 1 together, so two such sets meet in one of the neighbours.

Sets of a list are compared with its hub; in a list that isn't one component then, the rest is compared across, and sets
of long lists meet by the rarest of their shingles. All candidates are verified exactly.
"""

from __future__ import annotations

from functools import lru_cache
from math import ceil, exp, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.llm.components import components
from loomline.llm.exchange import arrow_rows, lean
from loomline.llm.hashing import U, mix, shingle_sets
from loomline.llm.shared import Scratch, fits, tables

PERCENT = 80
RATIO = 1.3
#: The sets of a list of more than this that isn't one component meet by their rarest shingles, not pair by pair.
LONG = 32
#: A key's lowest bits are its band's number modulo 4; a set is in fewer bands than that.
SLOT_BITS = 2
#: Up to so many rows of 24 bytes are broadcast; beyond it the same join goes by a shuffle.
BROADCAST_ROWS = 500_000


@lru_cache(maxsize=4)
def bands(largest: int, percent: int) -> list[tuple[int, int, int, int]]:
    """(least size, largest size, segments, spare) of each band up to the size."""
    out, low = [], 1
    while low <= largest:
        high = max(low, int(low * RATIO))
        differ = (high + high * 100 // percent) * (100 - percent) // (100 + percent)
        spare = 0
        for _ in range(8):
            m = differ + 1 + spare
            empty = m * exp(-low / m)
            spare = ceil(empty + 2 * sqrt(empty * (1 - exp(-low / m))) + differ / 8)
            spare = min(spare, 2 * differ + 2)
        out.append((low, high, differ + 1 + spare, spare))
        low = high + 1
    return out


def band_of(n: int, table: list) -> int:
    return next(i for i in range(len(table)) if n <= table[i][1])


class Segments:
    """A set's segments in a band: the sums of their contents, and keys of those that aren't empty."""

    def __init__(self, tokens: np.ndarray, b: int, m: int):
        self.of = (mix(tokens, 1000 + b) % U(m)).astype(np.int64)
        self.content, self.m = mix(tokens, 77), m
        self.sums, self.count = np.zeros(m, np.uint64), np.bincount(self.of, minlength=m)
        np.add.at(self.sums, self.of, self.content)
        self.names = mix((np.arange(m, dtype=np.uint64) + U(b << 32)) * U(0xD6E8FEB86659FD93))
        self.full = np.flatnonzero(self.count)
        self.slot = b & 3
        self.keys = self.named(mix(self.sums[self.full] ^ self.names[self.full], 1))

    def named(self, keys: np.ndarray) -> np.ndarray:
        return keys >> U(SLOT_BITS) << U(SLOT_BITS) | U(self.slot)

    def chained(self, j: int) -> np.ndarray:
        """Keys of segment j's content with each one-deletion neighbour of the next one's."""
        after = (j + 1) % self.m
        around = np.concatenate([self.sums[after : after + 1], self.sums[after] - self.content[self.of == after]])
        return self.named(mix(around ^ mix(self.sums[j : j + 1] ^ self.names[j : j + 1], 4), 2))


def bands_of(n: int, percent: int, table: list) -> list[int]:
    """The bands that sets of that similarity to one of n can be in, none larger than its own."""
    out = []
    for b in range(band_of(n, table) if n else -1, -1, -1):
        if table[b][1] * 100 < n * percent:
            break
        out.append(b)
    return out


def segmented(tokens: np.ndarray, percent: int, table: list | None = None):
    """(segments, spare) for each of the set's bands."""
    n = len(tokens)
    table = table or bands(1 << max(10, n.bit_length() + 1), percent)
    for b in bands_of(n, percent, table):
        yield Segments(tokens, b, table[b][2]), table[b][3]


def _joined(keys: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)


def index_keys(tokens: np.ndarray, percent: int = PERCENT, table: list | None = None) -> np.ndarray:
    """The keys of a set of hashes. Sets of that similarity have a key in common."""
    keys = []
    for s, spare in segmented(tokens, percent, table):
        keys.append(s.keys)
        if s.m - len(s.full) > spare:
            keys += [s.chained(j) for j in np.flatnonzero(s.count == 0)]
    return _joined(keys)


def allowances(tokens: np.ndarray, percent: int = PERCENT, table: list | None = None) -> int:
    """How many of its lists the set leaves out in each band: spare segments less empty ones, 16 bits at the place of the
    band's number modulo 4."""
    out, n = 0, len(tokens)
    table = table or bands(1 << max(10, n.bit_length() + 1), percent)
    for b in bands_of(n, percent, table):
        _, _, m, spare = table[b]
        empty = m - np.count_nonzero(np.bincount((mix(tokens, 1000 + b) % U(m)).astype(np.int64), minlength=m))
        out |= min(max(0, spare - int(empty)), 0xFFFF) << 16 * (b & 3)
    return out


def set_digest(tokens: np.ndarray) -> int:
    """One 64-bit name for equal sets: the sum of two finalised sums."""
    a = int(mix(tokens, 5).sum(dtype=np.uint64)) if len(tokens) else 0
    b = int(mix(tokens, 6).sum(dtype=np.uint64)) if len(tokens) else 0
    return int(np.array([(a ^ (b * 0x9E3779B97F4A7C15 + len(tokens))) % 2**64], np.uint64).view(np.int64)[0])


SLOTS = 64


def signature(tokens: np.ndarray) -> np.ndarray:
    """How many of the set's hashes fall into each of 64 slots, 255 at most, as 8 longs. Two sets differ in at least as
    many hashes as the slots' differences come to."""
    count = np.bincount((mix(tokens, 21) >> U(58)).astype(np.int64), minlength=SLOTS)
    return np.minimum(count, 255).astype(np.uint8).view(np.int64)


SIGNATURE = [f"s{i}" for i in range(SLOTS // 8)]
PARITY = [f"o{i}" for i in range(16)]


def parity(tokens: np.ndarray) -> np.ndarray:
    """Whether an odd number of the set's hashes falls into each of 1,024 slots, as 16 longs. Two sets differ in at least as
    many hashes as slots in which their parities do."""
    odd = np.bincount((mix(tokens, 22) >> U(54)).astype(np.int64), minlength=1024) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _may_be_near(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether sizes and signatures (rows of 8 longs) allow the similarity."""
    x, y = (np.ascontiguousarray(z).view(np.uint8).astype(np.int16) for z in (x, y))
    apart = np.maximum(np.abs(x - y).sum(1), np.abs(n - m))
    return apart * (100 + percent) <= (n + m) * (100 - percent)


def _close(percent: int):
    """Of candidate pairs those whose sizes and signatures allow the similarity."""

    def run(batches):
        for batch in batches:
            x, y = (np.stack([batch.column(f"{side}{c}").to_numpy() for c in SIGNATURE], 1) for side in "xy")
            keep = _may_be_near(x, y, batch.column("xn").to_numpy(), batch.column("yn").to_numpy(), percent)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in "ab"], ["a", "b"])

    return run


def _across(percent: int):
    """From lists of sets (arrays of node, label, n and signature) the distinct pairs of different labels that may be near."""

    def run(batches):
        for batch in batches:
            sets = batch.column("sets")
            ends = sets.offsets.to_numpy()
            ends = ends - ends[0]
            flat = sets.flatten()
            node, label, n = (flat.field(c).to_numpy() for c in ("node", "label", "n"))
            marks = np.stack([flat.field(c).to_numpy() for c in SIGNATURE], 1)
            of = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
            found = [np.zeros((0, 2), np.int64)]
            for d in range(1, int(np.diff(ends).max(initial=0))):
                i = np.flatnonzero((of[:-d] == of[d:]) & (label[:-d] != label[d:]))
                i = i[_may_be_near(marks[i], marks[i + d], n[i], n[i + d], percent)]
                found.append(np.unique(np.stack([np.minimum(node[i], node[i + d]), np.maximum(node[i], node[i + d])], 1), axis=0))
            pairs = np.unique(np.concatenate(found), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in pairs.T], ["a", "b"])

    return run


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _digests(percent: int):
    def run(batches):
        for batch in batches:
            sets = shingle_sets(batch.column("text").to_pylist())
            marks = np.stack([signature(s) for s in sets]) if sets else np.zeros((0, len(SIGNATURE)), np.int64)
            columns = [batch.column("doc_id"), batch.column("h"), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_digest(s) for s in sets], pa.int64()),
                       _signed(np.array([allowances(s, percent) for s in sets], np.uint64))]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(np.ascontiguousarray(m)) for m in marks.T)], ["doc_id", "h", "n", "node", "allowed", *SIGNATURE])

    return run


def _keys(percent: int):
    """key, node: the keys of each set's segments."""

    def run(batches):
        for batch in batches:
            nodes, sets = batch.column("node").to_numpy(), shingle_sets(batch.column("text").to_pylist())
            keys = [index_keys(s, percent) for s in sets]
            at = 0
            while at < len(keys):  # about a quarter of a million rows at a time
                to, n = at, 0
                while to < len(keys) and (to == at or n + len(keys[to]) < 1 << 18):
                    n, to = n + len(keys[to]), to + 1
                yield pa.RecordBatch.from_arrays([_signed(np.concatenate(keys[at:to])), pa.array(np.repeat(nodes[at:to], [len(k) for k in keys[at:to]]), pa.int64())], ["key", "node"])
                at = to

    return run


def _sets(batches):
    """node, tokens; with partners one row for each of them, which the tokens are sent to."""
    for batch in batches:
        nodes, sets = batch.column("node").to_pylist(), shingle_sets(batch.column("text").to_pylist())
        to = batch.column("partners").to_pylist() if "partners" in batch.schema.names else [[n] for n in nodes]
        rows = [(a, n, t) for n, t, partners in zip(nodes, sets, to) for a in partners]
        at = 0
        while at < len(rows):  # about a quarter of a million tokens at a time
            to, n = at, 0
            while to < len(rows) and (to == at or n + len(rows[to][2]) < 1 << 18):
                n, to = n + len(rows[to][2]), to + 1
            part, at = rows[at:to], to
            offsets = np.concatenate([[0], np.cumsum([len(t) for *_, t in part])]).astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(offsets), _signed(np.concatenate([t for *_, t in part])))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, *_ in part], pa.int64()), pa.array([n for _, n, _ in part], pa.int64()), tokens], ["a", "b", "tokens"])


def _dear(batches):
    """node, its shingles and their parities."""
    for batch in batches:
        sets = shingle_sets(batch.column("text").to_pylist())
        odd = np.stack([parity(s) for s in sets]) if sets else np.zeros((0, len(PARITY)), np.int64)
        tokens = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("node"), tokens, *(pa.array(np.ascontiguousarray(c)) for c in odd.T)], ["node", "tokens", *PARITY])


def close(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    side = lambda on, p: nodes.select(F.col("node").alias(on), F.col("n").alias(f"{p}n"), *(F.col(c).alias(p + c) for c in SIGNATURE))
    bounded = F.broadcast if fits(nodes, BROADCAST_ROWS) else lambda df: df
    return pairs.join(bounded(side("a", "x")), "a").join(bounded(side("b", "y")), "b").mapInArrow(lean(_close(percent)), "a long, b long")


def jaccard_groups(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text).

    A document's set: the distinct runs of five words (A-Z lower-cased), or all its words as one if it has fewer. Two
    documents link when 100 * intersection >= percent * union; component_id is the least doc_id reachable by links.
    Shingles and sets are told apart by 64-bit hashes.

    Null and empty texts and texts of white space have no set: n_shingles 0, component_id their own doc_id. Rows with a
    null doc_id link like others, but are no component's least id unless it has no other: then component_id is null.
    Repeated rows are rows of the result. Texts are read whole. An empty table gives an empty result.
    """
    with arrow_rows(docs.sparkSession, 2000):
        return _groups(docs, percent, Scratch(docs.sparkSession, "jaccard")).select("doc_id", "n_shingles", "component_id")


def rarest(tokens: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """tokens(key, node): for each set the shingles among its n - ceil(similarity * n) + 1 rarest that other sets have too.
    Similar sets have one of these in common, however many share their frequent ones."""
    theirs = tokens.withColumn("sets", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("sets > 1").distinct()
    order = Window.partitionBy("node").orderBy("sets", "key")
    placed = theirs.withColumns({"place": F.row_number().over(order), "shared": F.count(F.lit(1)).over(Window.partitionBy("node"))}).join(nodes.select("node", "n"), "node")
    alone = F.col("n") - F.col("shared")  # shingles of no other set come first
    return placed.where(alone + F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).select("key", "node")


def _groups(docs: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Rows of docs with doc_id, h (the text's digest), n_shingles, component_id and label (the component's least node)."""
    if percent < 50:
        raise ValueError("the similarity must be 50 at least")
    base = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"]).alias("h"), docs["text"].alias("text"))
    slim = scratch.keep(base.mapInArrow(lean(_digests(percent)), f"doc_id long, h long, n long, node long, allowed long, {', '.join(f'{c} long' for c in SIGNATURE)}"), "slim")
    # Equal sets are one node from here on; the row with the least id and digest stands for it.
    sums = [F.max(c).alias(c) for c in ("n", "allowed", *SIGNATURE)]
    nodes = slim.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("first"), F.min(F.struct("doc_id", "h")).alias("stand_in"), *sums)
    nodes = scratch.keep(nodes, "nodes")
    few = fits(nodes, BROADCAST_ROWS)

    def texts(of: DataFrame, also: tuple[str, ...] = (), small: bool = True) -> DataFrame:
        """node, text of the rows that stand for these nodes, and further columns of theirs."""
        rows = nodes.select("node", "stand_in").join(of, "node", "inner" if also else "left_semi")
        rows = rows.select(F.col("stand_in.doc_id").alias("_id"), F.col("stand_in.h").alias("_h"), "node", *also)
        mine = (F.col("h") == F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("_id"))
        return base.join(F.broadcast(rows) if few and small else rows, mine).select("node", "text", *also)

    def verified(candidates: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b) whose sets reach the similarity: each b's set goes to its partners, and no other set moves."""
        pairs = scratch.keep(candidates.distinct(), f"{name}-pairs")
        schema = "a long, b long, tokens array<bigint>"
        partners = pairs.groupBy(F.col("b").alias("node")).agg(F.collect_list("a").alias("partners"))
        sent = texts(partners, ("partners",), fits(pairs, BROADCAST_ROWS)).mapInArrow(lean(_sets), schema)
        held = texts(pairs.select(F.col("a").alias("node")).distinct()).mapInArrow(lean(_sets), schema).select("a", F.col("tokens").alias("own"))
        common = F.size(F.array_intersect("tokens", "own"))
        near = sent.join(held, "a").where(100 * common >= percent * (F.size("tokens") + F.size("own") - common))
        found = scratch.keep(near.select("a", "b").distinct(), f"{name}-links")
        scratch.drop(f"{name}-pairs")
        return found

    keyed = texts(nodes.select("node")).mapInArrow(lean(_keys(percent)), "key long, node long")
    of_key, of_band = Window.partitionBy("key"), Window.partitionBy("node", "slot")
    met = keyed.withColumns({"lo": F.min("node").over(of_key), "hi": F.max("node").over(of_key), "sets": F.count(F.lit(1)).over(of_key)})
    met = scratch.keep(met.where("lo < hi").select("key", "node", "sets"), "met")
    # Each set leaves out its dearest lists, as many as are spare in the band.
    slots = met.withColumn("slot", F.col("key").bitwiseAND((1 << SLOT_BITS) - 1).cast("int"))
    placed = slots.withColumn("place", F.row_number().over(of_band.orderBy(F.desc("sets"), "key")))
    allowed = F.expr("shiftright(allowed, 16 * slot) & 65535")
    cheap = placed.join(nodes.select("node", "allowed"), "node").where(F.col("place") > allowed).select("key", "node")
    cheap = cheap.withColumns({"lo": F.min("node").over(of_key), "hi": F.max("node").over(of_key)}).where("lo < hi").select("key", "node")
    cheap = scratch.keep(cheap, "cheap")
    # A list's hub is the set that is in most lists: an original shares more with each of its copies than they among them.
    degree = cheap.groupBy("node").agg(F.count(F.lit(1)).alias("lists"))
    ranked = cheap.join(degree, "node").withColumn("hub", F.max(F.struct("lists", "node")).over(of_key)["node"])
    lists = scratch.keep(ranked.select("key", "node", "hub"), "lists")
    scratch.drop("met", "cheap")
    # First each set against the hub that most of its lists have: large groups are mostly one component then.
    often = lists.where("node <> hub").groupBy("node", "hub").agg(F.count(F.lit(1)).alias("times")).groupBy("node").agg(F.max(F.struct("times", "hub")).alias("top"))
    near = verified(close(often.select(F.col("top.hub").alias("a"), F.col("node").alias("b")), nodes, percent), "near")
    labels = components(near, scratch, "first")

    def opened(lists: DataFrame, labels: DataFrame) -> DataFrame:
        """The lists that aren't one component, with each set's label and the list's size."""
        named = lists.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        named = named.withColumns({"lo": F.min("label").over(of_key), "hi": F.max("label").over(of_key), "members": F.count(F.lit(1)).over(of_key),
                                   "hub_label": F.max(F.when(F.col("node") == F.col("hub"), F.col("label"))).over(of_key)})
        return named.where("lo < hi").select("key", "node", "hub", "label", "hub_label", "members")

    # Then the sets of long lists against their hubs.
    rest = scratch.keep(opened(lists, labels), "open1")
    star = rest.where((F.col("members") > LONG) & (F.col("label") != F.col("hub_label"))).select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    near = near.unionByName(verified(close(star, nodes, percent), "star"))
    labels = components(near, scratch, "second")
    # Then short lists across, every pair that sizes and signatures allow, and sets of long lists by their rarest shingles.
    rest = scratch.keep(opened(rest.select("key", "node", "hub"), labels), "open2")
    scratch.drop("open1", "lists")
    long = scratch.keep(rest.where(F.col("members") > LONG).select("node").distinct(), "long")
    dear = scratch.keep(texts(long).mapInArrow(lean(_dear), f"node long, tokens array<bigint>, {', '.join(f'{c} long' for c in PARITY)}"), "dear")
    refined = rarest(dear.select(F.explode("tokens").alias("key"), "node"), nodes, percent).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    short = rest.where(F.col("members") <= LONG).select("key", "node", "label").join(nodes.select("node", "n", *SIGNATURE), "node")
    short = short.groupBy("key").agg(F.collect_list(F.struct("node", "label", "n", *SIGNATURE)).alias("sets")).select("sets").mapInArrow(lean(_across(percent)), "a long, b long")
    refined = refined.select("key", "node", "label").join(nodes.select("node", "n"), "node").join(dear.drop("tokens"), "node")
    refined = scratch.keep(refined, "refined")
    x, y = (refined.select("key", F.col("node").alias(a), F.col("label").alias(f"{p}l"), F.col("n").alias(f"{p}n"), *(F.col(c).alias(p + c) for c in PARITY)) for a, p in (("a", "x"), ("b", "y")))
    apart = sum((F.bit_count(F.col(f"x{c}").bitwiseXOR(F.col(f"y{c}"))) for c in PARITY), F.lit(0))
    may_be = (F.col("a") < F.col("b")) & (F.col("xl") != F.col("yl")) & (apart * (100 + percent) <= (F.col("xn") + F.col("yn")) * (100 - percent)) & (F.abs(F.col("xn") - F.col("yn")) * (100 + percent) <= (F.col("xn") + F.col("yn")) * (100 - percent))
    cross = x.join(y, (x["key"] == y["key"]) & may_be).select("a", "b")
    more = verified(close(short.unionByName(cross).distinct(), nodes, percent), "more")
    labels = components(near.unionByName(more), scratch, "last")
    least = nodes.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"), "first")
    ids = least.groupBy("label").agg(F.min("first").alias("component_id"))
    by_node = scratch.keep(least.join(ids, "label").select("node", "label", "component_id"), "components")
    scratch.drop_but("slim", "components")
    of_set = slim.select("doc_id", "h", "n", "node").join(by_node, "node", "left")
    return of_set.select("doc_id", "h", "label", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def first_of_groups(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row of docs from each group, with all columns: that with the least id (null last), then the least text digest.

    Of repeated rows one stays. Documents without words are in no group and all stay.
    """
    scratch = Scratch(docs.sparkSession, "firsts")
    with arrow_rows(docs.sparkSession, 2000):
        groups = scratch.keep(_groups(docs, percent, Scratch(docs.sparkSession, "jaccard")).where("n_shingles > 0"), "groups")
    # doc_id and digest name a row; the order of the struct puts null ids last.
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("h"))
    best = groups.groupBy("label").agg(F.min(key).alias("best"))
    # A key is in one group, so a row stays if its key is some group's best: no join by group.
    counted = groups.groupBy(key.alias("_k")).agg(F.count(F.lit(1)).alias("n"))
    judged = counted.join(best.select(F.col("best").alias("_k"), F.lit(True).alias("_best")), "_k", "left").select("_k", F.coalesce("_best", F.lit(False)).alias("stays"), "n")
    judged = scratch.keep(judged.where("NOT stays OR n > 1"), "judged")
    gone, many = judged.where("NOT stays").select("_k"), judged.where("stays").select("_k")
    own = F.struct(docs["doc_id"].isNull().alias("none"), docs["doc_id"].cast("long").alias("id"), F.xxhash64(docs["text"]).alias("h"))
    packed = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_row"), own.alias("_own"))
    bounded = lambda df: F.broadcast(df) if fits(df, BROADCAST_ROWS) else df
    kept = packed.join(bounded(gone), F.col("_own") == F.col("_k"), "left_anti")
    if not many.limit(1).count():
        return kept.select("_row.*")
    single = kept.join(bounded(many), F.col("_own") == F.col("_k"), "left_anti").select("_row")
    again = kept.join(bounded(many), F.col("_own") == F.col("_k"), "left_semi").withColumn("_d", F.sha2(F.to_json("_row"), 256))
    return single.unionByName(again.groupBy("_own").agg(F.min_by("_row", "_d").alias("_row")).select("_row")).select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(spark.read.parquet(tables(sf_dir, "documents")))


def oracle(documents: str = "documents") -> str:
    return rf"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM {documents}),
g AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i+4], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
pairs AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
near AS MATERIALIZED (SELECT a, b FROM pairs JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE 100 * c >= {PERCENT} * (s.n + t.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.a, near.b FROM reach r JOIN near ON near.a = r.b)
SELECT w.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(reach.b) AS component_id
FROM w JOIN reach ON reach.a = w.doc_id LEFT JOIN sizes s ON s.doc_id = w.doc_id GROUP BY w.doc_id"""
