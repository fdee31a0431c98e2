"""Detectors over word sequences: repeats, restarts, gaps, and groupings of words into utterances and cues."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.functions import captions
from loomline.functions.captions import PREFIXES
from loomline.functions.text import FOLD_FROM, FOLD_TO, norm
from loomline.operators.intervals import quantised
from loomline.operators.joins import in_ranges

#: (n, how many words back a repeat may lie), longest first.
GATE = ((6, 40), (5, 25), (4, 15), (3, 8))
SPACING = 8


def by_source() -> Window:
    return Window.partitionBy("source").orderBy("idx")


def repeats(words: DataFrame, sought: list[tuple[int, int, int]], drop_last: bool = False) -> DataFrame:
    """Runs of n normalised words said again soon after: source, idx, n, back (words since the last time).

    words has norm; no word of a run is empty. sought: (n, window, distinct) for each length: the most words back, and the
    least number of different words. drop_last leaves out each source's very last run. Runs are named by two 64-bit hashes of
    their words, and words are hashed before they are sorted, so the rows that are sorted are a few numbers each. Of several
    lengths only places whose shortest run comes again within the widest window, before or after, are looked at by length: a
    longer run that is said again has such a beginning at both places.
    """
    sought = sorted(sought)
    least, most, w = sought[0][0], sought[-1][0], by_source()
    hashed = words.select("source", "idx", F.when(F.col("norm") != "", F.xxhash64("norm")).alias("h0"))
    total = F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    hashed = hashed.select("source", "idx", "h0", *(F.lead("h0", k).over(w).alias(f"h{k}") for k in range(1, most)), *([total.alias("words")] if drop_last else []))
    own = [F.col(f"h{k}") for k in range(most)]
    fresh = [F.lit(1), *(F.when(own[k].isin(*own[:k]), 0).otherwise(1) for k in range(1, most))]
    lengths = F.lit(0)
    for p, (n, _, distinct) in enumerate(sought):
        stands = F.lit(True)
        for h in own[:n]:
            stands = stands & h.isNotNull()
        if distinct > 1:
            stands = stands & (sum(fresh[1:n], fresh[0]) >= distinct)
        if drop_last:
            stands = stands & (F.col("idx") < F.col("words") - n)
        lengths = lengths + F.when(stands, 1 << p).otherwise(0)
    runs = hashed.select("source", "idx", lengths.alias("lengths"), F.xxhash64(*own[:least]).alias("a"), F.xxhash64(F.lit(least), *own[:least]).alias("b"), *own[least:]).where("lengths > 0")
    if len(sought) > 1:
        same, far = Window.partitionBy("source", "a", "b").orderBy("idx"), max(window for _, window, _ in sought)
        runs = runs.withColumns({"before": F.col("idx") - F.lag("idx").over(same), "after": F.lead("idx").over(same) - F.col("idx")}).where((F.col("before") <= far) | (F.col("after") <= far))
    named = [F.when(F.col("lengths").bitwiseAND(1 << p) != 0, F.struct(F.lit(n).cast("long").alias("n"), F.lit(window).cast("long").alias("window"), *(F.xxhash64(x, *own[least:n]).alias(x) for x in ("a", "b")))) for p, (n, window, _) in enumerate(sought)]
    if len(sought) > 1:
        runs = runs.select("source", "idx", F.explode(F.array_compact(F.array(*named))).alias("run")).select("source", "idx", "run.*")
    else:
        runs = runs.select("source", "idx", "a", "b", F.lit(sought[0][0]).cast("long").alias("n"), F.lit(sought[0][1]).cast("long").alias("window"))
    before = F.lag("idx").over(Window.partitionBy("source", *(["n"] if len(sought) > 1 else []), "a", "b").orderBy("idx"))
    return runs.withColumn("back", F.col("idx") - before).where(F.col("back") <= F.col("window")).select("source", "idx", "n", "back")


def gate_repeats(words: DataFrame) -> DataFrame:
    """All lengths of the gate together."""
    return repeats(words, [(n, window, max(2, n - 2)) for n, window in GATE])


def with_grams(hits: DataFrame, texts: DataFrame) -> DataFrame:
    """source, idx, n, gram: the n normalised words from idx on of each hit (source, idx, n). texts has each source's words as
    an array, so a source's hits meet it in one row and no word is sent anywhere for them."""
    at = F.collect_list(F.struct("idx", "n")).alias("at")
    gram = lambda h: F.transform(F.slice("words", (h["idx"] + 1).cast("int"), h["n"].cast("int")), norm)
    named = F.transform("at", lambda h: F.struct(h["idx"].alias("idx"), h["n"].alias("n"), gram(h).alias("gram")))
    return hits.groupBy("source").agg(at).join(texts, "source").select("source", F.explode(named).alias("h")).select("source", "h.*")


def spaced(hits: DataFrame, apart: int = SPACING) -> DataFrame:
    """Greedy suppression, longest run first, then earliest: a hit stands if none that stands starts within apart words.

    A source's hits are folded in order. Hits that stand are at least apart words from each other, so that a cell of so
    many words holds one of them at most and a hit is compared with three cells only: linear in the hits."""

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        cells: dict[int, int] = {}
        stays = []
        for n, idx in sorted({(-n, i) for n, i in zip(part["n"].tolist(), part["idx"].tolist())}):
            cell = idx // apart
            if all(abs(cells.get(c, idx + apart) - idx) >= apart for c in (cell - 1, cell, cell + 1)):
                cells[cell] = idx
                stays.append((idx, -n))
        return pd.DataFrame({"source": [part["source"].iloc[0]] * len(stays), "idx": [i for i, _ in stays], "n": [n for _, n in stays]})

    return hits.select("source", "idx", "n").groupBy("source").applyInPandas(fold, "source long, idx long, n long")


def gaps(words: DataFrame) -> DataFrame:
    """Adds gap_ms, the pause after each word (null after the last)."""
    return words.withColumn("gap_ms", F.lead("start_ms").over(by_source()) - F.col("end_ms"))


def context(words: DataFrame, before: int, after: int, column: str = "text") -> Column:
    return F.array_join(F.collect_list(column).over(by_source().rowsBetween(-before, after)), " ")


def around_pause(words: DataFrame, least: int, before: int, after: int) -> DataFrame:
    """The words before and after each long pause, as arrays of normalised words."""
    w = by_source()
    named = gaps(words).withColumns({"left": F.collect_list("norm").over(w.rowsBetween(-(before - 1), 0)), "right": F.collect_list("norm").over(w.rowsBetween(1, after))})
    return named.where(F.col("gap_ms") >= least).select("source", "idx", "gap_ms", "left", "right")


def stem_restart(left: Column, right: Column, least: int = 4) -> Column:
    """The last word before is the beginning of the first after, or the other way round, but not the same."""
    a, b = F.element_at(left, -1), F.element_at(right, 1)
    return (F.length(a) >= least) & (F.length(b) >= least) & (a != b) & (a.startswith(b) | b.startswith(a))


def run_restart(left: Column, right: Column, longest: int = 4, offset: int = 3) -> Column:
    """The most words (2 to longest) that end the left side and come again on the right within offset words; 0 if none."""
    found = F.lit(0)
    for j in range(2, longest + 1):
        tail = F.slice(left, -j, j)
        again = F.lit(False)
        for o in range(offset + 1):
            again = again | (tail == F.slice(right, o + 1, j))
        found = F.when((F.size(left) >= j) & again & ~F.array_contains(tail, ""), j).otherwise(found)
    return found.cast("long")


def common_order(left: list[str], right: list[str]) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(right) + 1)
    for a in left:
        before = row[:]
        for j, b in enumerate(right, 1):
            row[j] = before[j - 1] + 1 if a == b else max(row[j], row[j - 1])
    return row[-1]


@F.pandas_udf(T.LongType())
def common_order_udf(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([common_order(list(a), list(b)) for a, b in zip(left, right)], dtype="int64")


def sessions(words: DataFrame, least: int) -> DataFrame:
    """Utterances: words between pauses of least ms. source, utterance, start_ms, end_ms, n_words, text."""
    w = by_source()
    fresh = F.when(F.col("start_ms") - F.lag("end_ms").over(w) >= least, 1).otherwise(0)
    cut = words.withColumn("_f", fresh).withColumn("utterance", F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    parts = F.array_sort(F.collect_list(F.struct("idx", "text")))
    return cut.groupBy("source", "utterance").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count(F.lit(1)).alias("n_words"),
                                                  F.array_join(F.transform(parts, lambda x: x["text"]), " ").alias("text"))


def fold_words(rows: list[tuple[int, int, str]], stop) -> Iterator[tuple[int, int, int, str]]:
    """(start, end, number of words, text) of groups of (start, end, text), linear in the words. stop(group, row, next) ends
    a group after row, next being None at the end; group has the texts so far and their length joined by blanks."""
    group = Group()
    for row, after in zip(rows, [*rows[1:], None]):
        if not group.texts:
            start = row[0]
        group.add(row[2])
        if after is None or stop(group, row, after):
            yield start, row[1], len(group.texts), " ".join(group.texts)
            group = Group()


class Group:
    def __init__(self):
        self.texts: list[str] = []
        self.length = -1

    def add(self, text: str) -> None:
        self.texts.append(text)
        self.length += len(text) + 1


#: Marks that end a sentence in a caption.
SENTENCE_END = ".!؟?…"


def stop_utterance(group, row, after) -> bool:
    return after[0] - row[1] >= 800 or group.length > 220


def stop_srt(group, row, after) -> bool:
    return len(group.texts) >= 2 or row[2][-1:] in tuple(".,!?;:")


def stop_prose(group, row, after) -> bool:
    return row[2][-1:] in tuple("،.؟!…") or len(group.texts) >= 15


def plain_norm(word: str) -> str:
    """norm() of one word, in Python."""
    word = re.sub("[ً-ْـ]", "", word).translate(str.maketrans(FOLD_FROM, FOLD_TO))
    return "".join(c for c in word if c == "_" or unicodedata.category(c)[0] in "LN").lower()


def cue_stop(together: tuple[str, ...] = (), width: int = 46, pause: int = 550):
    """A cue ends with a sentence, at width letters, or before a pause; not while its last words are the beginning of a phrase
    of together, nor after a prefix that holds on to the next word."""
    begun = {tuple(ph[:k]) for ph in ([plain_norm(x) for x in phrase.split()] for phrase in together) for k in range(1, len(ph))}
    most = max(map(len, begun), default=0)

    def stop(group, row, after) -> bool:
        if row[2] in PREFIXES:
            return False
        tail = [plain_norm(x) for text in group.texts[-most:] for x in text.split()][-most:] if most else []
        if any(tuple(tail[-k:]) in begun for k in range(1, len(tail) + 1)):
            return False
        return row[2][-1:] in tuple(SENTENCE_END) or group.length >= width or after[0] - row[1] >= pause

    return stop


stop_cue = cue_stop()


def grouped(words: DataFrame, stop, by: tuple[str, ...] = ("source",)) -> DataFrame:
    """Ordered folds by the columns of by (long): them, n (the group's number), start_ms, end_ms, n_words, text. What is
    folded is one group in memory: the fold needs its words in order."""
    schema = f"{', '.join(f'{c} long' for c in by)}, seq long, start_ms long, end_ms long, n_words long, text string"
    if "seq" in by:
        schema = schema.replace(", seq long, start_ms", ", n long, start_ms")
    names = [x.split()[0] for x in schema.split(", ")]

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("idx")
        own = [part[c].iloc[0] for c in by]
        found = fold_words(list(zip(part["start_ms"].tolist(), part["end_ms"].tolist(), part["text"].tolist())), stop)
        return pd.DataFrame([(*own, i, *f) for i, f in enumerate(found)], columns=names)

    return words.select(*by, "idx", "start_ms", "end_ms", "text").groupBy(*by).applyInPandas(fold, schema)


def caption_cues(words: DataFrame, ranges: DataFrame, fps: int = 25, together: tuple[str, ...] = (), corrections: tuple[tuple[str, str], ...] = (), size: int = 60_000) -> DataFrame:
    """Cues of the words that end in each range (source, seq, start_ms, end_ms), on the delivered timeline: source, seq (by
    start), start_ms, end_ms, text. Every range ends a cue; cues that clean to nothing are left out."""
    length = quantised(F.col("end_ms") - F.col("start_ms"), fps) * (1000 // fps)
    before = Window.partitionBy("source").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    laid = ranges.withColumn("out_ms", F.coalesce(F.sum(length).over(before), F.lit(0)))
    inside = in_ranges(words, laid.select("source", "seq", "start_ms", "end_ms", "out_ms"), "end", size)
    shift = F.col("out_ms") - F.col("r_start")
    moved = inside.select("source", "seq", "idx", "text", (F.greatest("start_ms", "r_start") + shift).alias("start_ms"), (F.col("end_ms") + shift).alias("end_ms"))
    cues = grouped(moved, cue_stop(together), ("source", "seq")).withColumn("text", captions.clean(F.col("text"), corrections)).where("text <> ''")
    numbered = cues.withColumn("seq", (F.row_number().over(Window.partitionBy("source").orderBy("start_ms", "seq", "n")) - 1).cast("long"))
    return cue_times(numbered).select("source", "seq", "start_ms", "end_ms", "text")


def prose(words: DataFrame, ranges: DataFrame, fps: int = 25, size: int = 60_000) -> DataFrame:
    """What a cut says, to be read in order: source, seq (the range), n, at_ms on the delivered timeline, removed_ms and text.
    Lines of the words that end in a range, up to fifteen or to the end of a sentence; before each range but a source's first
    a row (n -1) with what the join removed."""
    length = quantised(F.col("end_ms") - F.col("start_ms"), fps) * (1000 // fps)
    by = Window.partitionBy("source").orderBy("seq")
    laid = ranges.withColumns({"out_ms": F.coalesce(F.sum(length).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "removed_ms": F.col("start_ms") - F.lag("end_ms").over(by)})
    inside = in_ranges(words, laid.select("source", "seq", "start_ms", "end_ms", "out_ms"), "end", size)
    moved = inside.select("source", "seq", "idx", "text", (F.col("start_ms") - F.col("r_start") + F.col("out_ms")).alias("start_ms"), "end_ms")
    lines = grouped(moved, stop_prose, ("source", "seq")).select("source", "seq", "n", F.col("start_ms").alias("at_ms"), F.lit(None).cast("long").alias("removed_ms"), "text")
    joins = laid.where("removed_ms IS NOT NULL").select("source", "seq", F.lit(-1).cast("long").alias("n"), F.col("out_ms").cast("long").alias("at_ms"), "removed_ms", F.lit("----").alias("text"))
    return lines.unionByName(joins)


def cue_times(cues: DataFrame, longest: int = 7000, shortest: int = 550) -> DataFrame:
    """Cues no longer and no shorter than that, and none reaching into the next."""
    end = F.greatest(F.least("end_ms", F.col("start_ms") + longest), F.col("start_ms") + shortest)
    after = F.lead("start_ms").over(Window.partitionBy("source").orderBy("seq"))
    return cues.withColumn("end_ms", F.least(end, F.coalesce(after, end)).cast("long"))


@F.pandas_udf(T.StringType())
def wrap_udf(text: pd.Series) -> pd.Series:
    return text.map(lambda t: "\n".join(captions.wrap(t)))


def with_norm(words: DataFrame) -> DataFrame:
    return words.withColumn("norm", norm(F.col("text")))
