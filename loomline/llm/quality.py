"""Quality rules: base counts of a text, and its divergence from its language's reference histograms.

Built-in functions only; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.shared import let, tables, words

# Frequent function words by language.
COMMON = {
    "de": "der die und das von zu mit den im nicht ist auf ein eine für dem des sich als auch",
    "en": "the of and to in a is that for it with as on be by this are or was from",
    "es": "de la que el en y los las del se un una por con para es su no lo como",
    "fr": "de la le et les des en un une que qui dans pour par sur au est pas avec du",
}
N_COMMON = 20
CLASSES = ("letters", "upper", "digits", "space", "symbols", "punctuation")

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Under so many words a histogram says little, and the verdict is left to the base rules.
GUARD_WORDS = 50
#: Jensen-Shannon distances (base 2, 0 to 1) beyond which a text doesn't look like its language, and what chance adds for
#: n words: over k cells about sqrt((k - 1) / (8 n ln 2)), so 2 / sqrt(n) for the common words.
MAX_CLASS_DISTANCE, CLASS_NOISE = 0.2, 0.5
MAX_COMMON_DISTANCE, COMMON_NOISE = 0.12, 2.0

SPAN = 5


def repeated_words(ws: Column, span: int = SPAN) -> Column:
    """Words that lie in a window of span words found twice or more in the array."""

    def covered(hashes: Column) -> Column:
        def from_sorted(at: Column) -> Column:
            same = F.filter(at, lambda x, i: (x["h"] == F.get(at, i - 1)["h"]) | (x["h"] == F.get(at, i + 1)["h"]))
            places = F.array_sort(F.transform(same, lambda x: x["i"]))
            start = F.struct(F.lit(-span).alias("last"), F.lit(0).cast("long").alias("n"))
            step = lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(span), p - acc["last"])).alias("n"))
            return F.aggregate(places, start, step, lambda acc: acc["n"])

        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(ordered, from_sorted))

    window = lambda i: F.xxhash64(*(F.get(ws, i + k) for k in range(span)))
    hashes = F.transform(F.sequence(F.lit(0), F.size(ws) - span), window)
    return F.when(F.size(ws) >= span, let(hashes, covered)).otherwise(F.lit(0).cast("long"))


def base_counts(text: Column, ws: Column) -> dict[str, Column]:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size(ws).cast("long"),
        "word_chars": F.col("_word_chars"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": let(ws, lambda x: repeated_words(x)),
    }


def histograms(docs: DataFrame, lang: str) -> DataFrame:
    """Adds _classes and _common, arrays of counts; docs has _text, _ws (its words), _chars and _word_chars."""
    # The plain letters go first: the property classes cost more for each character.
    kept = F.regexp_replace(F.regexp_replace("_text", r"[a-z\x20\x09-\x0D]+", ""), r"[^\p{Lu}\p{N}\p{P}\p{S}]+", "")
    docs = docs.withColumn("_marks", kept)
    n = {"upper": r"\p{Lu}", "digits": r"\p{N}", "symbols": r"[#*$%&|<>]"}
    docs = docs.withColumns({f"_{k}": F.regexp_count("_marks", F.lit(p)).cast("long") for k, p in n.items()})
    counts = {
        "letters": F.col("_word_chars") - F.length("_marks"), "upper": F.col("_upper"), "digits": F.col("_digits"),
        "space": F.col("_chars") - F.col("_word_chars"), "symbols": F.col("_symbols"),
        "punctuation": F.length("_marks") - F.col("_upper") - F.col("_digits") - F.col("_symbols"),
    }
    lists = F.lit(None).cast("array<string>")
    for name, listed in COMMON.items():
        lists = F.when(F.col(lang) == name, F.lit(listed.split())).otherwise(lists)
    every = sorted({w for listed in COMMON.values() for w in listed.split()})

    # Each common word becomes one letter, so that counting it is one scan of a short string.
    alphabet = "." + "".join(chr(65 + i) for i in range(N_COMMON))
    hits = F.filter(F.col("_ws"), lambda w: F.lower(w).isin(every))
    codes = F.array_join(F.transform(hits, lambda w: F.substring(F.lit(alphabet), F.array_position(lists, F.lower(w)).cast("int") + 1, F.lit(1))), "")
    docs = docs.withColumn("_codes", codes)
    each = [(F.length("_codes") - F.length(F.replace("_codes", F.lit(c), F.lit("")))).cast("long") for c in alphabet[1:]]
    other = F.size("_ws").cast("long") - F.length(F.replace("_codes", F.lit("."), F.lit("")))
    return docs.withColumns({"_classes": F.array(*(counts[c].cast("long") for c in CLASSES)), "_common": F.when(lists.isNotNull(), F.array(*each, other.cast("long")))})


def references(hist: DataFrame, lang: str) -> DataFrame:
    """One row for each listed language: the sums of its histograms over all documents."""
    sums = [F.sum(F.col(c)[i]).alias(f"{c}{i}") for c, n in (("_classes", len(CLASSES)), ("_common", N_COMMON + 1)) for i in range(n)]
    found = hist.where(F.col(lang).isin(list(COMMON))).groupBy(F.col(lang).alias("_ref")).agg(*sums)
    return found.select("_ref", F.array(*(f"_classes{i}" for i in range(len(CLASSES)))).alias("_ref_classes"),
                        F.array(*(f"_common{i}" for i in range(N_COMMON + 1))).alias("_ref_common"))


def js_distance(a: Column, b: Column) -> Column:
    """Jensen-Shannon distance of two arrays of counts, base 2; null if either is empty."""
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda s, v: s + v)

    def part(p: Column, m: Column) -> Column:
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)

    def between(sums: Column) -> Column:
        def term(x: Column, y: Column) -> Column:
            p, q = x / sums["a"], y / sums["b"]
            return 0.5 * part(p, (p + q) / 2) + 0.5 * part(q, (p + q) / 2)

        whole = F.aggregate(F.zip_with(a, b, term), F.lit(0.0), lambda s, v: s + v)
        return F.when((sums["a"] > 0) & (sums["b"] > 0), F.sqrt(F.greatest(whole, F.lit(0.0))))

    return let(F.struct(total(a).alias("a"), total(b).alias("b")), between)


def assess(docs: DataFrame) -> DataFrame:
    """Adds to every row of docs (text, lang) the base counts, both distances, base_failed and kept.

    Added: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, class_distance, common_distance, base_failed,
    kept. A column of docs with one of these names is replaced. A null text counts as empty, and an empty one has no
    words and so fails. Under GUARD_WORDS words, or where the language is null or has no list, both distances are null
    and kept is the base verdict. Every row is judged by itself: repeated rows stay repeated rows. References are sums
    over all rows; an empty table gives an empty result.
    """
    added = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "common_distance", "base_failed", "kept")
    own = [c for c in docs.columns if c not in added]
    # The input's columns travel in one struct, so that no name of theirs can clash.
    base = docs.select(F.struct(*(docs[c] for c in own)).alias("_row"), docs["lang"].alias("_lang"), F.coalesce(docs["text"], F.lit("")).alias("_text"))
    base = base.withColumns({"_ws": words(F.col("_text")), "_chars": F.length("_text").cast("long")})
    base = base.withColumn("_word_chars", F.length(F.array_join("_ws", "")).cast("long"))
    refs = references(histograms(base.drop("_row"), "_lang"), "_lang")
    counted = base.withColumns(base_counts(F.col("_text"), F.col("_ws")))
    # At most one row for each listed language, so the broadcast is bounded by COMMON.
    joined = histograms(counted, "_lang").join(F.broadcast(refs), F.col("_lang") == F.col("_ref"), "left")
    long_enough = F.col("n_words") >= GUARD_WORDS
    joined = joined.withColumns({
        "n_symbols": F.col("_symbols"),
        "class_distance": F.when(long_enough, js_distance(F.col("_classes"), F.col("_ref_classes"))),
        "common_distance": F.when(long_enough, js_distance(F.col("_common"), F.col("_ref_common"))),
        "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
    })
    over = lambda c, most, noise: F.coalesce(F.col(c) > most + noise / F.sqrt("n_words"), F.lit(False))
    far = over("class_distance", MAX_CLASS_DISTANCE, CLASS_NOISE) | over("common_distance", MAX_COMMON_DISTANCE, COMMON_NOISE)
    judged = joined.withColumn("kept", ~F.col("base_failed") & ~far)
    return judged.select(*(F.col("_row")[c].alias(c) for c in own), *added)


def passing(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with docs' own columns."""
    return assess(docs.withColumn("_all", F.struct(*(docs[c] for c in docs.columns)))).where("kept").select(*(F.col("_all")[c].alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(tables(sf_dir, "documents"))
    return assess(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                               F.round("class_distance", 6).alias("class_distance"), F.round("common_distance", 6).alias("common_distance"))


def oracle(documents: str = "documents") -> str:
    lists = " ".join(f"WHEN '{k}' THEN {v.split()!r}" for k, v in COMMON.items())
    js = lambda a, b: (
        f"sqrt(greatest(0, list_sum(list_transform(range(1, len({a}) + 1), lambda i: "
        f"(CASE WHEN {a}[i] > 0 THEN 0.5 * ({a}[i] / list_sum({a})) * log2(({a}[i] / list_sum({a})) / (({a}[i] / list_sum({a}) + {b}[i] / list_sum({b})) / 2)) ELSE 0 END) + "
        f"(CASE WHEN {b}[i] > 0 THEN 0.5 * ({b}[i] / list_sum({b})) * log2(({b}[i] / list_sum({b})) / (({a}[i] / list_sum({a}) + {b}[i] / list_sum({b})) / 2)) ELSE 0 END)))))")
    return rf"""
WITH base AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    regexp_replace(coalesce(text, ''), '[^\p{{Lu}}\p{{N}}\p{{P}}\p{{S}}]+', '', 'g') AS marks,
    list_transform(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda w: lower(w)) AS toks,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    CASE lang {lists} END AS listed FROM {documents}),
grams AS (SELECT rid, i, ws[i:i+4] AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM base)),
twice AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM grams),
cover AS (SELECT rid, CAST(count(DISTINCT i + k) AS BIGINT) AS n FROM twice, range(5) r(k) WHERE n > 1 GROUP BY rid),
counts AS (SELECT b.*, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
    CAST(len(regexp_extract_all(marks, '\p{{Lu}}')) AS BIGINT) AS up, CAST(len(regexp_extract_all(marks, '\p{{N}}')) AS BIGINT) AS dig
  FROM base b LEFT JOIN cover c USING (rid)),
hists AS (SELECT *, [word_chars - length(marks), up, dig, length(t) - word_chars, n_symbols, length(marks) - up - dig - n_symbols] AS cls,
    list_transform(listed, lambda r: len(list_filter(toks, lambda w: w = r))) AS each FROM counts),
full_ AS (SELECT *, list_append(each, len(toks) - list_sum(each)) AS com FROM hists),
refs AS (SELECT lang, list(s ORDER BY i) AS rcls FROM (SELECT lang, i, sum(cls[i]) AS s FROM full_, range(1, 7) r(i) WHERE listed IS NOT NULL GROUP BY lang, i) GROUP BY lang),
refw AS (SELECT lang, list(s ORDER BY i) AS rcom FROM (SELECT lang, i, sum(com[i]) AS s FROM full_, range(1, {N_COMMON + 2}) r(i) WHERE listed IS NOT NULL GROUP BY lang, i) GROUP BY lang),
dist AS (SELECT f.*, CASE WHEN n_words >= {GUARD_WORDS} THEN {js('cls', 'rcls')} END AS cd,
    CASE WHEN n_words >= {GUARD_WORDS} AND list_sum(com) > 0 THEN {js('com', 'rcom')} END AS wd,
    n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed
  FROM full_ f LEFT JOIN refs USING (lang) LEFT JOIN refw USING (lang))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(cd > {MAX_CLASS_DISTANCE} + {CLASS_NOISE} / sqrt(n_words), false) AND NOT coalesce(wd > {MAX_COMMON_DISTANCE} + {COMMON_NOISE} / sqrt(n_words), false) AS kept,
  round(cd, 6) AS class_distance, round(wd, 6) AS common_distance FROM dist"""
