"""Text normalisation and formats, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Arabic vowel marks and the lengthening stroke; letters that are folded; what each becomes.
MARKS = "[ً-ْـ]"
FOLD_FROM, FOLD_TO = "أإآىة", "ااايه"


def strip_marks(text: Column) -> Column:
    return F.regexp_replace(text, MARKS, "")


def norm(text: Column) -> Column:
    """The form in which words are compared: no vowel marks, folded letters, letters and digits only, lower case."""
    folded = F.translate(strip_marks(text), FOLD_FROM, FOLD_TO)
    return F.lower(F.regexp_replace(folded, r"[^\p{L}\p{N}_]", ""))


NORM_SQL = r"lower(regexp_replace(translate(regexp_replace({0}, '[\x{{064B}}-\x{{0652}}\x{{0640}}]', '', 'g'), 'أإآىة', 'اااايه'), '[^\p{{L}}\p{{N}}_]', '', 'g'))".replace("اااايه", FOLD_TO)


def collapse(text: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))


def digits(n: Column, least: int = 2) -> Column:
    """A whole number with leading zeros; unlike a formatter this stays in generated code."""
    text = n.cast("string")
    return F.when(F.length(text) >= least, text).otherwise(F.lpad(text, least, "0"))


def clock_short(ms: Column) -> Column:
    """MM:SS.ss"""
    cs = F.floor(ms / 10).cast("long")
    return F.concat(digits(F.floor(cs / 6000)), F.lit(":"), digits(F.floor(cs / 100) % 60), F.lit("."), digits(cs % 100))


def clock_cue(ms: Column) -> Column:
    """h:mm:ss.cc"""
    cs = F.floor(ms / 10).cast("long")
    return F.concat(F.floor(cs / 360000).cast("string"), F.lit(":"), digits(F.floor(cs / 6000) % 60), F.lit(":"), digits(F.floor(cs / 100) % 60), F.lit("."), digits(cs % 100))


def clock_srt(ms: Column) -> Column:
    """hh:mm:ss,mmm"""
    ms = ms.cast("long")
    return F.concat(digits(F.floor(ms / 3600000)), F.lit(":"), digits(F.floor(ms / 60000) % 60), F.lit(":"), digits(F.floor(ms / 1000) % 60), F.lit(","), digits(ms % 1000, 3))
