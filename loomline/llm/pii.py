"""Format-preserving pseudonyms for personal data: a keyed Feistel permutation within each format.

The permutation is a bijection on each format's values, so equal values get equal pseudonyms in every document, and
unequal ones never collide. What doesn't validate (a number that fails its check digit, an impossible date) stays.
"""

from __future__ import annotations

import hashlib
import os
import re
from datetime import date
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.llm.exchange import small_batches
from loomline.llm.shared import tables

#: Where the key comes from: a setting of the session, or a variable of the driver's environment. There is no default.
KEY_SETTING, KEY_VARIABLE = "spark.loomline.pii.key", "LOOMLINE_PII_KEY"
#: The registered queries run on made-up tables; without a configured key they show the method with this one.
DEMONSTRATION_KEY = "demonstration only"
ROUNDS = 10
KINDS = ("email", "card", "phone", "ip", "ssn", "date")

# Formats. A phone that is whole without a further group ends there, as what follows may be another value
# (an address, a year, a card); NEXT and CARD are where another value begins.
CARD = r"\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?!\w|[.-]\d)"
NEXT = r"""[\w.+-]+@ | \d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d) | \d{3}-\d{2}-\d{4}(?![\w-]) | \d{3}[.-]\d{3}[.-]\d{4}(?![\w-])
  | (?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\w/-]|\.\d)"""
PATTERN = re.compile(r"""
    (?P<email>(?<![\w.+-])[A-Za-z0-9][\w.+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})
  | (?P<ip>(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\w]|\.\d))
  | (?P<phone>(?<![\w+])\+(?:
        (?:\d{9,15} | \d{1,3}[ .-]\d{8,12} | \d{1,3}[ .-]?(?:(?:\(\d{3,4}\)|\d{3,4})[ .-]?\d{3,4}|(?:\(\d\d\)|\d\d)[ .-]?\d{4})[ .-]?\d{4})(?!\w|[.-]\d)
      | \d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})[ .-]?(?:\d{3,4}[ .-]?\d{4}|\d{6})(?=\ (?:NEXT|CARD|(?:19|20)\d\d(?!\w|[.-]\d)))
      | \d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})(?:(?:[.-]?|\ (?!NEXT))\d{2,4}){2}(?:(?:[.-]?|\ (?!NEXT|CARD))\d{2,4})?(?!\w))
    | (?<![\w(])\(\d{3}\)\ ?\d{3}[ .-]\d{4}(?!\w) | (?<![\w.+-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-]))
  | (?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))
  | (?P<date>(?<![\w/-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\w/-]|\.\d))
  | (?P<card>(?<![\w.+-])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\w]|[.-]\d))
""".replace("NEXT", NEXT).replace("CARD", CARD), re.X | re.A)
MAYBE = re.compile(r"[0-9]|@", re.A)
FIRST_DAY, DAYS = date(1900, 1, 1).toordinal(), (date(2100, 1, 1) - date(1900, 1, 1)).days


class Feistel:
    """A keyed permutation of range(size) for any size: an unbalanced Feistel network over a * b >= size, walking
    along the cycle until the value lies in the range again."""

    def __init__(self, size: int, key: str):
        self.size, self.key = size, key.encode()
        self.a = max(1, int(size**0.5))
        while self.a * self.a < size:
            self.a += 1
        self.b = -(-size // self.a)

    def _round(self, i: int, half: int, size: int) -> int:
        text = b"%d|%d|%d" % (self.size, i, half)
        return int.from_bytes(hashlib.blake2b(text, key=self.key[:64], digest_size=16).digest(), "big") % size

    def _once(self, x: int) -> int:
        left, right = divmod(x, self.b)
        for i in range(0, ROUNDS, 2):
            left = (left + self._round(i, right, self.a)) % self.a
            right = (right + self._round(i + 1, left, self.b)) % self.b
        return left * self.b + right

    def _back(self, x: int) -> int:
        left, right = divmod(x, self.b)
        for i in range(ROUNDS - 2, -2, -2):
            right = (right - self._round(i + 1, left, self.b)) % self.b
            left = (left - self._round(i, right, self.a)) % self.a
        return left * self.b + right

    def encrypt(self, x: int) -> int:
        x = self._once(x)
        while x >= self.size:
            x = self._once(x)
        return x

    def decrypt(self, x: int) -> int:
        x = self._back(x)
        while x >= self.size:
            x = self._back(x)
        return x


@lru_cache(maxsize=4096)
def permutation(size: int, key: str) -> Feistel:
    return Feistel(size, key)


def luhn(digits: str) -> int:
    """0 for a number whose last digit checks."""
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10


def refill(value: str, digits: str) -> str:
    """value with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in value)


def _card(value: str, way: str, key: str) -> str | None:
    digits = re.sub(r"\D", "", value)
    if not 12 <= len(digits) <= 19 or luhn(digits) or len(set(digits)) == 1:
        return None
    # The first digit (the network) stays, the check digit follows from the rest.
    body = len(digits) - 2
    middle = getattr(permutation(10**body, f"{key}card{digits[0]}"), way)(int(digits[1:-1]))
    head = f"{digits[0]}{middle:0{body}d}"
    return refill(value, head + str((10 - luhn(head + "0")) % 10))


def _phone(value: str, way: str, key: str) -> str | None:
    digits = re.sub(r"\D", "", value)
    country = len(re.match(r"\+?(\d*)", value)[1]) if value[0] == "+" else 0
    if country > 3:  # no separator after the country code: the first digit stays
        country = 1
    if not 9 <= len(digits) <= 15:
        return None
    body = len(digits) - country
    new = getattr(permutation(10**body, f"{key}phone{digits[:country]}"), way)(int(digits[country:]))
    return refill(value, f"{digits[:country]}{new:0{body}d}")


def _ip(value: str, way: str, key: str) -> str | None:
    parts = value.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    n = int.from_bytes(bytes(map(int, parts)), "big")
    return ".".join(map(str, getattr(permutation(2**32, f"{key}ip"), way)(n).to_bytes(4, "big")))


def _ssn_valid(n: int) -> bool:
    area, group, serial = n // 10**6, n // 10**4 % 100, n % 10**4
    return 0 < area < 900 and area != 666 and group > 0 and serial > 0


def _ssn(value: str, way: str, key: str) -> str | None:
    n = int(value.replace("-", ""))
    if not _ssn_valid(n):
        return None
    step = getattr(permutation(10**9, f"{key}ssn"), way)
    n = step(n)
    while not _ssn_valid(n):  # along the cycle to the next valid number
        n = step(n)
    return refill(value, f"{n:09d}")


def _date(value: str, way: str, key: str) -> str | None:
    """With slashes the month stands first if the values tell so, else the day does. Field widths stay."""
    sep = re.search(r"\D", value)[0]
    fields = value.split(sep)
    p = list(map(int, fields))
    order = "ymd" if sep == "-" else "mdy" if sep == "/" and p[0] <= 12 < p[1] else "dmy"
    at = {k: p[order.index(k)] for k in "ymd"}
    narrow = {k for k in "md" if len(fields[order.index(k)]) == 1}
    try:
        n = date(at["y"], at["m"], at["d"]).toordinal() - FIRST_DAY
    except ValueError:
        return None
    if not 0 <= n < DAYS:
        return None

    def fits(n: int) -> bool:
        """The date fits the widths, and reads in the same order."""
        d = date.fromordinal(n + FIRST_DAY)
        return not ("m" in narrow and d.month > 9 or "d" in narrow and d.day > 9 or order == "mdy" and d.day <= 12)

    step = getattr(permutation(DAYS, f"{key}date{order}{sep}{''.join(sorted(narrow))}"), way)
    n = step(n)
    while not fits(n):
        n = step(n)
    d = date.fromordinal(n + FIRST_DAY)
    new = {k: f"{v:0{len(fields[order.index(k)])}d}" for k, v in (("y", d.year), ("m", d.month), ("d", d.day))}
    return sep.join(new[k] for k in order)


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _email(value: str, way: str, key: str) -> str | None:
    """The local part's letters and digits are permuted within their places; the domain stays. Case stays by place."""
    local, _, domain = value.rpartition("@")
    size, n = 1, 0
    slots = [(c, 26 if c.lower() in LETTERS else 10) for c in local if c.isascii() and c.isalnum()]
    for c, base in slots:
        size, n = size * base, n * base + (LETTERS.index(c.lower()) if base == 26 else int(c))
    shape = re.sub(r"[0-9]", "0", re.sub(r"[A-Za-z]", "a", local))
    n = getattr(permutation(size, f"{key}email{shape}@{domain.lower()}"), way)(n)
    new = []
    for c, base in reversed(slots):
        n, r = divmod(n, base)
        new.append(str(r) if base == 10 else LETTERS[r].upper() if c.isupper() else LETTERS[r])
    it = reversed(new)
    return "".join(next(it) if c.isascii() and c.isalnum() else c for c in local) + "@" + domain


RULES = {"email": _email, "card": _card, "phone": _phone, "ip": _ip, "ssn": _ssn, "date": _date}


@lru_cache(maxsize=100_000)
def pseudonym(kind: str, value: str, way: str = "encrypt", key: str = DEMONSTRATION_KEY) -> str | None:
    """The value's pseudonym, or null if it doesn't validate. way="decrypt" gives the value back."""
    return RULES[kind](value, way, hashlib.sha256(key.encode()).hexdigest()[:24])


def replace(text: str, way: str = "encrypt", key: str = DEMONSTRATION_KEY) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and the spans replaced (kind, start, end) in the text given."""
    if not MAYBE.search(text):
        return text, []
    spans: list[tuple[str, int, int]] = []

    def one(m: re.Match) -> str:
        new = pseudonym(m.lastgroup, m[0], way, key)
        if new is None:
            return m[0]
        spans.append((m.lastgroup, m.start(), m.end()))
        return new

    return PATTERN.sub(one, text), spans


def _batches(key: str, way: str):
    def run(batches):
        for batch in batches:
            texts, counts, spans = [], [[] for _ in KINDS], []
            for text in batch.column("_text").to_pylist():
                new, found = (None, []) if text is None else replace(text, way, key)
                texts.append(new)
                spans.append(",".join(f"{k}:{s}:{e}" for k, s, e in found))
                for n, kind in zip(counts, KINDS):
                    n.append(sum(k == kind for k, _, _ in found))
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(texts, pa.string()), *(pa.array(n, pa.int64()) for n in counts), pa.array(spans, pa.string())],
                                             ["_row", "_text", *(f"_n_{k}" for k in KINDS), "_spans"])

    return run


def configured_key(spark: SparkSession) -> str | None:
    return spark.conf.get(KEY_SETTING, None) or os.environ.get(KEY_VARIABLE)


def pseudonymise(docs: DataFrame, key: str | None = None, way: str = "encrypt", report: bool = True) -> DataFrame:
    """docs with text's personal data replaced; with report also n_email .. n_date and pii_spans.

    key: the secret of the permutation; without it the configured one, and an error if there is none.

    Emails (local part), card numbers that pass their check digit, phone numbers, IPv4 addresses, social security
    numbers and dates from 1900 to 2099. Other columns pass unchanged, whatever their names; with report, columns of
    the added names are replaced. A null text stays null and counts 0; an empty one stays empty. Texts are read whole.
    Repeated rows stay repeated rows; an empty table gives an empty result.
    """
    key = key or configured_key(docs.sparkSession)
    if not key:
        raise ValueError(f"pseudonyms need a key: set {KEY_SETTING} or {KEY_VARIABLE}")
    small_batches(docs.sparkSession)
    added = [*(f"n_{k}" for k in KINDS), "pii_spans"] if report else []
    own = [c for c in docs.columns if c not in added]
    rest = [c for c in own if c != "text"]
    row = F.struct(F.lit(0).alias("_"), *(docs[c] for c in rest))
    packed = docs.select(row.alias("_row"), docs["text"].cast("string").alias("_text"))
    schema = T.StructType([packed.schema["_row"], T.StructField("_text", T.StringType()), *(T.StructField(f"_n_{k}", T.LongType()) for k in KINDS), T.StructField("_spans", T.StringType())])
    done = packed.mapInArrow(_batches(key, way), schema)
    columns = [F.col("_text").alias("text") if c == "text" else F.col("_row")[c].alias(c) for c in own]
    if report:
        columns += [*(F.col(f"_n_{k}").alias(f"n_{k}") for k in KINDS), F.col("_spans").alias("pii_spans")]
    return done.select(*columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(tables(sf_dir, "documents"))
    return pseudonymise(docs.select("doc_id", "text"), configured_key(spark) or DEMONSTRATION_KEY)
