"""Words and runs of words of many texts at once, as 64-bit hashes in numpy arrays."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np

#: Texts are handled together up to about so many bytes; a longer text alone.
CHUNK = 1 << 21
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
BASE = 0x9E3779B97F4A7C55 | 1
U = np.uint64


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser; bijective for a given salt."""
    x = x + U(salt * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse modulo 2 ** 64 for i up to n."""
    up, down = np.full(n + 1, U(BASE)), np.full(n + 1, U(pow(BASE, -1, 2**64)))
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers(max(CHUNK + (CHUNK >> 1), 1 << (n - 1).bit_length() if n > CHUNK + (CHUNK >> 1) else 0))
    return up, down


def chunks(texts: list[bytes]):
    """(first, last) index ranges of about CHUNK bytes."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield first, i
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


#: Words of more bytes are hashed one by one.
LONG_WORD = 512
FIRST = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of texts in order, and the offset of each text's words in them (one more than texts).

    Words are runs of bytes other than the six ASCII white-space characters. A word is taken in steps of eight bytes, each
    mixed with what came before, so that words of up to eight bytes never share a hash, and longer ones by chance only; a
    very long word goes by a cryptographic digest.
    """
    data = b"\n".join(texts) + b"\n"
    a = np.frombuffer(data + b"\n" * 8, np.uint8)
    space = SPACES[a[: len(data)]]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    lens = ends - starts
    eight = np.lib.stride_tricks.sliding_window_view(a, 8)
    words = mix((eight[starts].view("<u8").reshape(-1) & FIRST[np.minimum(lens, 8)]) if len(starts) else np.zeros(0, np.uint64))
    left = np.flatnonzero((lens > 8) & (lens <= LONG_WORD))
    for k in range(8, LONG_WORD, 8):
        left = left[lens[left] > k]
        if not len(left):
            break
        words[left] = mix(words[left] ^ mix(eight[starts[left] + k].view("<u8").reshape(-1) & FIRST[np.minimum(lens[left] - k, 8)], k), k + 1)
    words = mix(words ^ lens.astype(np.uint64))
    for i in np.flatnonzero(lens > LONG_WORD):
        words[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    begin = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=begin[1:])
    return words, np.searchsorted(starts, begin)


def runs(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of n words; runs of different lengths are told apart."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    total = np.full(len(words) - n + 1, U(int(n) * 0x632BE59BD9B4E019 % 2**64))
    for k in range(n):
        total = mix(total + words[k : len(words) - n + 1 + k] * U(2 * k + 3), k + 1)
    return total


def shingle_sets(texts: list[str | None], span: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of span lower-cased words: of all its words if it has fewer,
    none if it has none."""
    data = [(t or "").encode("utf-8", "surrogatepass").translate(LOWER) for t in texts]
    out: list[np.ndarray] = []
    for first, last in chunks(data):
        words, offsets = word_hashes(data[first:last])
        grams = runs(words, span)
        for s, e in zip(offsets[:-1], offsets[1:]):
            if e - s >= span:
                out.append(np.unique(grams[s : e - span + 1]))
            else:
                out.append(runs(words[s:e], e - s) if e > s else np.zeros(0, np.uint64))
    return out
