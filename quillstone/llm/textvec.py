"""Vectorised text: code points of many texts in one array, tokens as spans, spans as 64-bit hashes.

A span's hash is a difference of prefix sums of ``f(c) * B**k`` modulo 2**64, brought to a common
exponent with the inverse of B and then mixed, so that a batch needs a fixed number of passes.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from .runtime import mix64

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Characters of a batch of texts that is vectorised at once (a longer text is a batch by itself).
BATCH_CHARS = 1 << 19


@lru_cache(maxsize=2)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done = 1
    while done < n:
        take = min(done, n - done)
        out[done : done + take] = out[:take] * np.uint64(pow(base, done, 1 << 64))
        done += take
    return out


def powers(base: int, n: int) -> np.ndarray:
    size = 1 << 16
    while size < n:
        size *= 2
    return _powers(base, size)[:n]


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of each code point: 0 white space, 1 letter, 2 digit, mark or underscore, 3 other."""
    out = np.full(0x110000, 3, np.uint8)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            out[c] = 1
        elif x.isspace():
            out[c] = 0
        elif x.isalnum() or x == "_":
            out[c] = 2
    return out


def batches(texts: list[str], most: int = BATCH_CHARS):
    """Slices of ``texts`` of at most ``most`` characters, or of one text."""
    low = chars = 0
    for i, x in enumerate(texts):
        if i > low and chars + len(x) > most:
            yield low, i
            low, chars = i, 0
        chars += len(x)
    if low < len(texts):
        yield low, len(texts)


def join(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each followed by a line feed, and where each begins (and the end)."""
    parts = [np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) for x in texts]
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=at[1:])
    codes = np.full(at[-1], 10, np.uint32)
    for p, a in zip(parts, at[:-1].tolist(), strict=True):
        codes[a : a + len(p)] = p
    return codes, at


def spans(kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the runs of equal values over 0 in ``kind``."""
    edge = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    begin = np.r_[0, edge] if len(kind) else np.empty(0, np.int64)
    end = np.r_[edge, len(kind)] if len(kind) else begin
    word = kind[begin] > 0
    return begin[word], end[word]


class Hasher:
    """Hashes of spans of one array of values (code points, or hashes of words)."""

    def __init__(self, values: np.ndarray):
        values = mix64(values.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers(BASE, len(values) + 1)[: len(values)], out=self.sums[1:])
        self.inverse = powers(INVERSE, len(values) + 1)

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[begin]) * self.inverse[begin] + (end - begin).astype(np.uint64))


def owner(begin: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Index of the text in which each span begins."""
    return np.searchsorted(at, begin, "right") - 1


def space_words(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of the words ``[^\\x20\\x09-\\x0D]+``."""
    return spans(((codes != 32) & ((codes < 9) | (codes > 13))).astype(np.uint8))
