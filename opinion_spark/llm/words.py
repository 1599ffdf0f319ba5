"""Words of UTF-8 texts as 64-bit hashes, for operators whose tasks run numpy.

Separators are ASCII, so bytes can be looked at one by one. A text is cut at separators into pieces
of bounded length; the memory beyond the text is that of a piece and eight bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 17


def _table(separators: set[int]) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    table[sorted(separators)] = False
    return table


#: Words between ASCII white space.
SPACED = _table({0x20, *range(0x09, 0x0E)})
#: Words of ASCII letters, digits and everything beyond ASCII; letters are lower-cased before.
LETTERS = _table({*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)})

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

BYTE_HASH = np.random.default_rng(1).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class _Powers:
    """Powers of the base and of its inverse, modulo 2^64; they never travel with a task."""

    def __init__(self) -> None:
        self.up_to = 0

    def __reduce__(self):
        return _Powers, ()

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if self.up_to < n:
            n = 1 << (n - 1).bit_length()
            self.tables = tuple(self._table(base, n) for base in (_BASE, _INVERSE))
            self.up_to = n
        return self.tables

    @staticmethod
    def _table(base: int, n: int) -> np.ndarray:
        factors = np.full(n, base, np.uint64)
        factors[0] = 1
        return np.cumprod(factors, dtype=np.uint64)


powers_to = _Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def lower(text: bytes) -> np.ndarray:
    """The bytes with A-Z lower-cased."""
    return _LOWER[np.frombuffer(text, np.uint8)]


def pieces(data: np.ndarray, is_word: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Stretches of about ``size`` bytes that end behind a separator; a longer word stays whole."""
    start, end = 0, size
    while start < len(data):
        if end < len(data):
            cut = np.flatnonzero(~is_word[data[start:end]])
            if not len(cut):
                end += end - start
                continue
            end = start + int(cut[-1]) + 1
        yield start, min(end, len(data))
        start, end = end, end + size


def spans(data: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word, and the byte behind its last."""
    flags = np.zeros(len(data) + 2, np.int8)
    flags[1:-1] = is_word[data]
    edges = np.flatnonzero(flags[1:] != flags[:-1])
    return edges[::2], edges[1::2]


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word of a piece."""
    power, inverse = powers_to(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_HASH[data] * power[: len(data)], out=sums[1:])
    value = (sums[ends] - sums[starts]) * inverse[starts]
    return mix(value + (ends - starts).astype(np.uint64))


def word_hashes(text: bytes, is_word: np.ndarray) -> np.ndarray:
    """The hash of each word of the lower-cased text, in order."""
    data = lower(text)
    found = [
        hashes(piece, *spans(piece, is_word))
        for piece in (data[a:b] for a, b in pieces(data, is_word))
    ]
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def texts(column: pa.Array) -> list[bytes]:
    """A column of strings as bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
