"""Words of texts as 64-bit hashes, and hashes of word sequences, on numpy arrays.

A word is a maximal run of bytes other than space and 0x09-0x0D.  Working on
UTF-8 bytes keeps that rule exact (``str.split`` splits at more characters) and
lower-casing limited to A-Z.  All hashes come from prefix sums of
``value[i] * BASE**i`` modulo 2**64, so any stretch costs one subtraction and
one multiplication.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_tables = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}

#: Bytes hashed at a time; a longer text is cut at white space where it has any.
CHUNK = 1 << 20


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, 0 to n at least."""
    if len(_tables["up"]) <= n:
        size = max(n + 1, 2 * len(_tables["up"]))
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _tables[name] = np.multiply.accumulate(steps)
    return _tables["up"], _tables["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MARKS = np.ones(256, bool)  # all but ASCII letters, digits and what is not ASCII
for _from, _to in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    _MARKS[_from:_to] = False
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_FOLDED = _BYTE.copy()
_FOLDED[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]


def _bounds(data: np.ndarray, gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    space = np.ones(len(data) + 2, bool)
    space[1:-1] = gaps[data]
    edge = np.flatnonzero(space[1:] != space[:-1])
    return edge[::2], edge[1::2]


def word_bounds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which words start and end."""
    return _bounds(np.frombuffer(text, np.uint8))


def _hashes(data: np.ndarray, table: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    start, end = _bounds(data, gaps)
    up, down = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * up[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start])


def word_hashes(text: bytes, fold: bool = False, marks: bool = False) -> np.ndarray:
    """A 64-bit hash of each word, in order.

    ``fold`` reads A-Z as a-z; ``marks`` also splits at ASCII punctuation.
    """
    table, gaps, data = (_FOLDED if fold else _BYTE), (_MARKS if marks else _SPACE), np.frombuffer(text, np.uint8)
    if len(data) <= CHUNK:
        return _hashes(data, table, gaps)
    parts, at = [], 0
    while at < len(data):
        end = min(at + CHUNK, len(data))
        while end < len(data):  # to the end of the word, however long it is
            gap = np.flatnonzero(gaps[data[end : end + CHUNK]])
            end = end + int(gap[0]) if len(gap) else min(end + CHUNK, len(data))
            if len(gap):
                break
        parts.append(_hashes(data[at:end], table, gaps))
        at = end
    return np.concatenate(parts)


class Sequences:
    """Hashes of any stretch of a word-hash array in constant time each."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        up, self.down = powers(n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def windows(self, size: int) -> np.ndarray:
        """Hash of each run of ``size`` words; empty when there are fewer."""
        n = len(self.sums) - size
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[size:] - self.sums[:n]) * self.down[:n])
