"""Whole arrays of bootstrap draws, equal to what one draw after the other would give."""

from __future__ import annotations

import hashlib
import math
import random
from collections.abc import Iterator

import numpy as np

_ROUND = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURN = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_WORD = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Bytes of a text of one MD5 block.
_ONE_BLOCK = 55
#: Slots hashed at a time; their arrays stay in a core's cache.
STRIDE = 1 << 14


def _words(start: int, stop: int, offset: int) -> dict[int, np.ndarray]:
    """The 32-bit words of MD5 blocks that hold the digits of start to stop - 1 (all of one length) and the end mark, from byte ``offset``; other bytes are 0."""
    rest, length = np.arange(start, stop, dtype=np.uint64), len(str(start))
    out = {i: np.zeros(stop - start, np.uint32) for i in range(offset // 4, (offset + length) // 4 + 1)}
    out[(offset + length) // 4] |= np.uint32(0x80 << 8 * ((offset + length) % 4))
    for at in range(offset + length - 1, offset - 1, -1):
        above = rest // np.uint64(10)
        out[at // 4] |= (rest - above * np.uint64(10) + np.uint64(48)).astype(np.uint32) << np.uint32(8 * (at % 4))
        rest = above
    return out


def _heads(prefix: bytes, digits: dict[int, np.ndarray], length: int) -> np.ndarray:
    """The first 60 bits of the MD5 of ``prefix`` and each number of ``_words``."""
    fixed = [int.from_bytes(prefix[4 * i : 4 * i + 4], "little") for i in range(16)]
    fixed[14] = 8 * (len(prefix) + length)
    words = {i: x | np.uint32(fixed[i]) if fixed[i] else x for i, x in digits.items()}
    first = min(words)
    state = list(_START)
    for i in range(first):  # the same for all numbers
        a, b, c, d = state
        x = (a + (d ^ (b & (c ^ d))) + _ROUND[i] + fixed[i]) & 0xFFFFFFFF
        state = [d, (b + (x << _TURN[i] | x >> 32 - _TURN[i])) & 0xFFFFFFFF, b, c]
    a, b, c, d = (np.full(len(words[first]), x, np.uint32) for x in state)
    t = np.empty_like(a)
    for i in range(first, 64):
        if i < 16:
            np.bitwise_xor(c, d, t)
            t &= b
            t ^= d
        elif i < 32:
            np.bitwise_xor(b, c, t)
            t &= d
            t ^= c
        elif i < 48:
            np.bitwise_xor(b, c, t)
            t ^= d
        else:
            np.invert(d, t)
            t |= b
            t ^= c
        a += t
        if _WORD[i] in words:
            a += words[_WORD[i]]
            a += np.uint32(_ROUND[i])
        else:
            a += np.uint32((_ROUND[i] + fixed[_WORD[i]]) & 0xFFFFFFFF)
        np.left_shift(a, np.uint32(_TURN[i]), t)
        a >>= np.uint32(32 - _TURN[i])
        a |= t
        a += b
        a, b, c, d = d, a, b, c
    a += np.uint32(_START[0])
    b += np.uint32(_START[1])
    return (a.byteswap().astype(np.uint64) << np.uint64(28)) | (b.byteswap() >> np.uint32(4)).astype(np.uint64)


def hashed(seed: int, reps: range, start: int, stop: int, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Of each repetition, in pieces, the positions below ``n`` that slots start to stop - 1 draw: 60 bits of MD5 of seed|repetition|slot, modulo ``n``."""
    edges = sorted({start, stop, *range(start, stop, STRIDE), *(10**k for k in range(1, 19) if start < 10**k < stop)})
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        length, ready = len(str(a)), {}
        for rep in reps:
            prefix = f"{seed}|{rep}|".encode()
            if len(prefix) + length > _ONE_BLOCK:
                x = np.array([int(hashlib.md5(prefix + str(i).encode(), usedforsecurity=False).hexdigest()[:15], 16) for i in range(a, b)], np.uint64)
            else:
                if len(prefix) not in ready:
                    ready[len(prefix)] = _words(a, b, len(prefix))
                x = _heads(prefix, ready[len(prefix)], length)
            yield rep, (x - x // np.uint64(n) * np.uint64(n)).astype(np.intp)


def sequential(seed: int, n: int, block: int = 1 << 20) -> Iterator[np.ndarray]:
    """Without end, in pieces, what ``random.Random(seed).randrange(n)`` gives call by call: its generator's 32-bit words, cut to the bits of ``n``, those of ``n`` or more left out."""
    if not 0 < n < 1 << 32:
        raise ValueError("a number of 32 bits is needed")
    _, (*key, at), _ = random.Random(seed).getstate()
    bits = np.random.MT19937()
    bits.state = {"bit_generator": "MT19937", "state": {"key": np.array(key, np.uint32), "pos": at}}
    words, shift = np.random.Generator(bits), np.uint32(32 - n.bit_length())
    while True:
        x = words.integers(0, 1 << 32, block, np.uint32) >> shift
        yield x[x < n]
