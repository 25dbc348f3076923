"""hash60() of many texts in arrays, for tasks that need more hashes than rows can carry."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

_SHIFTS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_PLACES = [(i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16 for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: The longest text that MD5 takes as one block.
_BLOCK = 55


def _md5_of_blocks(fixed: list[int], varied: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The first two words of the MD5 of blocks of 16 words: ``fixed`` in all blocks, plus ``varied`` by place."""
    m = len(next(iter(varied.values())))
    a, b, c, d = (np.full(m, x, np.uint32) for x in _START)
    f, t = np.empty(m, np.uint32), np.empty(m, np.uint32)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        g = _PLACES[i]
        f += a
        f += np.uint32((_SINES[i] + fixed[g]) & 0xFFFFFFFF)
        if g in varied:
            f += varied[g]
        np.left_shift(f, np.uint32(_SHIFTS[i]), out=t)
        f >>= np.uint32(32 - _SHIFTS[i])
        f |= t
        f += b
        a, b, c, d, f = d, f, b, c, a
    a += np.uint32(_START[0])
    b += np.uint32(_START[1])
    return a, b


def _runs(first: int, last: int) -> Iterator[tuple[int, int, int]]:
    """(first, last, digits) of the parts of a run of numbers that have as many digits."""
    while first <= last:
        size = len(str(first))
        end = min(last, 10**size - 1)
        yield first, end, size
        first = end + 1


@lru_cache(maxsize=16)
def _words(first: int, last: int, size: int, shift: int) -> list[np.ndarray]:
    """The digits of a run of numbers as little-endian words, the first digit at the byte ``shift`` of the first word."""
    own = np.arange(first, last + 1, dtype=np.int64)
    out = [np.zeros(len(own), np.uint32) for _ in range((shift + size + 3) // 4)]
    for k in range(size):
        word, at = divmod(shift + k, 4)
        out[word] |= (own // 10 ** (size - 1 - k) % 10 + 48).astype(np.uint32) << np.uint32(8 * at)
    return out


def pair_hashes(head: str, a: tuple[int, int], b: tuple[int, int]) -> np.ndarray:
    """hash60() of head + x + ":" + y for each x and y of two runs of numbers (first, last) from 0, as a matrix."""
    start = head.encode()
    out = np.empty((a[1] - a[0] + 1, b[1] - b[0] + 1), np.uint64)
    for a0, a1, an in _runs(*a):
        for b0, b1, bn in _runs(*b):
            n, at = len(start) + an + 1 + bn, len(start) + an + 1
            own = out[a0 - a[0] : a1 - a[0] + 1, b0 - b[0] : b1 - b[0] + 1]
            if n > _BLOCK:
                own[:] = [[int(hashlib.md5(b"%s%d:%d" % (start, x, y)).hexdigest()[:15], 16) for y in range(b0, b1 + 1)] for x in range(a0, a1 + 1)]
                continue
            block = start + bytes(an) + b":" + bytes(bn) + b"\x80" + bytes(_BLOCK - n) + (8 * n).to_bytes(8, "little")
            fixed = [int.from_bytes(block[i : i + 4], "little") for i in range(0, 64, 4)]
            varied = {at // 4 + k: w[None, :] for k, w in enumerate(_words(b0, b1, bn, at % 4))}
            for k, w in enumerate(_words(a0, a1, an, len(start) % 4), len(start) // 4):
                if len(w) == 1:
                    fixed[k] += int(w[0])
                else:
                    varied[k] = varied[k] + w[:, None] if k in varied else w[:, None]
            x, y = _md5_of_blocks(fixed, {k: np.broadcast_to(w, own.shape).ravel() for k, w in varied.items()})
            own[:] = ((x.byteswap().astype(np.uint64) << np.uint64(28)) | (y.byteswap() >> np.uint32(4))).reshape(own.shape)
    return out
