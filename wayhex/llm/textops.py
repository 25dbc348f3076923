"""Array-wise text work shared by the operators: batches cut by bytes, words, five-word shingles, MinHash.

A word is a maximal run of ASCII letters and digits and of non-ASCII characters
after simple lower-casing. A shingle is five consecutive words; a text of one to
four words has one shingle made of all its words; a text without words has none.
Hashes are 64-bit and depend on the words alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORDS_PER_SHINGLE = 5
#: Texts longer than this many bytes are worked on in parts.
CHUNK = 4 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=_U))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse, modulo 2**64."""
    if len(_POWERS[0]) < n:
        for i, b in enumerate((_BASE, _INV)):
            p = np.full(n, b, _U)
            p[0] = 1
            _POWERS[i] = np.multiply.accumulate(p)
    return _POWERS[0][:n], _POWERS[1][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """S with S[i] the weighted sum of the first i bytes; see span_hash."""
    p, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTE[data] * p[: len(data)], out=out[1:])
    return out


def span_hash(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans [start, end): equal bytes have equal hashes wherever they stand."""
    _, q = powers(len(s))
    return mix((s[end] - s[start]) * q[start] + (end - start).astype(_U))


def cut(batches: Iterator[pa.RecordBatch], text: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``most`` bytes of text; a longer text makes a slice of its own."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
        at, total = 0, 0
        for i, n in enumerate(sizes):
            if i > at and total + n > most:
                yield b.slice(at, i - at)
                at, total = i, 0
            total += n
        if len(sizes) > at:
            yield b.slice(at)


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column (null: empty) and the offsets of its rows."""
    col = pc.fill_null(col.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
    body = col.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _word_spans(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the words of data; no word crosses a cut."""
    inside = _WORD[data]
    cutting = np.zeros(len(data) + 1, bool)
    cutting[cuts] = True
    before = np.concatenate(([False], inside[:-1])) & ~cutting[:-1]
    after = np.concatenate((inside[1:], [False])) & ~cutting[1:]
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return start, span_hash(prefix_hash(data), start, end)


def words(col: pa.Array, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a string column, and the offsets of its rows among them. Long texts go in chunks that end between words."""
    data, offsets = raw(pc.utf8_lower(pc.fill_null(col.cast(pa.large_string()), "")))
    if not len(data):
        return np.zeros(0, _U), np.zeros(len(offsets), np.int64)
    found, lo = [], 0
    while lo < len(data):
        hi = min(lo + chunk, len(data))
        while hi < len(data) and _WORD[data[hi]]:
            gap = np.flatnonzero(~_WORD[data[hi : hi + chunk]])
            hi = hi + int(gap[0]) if len(gap) else min(hi + chunk, len(data))
        start, h = _word_spans(data[lo:hi], offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi, "right")] - lo)
        found.append((start + lo, h))
        lo = hi
    start, h = (np.concatenate(x) for x in zip(*found)) if len(found) > 1 else found[0]
    return h, np.searchsorted(start, offsets)


def shingles(col: pa.Array, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of a string column, in order and with repeats, and the offsets of its rows."""
    w, at = words(col, chunk)
    n = np.diff(at)
    k = WORDS_PER_SHINGLE
    each = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    out_at = np.concatenate(([0], np.cumsum(each)))
    out = np.empty(int(out_at[-1]), _U)
    for lo in range(0, len(out), chunk):
        place = np.arange(lo, min(lo + chunk, len(out)))
        row = np.searchsorted(out_at, place, "right") - 1
        first = at[row] - out_at[row] + place
        size = np.minimum(n[row], k)
        h = size.astype(_U)
        for j in range(k):
            there = j < size
            part = w[np.where(there, first + j, 0)]
            h = np.where(there, (h * _U(_BASE)) ^ part, h)
            h = h * _U(0xFF51AFD7ED558CCD) + (h >> _U(32))
        out[lo : lo + chunk] = mix(h)
    return out, out_at


def permutations(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and addends of n hash functions on 32 bits."""
    r = np.random.default_rng(seed)
    return r.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), r.integers(0, 1 << 32, n, dtype=np.uint32)


def minima(values: np.ndarray, starts: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A row for each non-empty run of values that begins at starts, a column for each hash function: the least hash."""
    out = np.empty((len(starts), len(a)), np.uint32)
    low = (values >> _U(32)).astype(np.uint32)
    if not len(starts):
        return out
    step = 1 << 17  # keeps the work inside the processor's cache
    if len(low) <= step:
        for t in range(len(a)):
            out[:, t] = np.minimum.reduceat(low * a[t] + b[t], starts)
        return out
    out[:] = np.iinfo(np.uint32).max
    for lo in range(0, len(low), step):
        part = low[lo : lo + step]
        i, j = np.searchsorted(starts, lo, "right") - 1, np.searchsorted(starts, lo + step, "left")
        own = np.maximum(starts[i:j] - lo, 0)
        for t in range(len(a)):
            out[i:j, t] = np.minimum(out[i:j, t], np.minimum.reduceat(part * a[t] + b[t], own))
    return out
