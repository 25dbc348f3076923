"""Exact token ids of whole texts with bounded caches, for vocabulary files whose path is a parameter."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .textops import CHUNK, prefix_hash, raw, span_hash

#: Words that a Python worker remembers; beyond, it starts anew. It only saves time.
CACHE_WORDS = 700_000
#: The contractions that the vocabulary's word pattern sets apart.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")

_SPACE, _LETTER, _DIGIT, _OTHER = 0, 1, 2, 3
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[9, 10, 13, 32]] = _SPACE
_CLASS[48:58] = _DIGIT
_CLASS[97:123] = _LETTER
_CLASS[0xC3:0xC6] = _LETTER
_ODD = np.zeros(256, bool)
_ODD[:32] = _ODD[127] = True
_ODD[[9, 10, 13]] = False
_ODD[0xC6:] = True
_ODD_C2 = np.zeros(256, bool)  # after 0xC2: spaces, controls, letters and numbers
_ODD_C2[0x80:0xA1] = True
_ODD_C2[[0xAA, 0xAD, 0xB2, 0xB3, 0xB5, 0xB9, 0xBA, 0xBC, 0xBD, 0xBE]] = True


def _printable() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, the rest from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + rest.index(b)) for b in range(256)]


class WordEncoder:
    """Ids of the lower-casing vocabulary with word ends, the same as the library's ``encode(text, add_special_tokens=False)``.

    That vocabulary splits texts into words (runs of letters, single digits, runs
    of other signs, contractions) which are encoded apart from each other. Texts in ASCII and Latin
    letters up to U+017F are split array-wise, and a word seen before is
    taken from the cache by its 64-bit hash; the library's model encodes new words. Any
    other text goes through the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.shown = _printable()
        self._forget()

    def _forget(self) -> None:
        self.places: dict[int, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 16, np.int64)
        self.words = 0

    def _learn(self, hashes: list[int], words: list[bytes]) -> None:
        tokenize, shown = self.whole.model.tokenize, self.shown
        new = [[t.id for t in tokenize("".join([shown[c] for c in w]))] for w in words]
        sizes = np.fromiter(map(len, new), np.int64, len(new))
        flat = np.fromiter((i for x in new for i in x), np.uint32, int(sizes.sum()))
        at = int(self.ends[self.words])
        while at + len(flat) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while self.words + len(new) >= len(self.ends):
            self.ends = np.concatenate((self.ends, np.zeros_like(self.ends)))
        self.ids[at : at + len(flat)] = flat
        self.ends[self.words + 1 : self.words + 1 + len(new)] = at + np.cumsum(sizes)
        self.places.update(zip(hashes, range(self.words, self.words + len(new))))
        self.words += len(new)

    def _split(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the words."""
        kind = _CLASS[data]
        tail = np.flatnonzero((data & 0xC0) == 0x80)
        kind[tail] = kind[tail - 1]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        filled = kind != _SPACE
        begins = np.empty(len(data), bool)
        begins[:1] = True
        begins[1:] = kind[1:] != kind[:-1]
        begins |= edge[:-1] | (kind == _DIGIT)
        begins &= filled
        for p in np.flatnonzero(begins & (data == 39)).tolist():
            stop = min(p + 3, int(offsets[np.searchsorted(offsets, p, "right")]))
            n = next((len(c) for c in CONTRACTIONS if data[p:stop].tobytes().startswith(c.encode())), 0)
            if n:
                begins[p + 1 : p + n] = False
                if p + n < len(data) and not edge[p + n]:
                    begins[p + n] = filled[p + n]
        start = np.flatnonzero(begins)
        stops = np.ones(len(data) + 1, bool)
        stops[:-1] = begins | ~filled | edge[:-1]
        at = np.flatnonzero(stops)
        return start, at[np.searchsorted(at, start, "right")]

    def _plain(self, col: pa.Array, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
        """Ids and offsets, in windows of about ``chunk`` bytes that end at a text's end or before a blank, where no word goes on."""
        data, offsets = raw(pc.utf8_lower(col))
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        parts, starts, sizes, lo = [], [], [], 0
        while lo < len(data):
            hi = min(lo + chunk, len(data))
            while hi < len(data) and data[hi] != 32:
                gap = np.flatnonzero(data[hi : hi + chunk] == 32)
                hi = hi + int(gap[0]) if len(gap) else min(hi + chunk, len(data))
            edges = offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi, "right")] - lo
            start, ids, size = self._window(data[lo:hi], edges if len(edges) and edges[-1] == hi - lo else np.append(edges, hi - lo))
            parts.append(ids)
            starts.append(start + lo)
            sizes.append(size)
            lo = hi
        before = np.concatenate(([0], np.cumsum(np.concatenate(sizes))))
        return np.concatenate(parts), before[np.searchsorted(np.concatenate(starts), offsets)]

    def _window(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts of the words, ids of all, number of ids of each word)."""
        start, end = self._split(data, offsets)
        unique, first, inverse = np.unique(span_hash(prefix_hash(data), start, end), return_index=True, return_inverse=True)
        keys = unique.tolist()
        get = self.places.get
        places = list(map(get, keys))
        if None in places:
            if len(self.places) + len(keys) > CACHE_WORDS:
                self._forget()
                places, get = [None] * len(keys), self.places.get
            new = [i for i, x in enumerate(places) if x is None]
            body = data.tobytes()
            self._learn([keys[i] for i in new], [body[a:b] for a, b in zip(start[first[new]].tolist(), end[first[new]].tolist())])
            places = list(map(get, keys))
        place = np.array(places, np.int64)[inverse]
        size = self.ends[place + 1] - self.ends[place]
        before = np.concatenate(([0], np.cumsum(size)))
        return start, self.ids[np.arange(before[-1]) + np.repeat(self.ends[place] - before[:-1], size)], size

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a string column (null: empty) and the offsets of its rows among them."""
        col = pc.fill_null(col.cast(pa.large_string()), "")
        data, offsets = raw(col)
        odd = _ODD[data]
        if len(data):
            odd[1:] |= (data[:-1] == 0xC2) & _ODD_C2[data[1:]]
            odd[1:] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
            odd[1:] |= (data[:-1] == 0xC4) & (data[1:] == 0xB0)
            odd[1:] |= (data[:-1] == 60) & (data[1:] == 124)
        bad = np.diff(np.concatenate(([0], np.cumsum(odd)))[offsets]) > 0
        if not bad.any():
            return self._plain(col)
        ids, at = self._plain(col.filter(pa.array(~bad)))
        parts, k = [], 0
        for text, other in zip(col, bad.tolist()):
            if other:
                parts.append(np.array(self.whole.encode(text.as_py(), add_special_tokens=False).ids, np.uint32))
            else:
                parts.append(ids[at[k] : at[k + 1]])
                k += 1
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))


_encoders: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """One encoder for each path and Python worker."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
