"""Size-partitioned MinHash containment search: short items inside long documents.

Items are partitioned by size: class c has those of over 2**(c-1), at most 2**c distinct shingles.
For each class a document is cut into windows of 2**(c+1) shingles, each overlapping the next by half,
so that a stretch as long as an item lies in one window, which is at most
four times the item's size. MinHash values of windows are the lesser of those of two blocks, and
blocks of a class merge from those of the class below. An item and a document that
agree in any value of a window are candidates; the exact share of the item's
shingles that the whole document has decides. Shingles, windows and
values are made once for each document, and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written
from .textops import cut, minima, permutations, raw, shingles

THRESHOLD = 0.8
#: A window holds at least 19 % of the union where an item is contained at the threshold: it goes unseen with a probability of at most 0.81 ** 64, 1.4e-6.
VALUES = 64
SEED = 7
#: Items are searched for in blocks of at most so many, and of about so many bytes of text; a block's shingles and values are broadcast, so their size is bounded.
BLOCK, BLOCK_BYTES = 20_000, 16 << 20


class Items:
    """A block of items: distinct shingles, and by size class and hash function the items' least hashes, sorted."""

    def __init__(self, ids: list[int], texts: pa.Array):
        found, at = shingles(texts)
        self.ids = ids
        self.shingles = [np.unique(found[i:j]) for i, j in zip(at, at[1:])]
        a, b = permutations(VALUES, SEED)
        self.classes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        sizes = np.array([len(s) for s in self.shingles])
        for c in sorted({int(n - 1).bit_length() for n in sizes if n}):
            own = np.flatnonzero((sizes > 0) & (np.array([int(max(n, 1) - 1).bit_length() for n in sizes]) == c))
            body = np.concatenate([self.shingles[i] for i in own])
            values = minima(body, np.concatenate(([0], np.cumsum(sizes[own])[:-1])), a, b)
            order = np.argsort(values, axis=0, kind="stable")
            seen = np.zeros((VALUES, 1 << 16), bool)
            for t in range(VALUES):
                seen[t, values[:, t] >> np.uint32(16)] = True
            self.classes[c] = (own[order], np.take_along_axis(values, order, 0), seen)

    def search(self, found: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(row, item, item's shingles, shared shingles) of all candidates among rows of shingles, some of them below the threshold."""
        if not len(found) or not self.classes:
            return
        a, b = permutations(VALUES, SEED)
        row_of = np.flatnonzero(np.diff(at) > 0)
        begin, end = at[row_of], at[row_of + 1]
        c = min(self.classes)
        blocks = -(-(end - begin) // (1 << c))
        first = np.concatenate(([0], np.cumsum(blocks)))
        number = np.arange(first[-1]) - np.repeat(first[:-1], blocks)
        least = minima(found, np.repeat(begin, blocks) + (number << c), a, b)
        pairs: list[np.ndarray] = []
        while True:
            if c in self.classes:
                owner = np.repeat(row_of, blocks)
                window = least.copy()
                inner = owner[1:] == owner[:-1]
                window[:-1][inner] = np.minimum(least[:-1][inner], least[1:][inner])
                items, values, seen = self.classes[c]
                for t in range(VALUES):
                    near = np.flatnonzero(seen[t][window[:, t] >> np.uint32(16)])
                    v = window[near, t]
                    lo, hi = np.searchsorted(values[:, t], v, "left"), np.searchsorted(values[:, t], v, "right")
                    n = hi - lo
                    if n.any():
                        which = items[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum()), t]
                        pairs.append(np.unique(np.repeat(owner[near], n) << 32 | which))
            if c == max(self.classes):
                break
            # blocks of the next class: two by two within each row
            merged = (blocks + 1) // 2
            left = np.repeat(first[:-1] - 2 * (np.cumsum(merged) - merged), merged) + 2 * np.arange(merged.sum())
            least = np.minimum.reduceat(least, left, axis=0) if len(left) else least
            blocks, c = merged, c + 1
            first = np.concatenate(([0], np.cumsum(blocks)))
        last, own = -1, found[:0]
        for code in np.unique(np.concatenate(pairs)).tolist() if pairs else []:
            row, item = code >> 32, code & 0xFFFFFFFF
            if row != last:
                last, own = row, np.unique(found[at[row] : at[row + 1]])
            mine = self.shingles[item]
            where = np.minimum(np.searchsorted(own, mine), len(own) - 1)
            yield row, item, len(mine), int((own[where] == mine).sum())


def _blocks(items: DataFrame, item_id: str, item_text: str, block: int) -> Iterator[tuple[list[int], list[str]]]:
    ids, texts, size = [], [], 0
    for r in items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).filter("t is not null").toLocalIterator():
        ids.append(r["i"])
        texts.append(r["t"])
        size += len(r["t"])
        if len(ids) == block or size >= BLOCK_BYTES:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def contained(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """Pairs (doc_id, item_id, item_shingles, shared, containment) with containment >= threshold.

    Containment is the share of the item's distinct shingles that occur anywhere
    in the document. A null or empty text has none and is in no pair; an item
    of under five words is found where it is the whole text. Ids may be null; repeated
    rows on either side give repeated pairs; an empty table on either side gives an empty result. Only ids and texts are read, so other columns may have any names; texts of any
    length are searched whole. Items are read to the driver a block at a time. One block is one scan of the documents; for more, the
    documents' shingles are written once, each block's pairs are written, and its broadcast is let go before the next one.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    names = "doc_id long, item_id long, item_shingles long, shared long, containment double"
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("item_shingles", pa.int64()), ("shared", pa.int64()), ("containment", pa.float64())])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut(batches, "_text", 1 << 20):
            found, at = shingles(b.column(1))
            flat = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer((at * 8).astype(np.int64).tobytes()), pa.py_buffer(found.tobytes())])
            yield pa.RecordBatch.from_arrays([b.column(0), flat.cast(pa.binary())], ["doc_id", "_shingles"])

    def finder(known, made: bool):  # noqa: ANN001, ANN202
        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = known.value
            for b in cut(batches, "_shingles" if made else "_text", 2 << 20 if made else 1 << 20):
                doc = b.column(0).to_pylist()
                if made:
                    data, at = raw(b.column(1))
                    found, at = np.frombuffer(data.tobytes(), np.uint64), at // 8
                else:
                    found, at = shingles(b.column(1))
                hits = [(doc[r], own.ids[i], n, k, k / n) for r, i, n, k in own.search(found, at) if k >= threshold * n]
                if hits:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*hits), schema)], schema=schema)

        return find

    def pairs(ids: list[int], texts: list[str], source: DataFrame, made: bool):  # noqa: ANN202
        known = spark.sparkContext.broadcast(Items(ids, pa.array(texts, pa.large_string())))
        return known, source.mapInArrow(finder(known, made), names)

    parts = _blocks(items, item_id, item_text, block)
    first, second = next(parts, None), next(parts, None)
    if first is None:
        return spark.createDataFrame([], names)
    if second is None:
        return pairs(*first, rows, False)[1]
    source = written(rows.mapInArrow(make, "doc_id long, _shingles binary"), "shingles")
    out = []
    for ids, texts in chain((first, second), parts):
        known, found = pairs(ids, texts, source, True)
        out.append(written(found, "pairs"))
        known.unpersist()
    return reduce(DataFrame.unionAll, out)
