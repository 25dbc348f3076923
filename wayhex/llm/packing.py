"""Best-fit packing: best-fit decreasing with a segment tree over remaining capacities.

Bins with the same remaining capacity are interchangeable, and so are pieces of
the same length. Best-fit decreasing therefore runs exactly on the histogram of
piece lengths, which has at most ``capacity`` entries however many pieces there
are: a step puts a piece of one length into each of a whole group of equal bins.
The plan it yields says, for each rank of a piece among those of its length, the
bin and the place. Ranks come from counts per (length, salt), so no length, however
frequent, meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import written
from .textops import cut
from .tokenizing import word_encoder

CAPACITY = 4096
END_ID = 1
SALTS = 1024


class TightestBin:
    """A segment tree over capacities 0..n: the least capacity >= x that has an open group, in logarithmic time."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.open = [0] * (2 * self.size)
        self.groups: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]

    def put(self, capacity: int, first_bin: int, bins: int) -> None:
        self.groups[capacity].append((first_bin, bins))
        i = self.size + capacity
        while i:
            self.open[i] += 1
            i >>= 1

    def take(self, capacity: int) -> tuple[int, int]:
        i = self.size + capacity
        while i:
            self.open[i] -= 1
            i >>= 1
        return self.groups[capacity].pop()

    def find(self, least: int) -> int:
        """The tightest open capacity, or -1."""
        i = self.size + least
        if self.open[i]:
            return least
        while i > 1:
            if not i & 1 and self.open[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return -1


def best_fit_decreasing(histogram: dict[int, int], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Where the pieces of each length go: rows (length, first_rank, pieces, first_bin, offset).

    Rows are sorted. The pieces of a length with ranks first_rank .. first_rank + pieces - 1 go to
    the bins first_bin, first_bin + 1, ... at the offset. Bins are filled from 0
    without gaps. Lengths must lie in 1..capacity.
    """
    tree, bins, rows = TightestBin(capacity), 0, []
    for length in sorted((x for x in histogram if histogram[x]), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} doesn't fit {capacity}")
        rank, left = 0, histogram[length]
        while left:
            room = tree.find(length)
            if room < 0:
                room, first, n = capacity, bins, -(-left // (capacity // length))
                bins += n
            else:
                first, n = tree.take(room)
            # a bin that has taken one piece is the tightest for the next, until that no longer fits
            each = room // length
            full = min(n, left // each)
            rest = left - full * each if full < n else 0
            rest = min(rest, each)
            for at, many, share in ((first, full, each), (first + full, 1 if rest else 0, rest)):
                if many:
                    for k in range(share):
                        rows.append((length, rank, many, at, capacity - room + k * length))
                        rank += many
                    if room > share * length:
                        tree.put(room - share * length, at, many)
            used = full + (1 if rest else 0)
            if n > used:
                tree.put(room, first + used, n - used)
            left -= full * each + rest
    names = ("length", "first_rank", "pieces", "first_bin", "offset")
    return dict(zip(names, np.array(sorted(rows), np.int64).reshape(-1, 5).T.copy()))


def tokenize_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Each text's ids, then end_id, cut into pieces: (doc_id, piece, start, length, ids binary of little-endian uint32).

    A null text counts as empty and has one piece, [end_id]. Only texts of more
    than ``capacity`` ids are cut, at multiples of it. Repeated rows give repeated pieces, an empty table none. Only the id and the text are
    read, so other columns may have any names. Long texts are encoded in windows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut(batches, "_text"):
            found, at = word_encoder(path).encode(b.column(1))
            sizes = np.diff(at) + 1
            ids = np.full(len(found) + len(sizes), end_id, "<u4")
            ids[np.arange(len(found)) + np.repeat(np.arange(len(sizes)), sizes - 1)] = found
            first = at[:-1] + np.arange(len(sizes))
            pieces = -(-sizes // capacity)
            piece = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            row = np.repeat(np.arange(len(sizes)), pieces)
            start = piece * capacity
            length = np.minimum(sizes[row] - start, capacity)
            body = ids.tobytes()
            out = [body[x : x + n] for x, n in zip(((first[row] + start) * 4).tolist(), (length * 4).tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(out, pa.binary())], schema=schema)

    return rows.mapInArrow(encode, "doc_id long, piece int, start long, length long, ids binary")


def pack(pieces: DataFrame, length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """The rows of ``pieces`` with sequence_id and offset (columns of these names are replaced); best-fit decreasing.

    ``pieces`` is read twice, so it must be a table or a cheap plan. Every length
    must lie in 1..capacity (else the job fails, as it does for a null length). Pieces of a
    length are ranked by a hash of their row; repeated rows get different
    places. An empty input gives an empty result. Columns mustn't be maps.
    """
    keep = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    row_hash = F.xxhash64(*keep)
    salt = F.pmod(row_hash, F.lit(SALTS))
    rows = pieces.select(F.struct(*keep).alias("_r"), F.col(length).cast("long").alias("_n"), salt.alias("_salt"), row_hash.alias("_h"))
    #: at most capacity * SALTS rows, however many pieces there are
    counts = rows.groupBy("_n", "_salt").agg(F.count(F.lit(1)).alias("_c"))
    counts = written(counts, "lengths")
    histogram = {r["_n"]: r["n"] for r in counts.groupBy("_n").agg(F.sum("_c").alias("n")).collect()}
    if None in histogram:
        raise ValueError("a piece has no length")
    plan = best_fit_decreasing(histogram, capacity)
    key = plan["length"] << 42 | plan["first_rank"]
    before = counts.withColumn("_before", F.coalesce(F.sum("_c").over(Window.partitionBy("_n").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = rows.withColumn("_k", F.row_number().over(Window.partitionBy("_n", "_salt").orderBy("_h")) - 1)
    ranked = ranked.join(before.select("_n", "_salt", "_before"), ["_n", "_salt"]).select("_r", "_n", (F.col("_before") + F.col("_k")).alias("_rank"))

    @F.pandas_udf("struct<sequence_id:long,offset:long>")
    def place(n, rank):  # noqa: ANN001, ANN202
        import pandas as pd

        i = np.searchsorted(key, n.to_numpy() << 42 | rank.to_numpy(), "right") - 1
        return pd.DataFrame({"sequence_id": plan["first_bin"][i] + rank.to_numpy() - plan["first_rank"][i], "offset": plan["offset"][i]})

    return ranked.select("_r", place("_n", "_rank").alias("_p")).select("_r.*", "_p.*")


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, keep_ids: bool = True) -> DataFrame:
    """Packed pieces: (doc_id, piece, start, length, ids if kept, ids_crc32, sequence_id, offset).

    The pieces are written once to the shared folder, since packing reads them
    twice. Null ids, null and empty texts, repeated rows: see tokenize_pieces and pack.
    """
    pieces = tokenize_pieces(docs, path, id_col, text_col, capacity).withColumn("ids_crc32", F.crc32("ids"))
    return pack(written(pieces if keep_ids else pieces.drop("ids"), "pieces"), capacity=capacity)
