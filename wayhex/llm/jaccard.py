"""N-gram Jaccard join with Bayesian candidate pruning.

Documents with the same set of shingles are one class. Classes that agree in a band
of MinHash values are candidates. Their MinHash values are compared a step at a time, and a pair is
dropped once the posterior probability that its similarity reaches the threshold,
under a uniform prior, falls below a tolerance; the shingles of the rest are compared exactly.

Pairs are never emitted: classes are brought together in blocks of bounded size (a larger group goes as pairs of
blocks), and a task returns each class's number of links and a spanning forest. A group is all classes that bands connect,
so that each text is sent once; where a connected component is larger than a block and holds few pairs that share a band, as
in a chain, the buckets of its bands are the groups, and a pair counts in the first band it shares. The cheaper of both is taken, by the texts to be sent: results are the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .storage import written
from .textops import cut, minima, mix, permutations, shingles

THRESHOLD = 0.8
#: A pair at the threshold shares no band with a probability of (1 - 0.8**5)**32, 3e-6.
BANDS, ROWS = 32, 5
STEP = 32
TOLERANCE = 1e-9
BLOCK = 512
SEED = 11
_VALUES = BANDS * ROWS
_U = np.uint64


def least_matches(step: int = STEP, values: int = _VALUES, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """For n = step, 2 step, ... compared values the fewest matches that keep a pair.

    With a uniform prior and m matches of n the posterior is Beta(m+1, n-m+1), so
    P(similarity >= t) is the probability of at most m successes in n+1 trials of probability t.
    """
    out = {}
    for n in range(step, values + 1, step):
        p, m = 0.0, -1
        while p < tolerance:
            m += 1
            p += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    found, at = shingles(texts)
    return [np.unique(found[i:j]) for i, j in zip(at.tolist(), at[1:].tolist())]


def set_hashes(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set."""
    one = [int(mix(s).sum(dtype=_U)) if len(s) else 0 for s in sets]
    two = [int(mix(s ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U)) if len(s) else 0 for s in sets]
    return np.array(one, _U).view(np.int64), np.array(two, _U).view(np.int64)


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, rid, h1, h2, n, sig) of (doc_id, rid, _text): set hashes, set size and MinHash values; null hashes where there is no word."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = permutations(_VALUES, SEED)
        for part in cut(batches, "_text"):
            sets = shingle_sets(part.column(2))
            sizes = np.array([len(s) for s in sets])
            h1, h2 = set_hashes(sets)
            some = sizes > 0
            body = np.concatenate(sets)
            least = minima(body, (np.cumsum(sizes) - sizes)[some], a, b)
            sig = np.full(len(sets), None, object)
            sig[some] = [x.tobytes() for x in least]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(h1, mask=~some), pa.array(h2, mask=~some), pa.array(sizes), pa.array(sig, pa.binary())], ["doc_id", "rid", "h1", "h2", "n", "sig"])

    return docs.mapInArrow(make, "doc_id long, rid long, h1 long, h2 long, n long, sig binary")


def links(sets: list[np.ndarray], sig: np.ndarray, side: np.ndarray | None, need: dict[int, int], threshold: float = THRESHOLD, band: int = -1) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j), i < j, of a block that share a band and reach the threshold exactly; with ``side``, only pairs across, with ``band``, only those that share no earlier one."""
    m = len(sets)
    bands = np.ascontiguousarray(sig).view(f"V{4 * ROWS}").reshape(m, BANDS)
    near = np.zeros((m, m), bool)
    for t in range(BANDS if band < 0 else band + 1):
        _, own = np.unique(bands[:, t], return_inverse=True)
        same = own[:, None] == own[None, :]
        near = same & ~near if t == band else near | same
    near &= np.arange(m)[:, None] < np.arange(m)[None, :]
    if side is not None:
        near &= side[:, None] != side[None, :]
    i, j = np.nonzero(near)
    kept = []
    for at in range(0, len(i), 1 << 15):
        x, y = i[at : at + (1 << 15)], j[at : at + (1 << 15)]
        same = np.zeros(len(x), np.int64)
        for n in need:
            same += (sig[x, n - STEP : n] == sig[y, n - STEP : n]).sum(axis=1)
            alive = same >= need[n]
            x, y, same = x[alive], y[alive], same[alive]
        kept.append((x, y))
    if not kept:
        return i, j
    i, j = (np.concatenate(z) for z in zip(*kept))
    sizes = np.array([len(s) for s in sets])
    if len(i) <= 4 * m:
        shared = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(i.tolist(), j.tolist())], np.int64)
    else:
        _, place, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        common = np.cumsum(seen > 1) - 1
        row = np.repeat(np.arange(m), sizes)
        keep = seen[place] > 1
        row, place = row[keep], common[place[keep]]
        total = np.zeros((m, m), np.int32)  # a text has fewer than 2**31 shingles
        order = np.argsort(place, kind="stable")
        row, place = row[order], place[order]
        for lo in range(0, int(place[-1]) + 1 if len(place) else 0, 4096):
            u, v = np.searchsorted(place, (lo, lo + 4096))
            there = np.zeros((m, 4096), np.float32)
            there[row[u:v], place[u:v] - lo] = 1
            total += (there @ there.T).astype(np.int32)  # exact: at most 4096 each
        shared = total[i, j].astype(np.int64)
    good = shared >= threshold * (sizes[i] + sizes[j] - shared) - 1e-9
    return i[good], j[good]


def _verify(blocks: DataFrame, threshold: float) -> DataFrame:
    """(c, root, links) from rows (g, t, i, j, c, side, copies, h1, sig, _text) sorted by block: each class with links, a class it is joined to, and the copies it is linked to."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        need = least_matches(threshold=threshold)
        held: list[tuple] = []
        last = None

        def done() -> Iterator[pa.RecordBatch]:
            if len(held) < 2:
                return
            c, side, copies = (np.array([r[k] for r in held], np.int64) for k in range(3))
            sig = np.frombuffer(b"".join(r[3] for r in held), np.uint32).reshape(-1, _VALUES)
            x, y = links([r[4] for r in held], sig, None if last[2] == last[3] else side, need, threshold, last[1])
            if not len(x):
                return
            n = np.bincount(x, copies[y], len(c)) + np.bincount(y, copies[x], len(c))
            root = np.arange(len(c))
            while True:
                low = root.copy()
                np.minimum.at(low, x, root[y])
                np.minimum.at(low, y, root[x])
                low = low[low]
                if (low == root).all():
                    break
                root = low
            own = n > 0
            yield pa.RecordBatch.from_arrays([pa.array(c[own]), pa.array(c[root[own]]), pa.array(n[own].astype(np.int64))], ["c", "root", "links"])

        for b in cut(batches, "_text"):
            sets = shingle_sets(b.column("_text"))
            mine = (set_hashes(sets)[0] == b.column("h1").to_numpy()).tolist()
            keys = list(zip(*(b.column(k).to_pylist() for k in ("g", "t", "i", "j"))))
            rows = zip(*(b.column(k).to_pylist() for k in ("c", "side", "copies", "sig")), sets)
            for key, row, right in zip(keys, rows, mine):
                if key != last:
                    yield from done()
                    held, last = [], key
                if right and not (held and held[-1][0] == row[0]):  # not a repeated row
                    held.append(row)
        yield from done()

    return blocks.select("g", "t", "i", "j", "c", "side", "copies", "h1", "sig", "_text").mapInArrow(work, "c long, root long, links long")


def _entries(bands: DataFrame, shared: DataFrame, group: DataFrame, block: int) -> DataFrame:
    """(c, g, t, parts): the groups in which class c meets others, at most one for each band. t is -1 for a whole component g, or else the band of bucket g."""
    blocks = lambda n: F.ceil(F.col(n) / F.lit(block))
    sizes = group.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    large = sizes.filter(F.col("n") > block)
    buckets = shared.join(group.join(large.select("g"), "g").select(F.col("c").alias("m"), "g"), "m")
    apart = buckets.groupBy("g").agg(F.sum(F.col("n") * blocks("n")).alias("sent")).join(large, "g").filter(F.col("sent") < F.col("n") * blocks("n")).select("g")
    apart = written(apart, "apart")
    whole = group.join(sizes.join(apart, "g", "left_anti"), "g").select("c", "g", F.lit(-1).alias("t"), blocks("n").cast("int").alias("parts"))
    own = buckets.join(apart, "g", "left_semi").select("t", "k", blocks("n").cast("int").alias("parts"))
    return whole.unionAll(bands.join(own, ["t", "k"]).select("c", F.col("k").alias("g"), "t", "parts"))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """One row per input row: (doc_id, class_id, n_links, set_id).

    ``set_id`` is the least doc_id of the rows with the same shingles, ``class_id`` that
    of all rows connected by links (similarity >= threshold), ``n_links`` the number of other rows linked to this one, copies
    included. A null or empty text, or one without words, has no links and is
    a class of its own (class_id = set_id = doc_id). Ids may be null (a class of such rows only has a null id). Repeated rows are copies
    of each other. Rows with one doc_id and different texts are different documents. An empty table gives an empty result. Only the id and the
    text are read, so other columns may have any names; texts of any length are compared whole. The threshold must not be below 0.8, for which the bands are set.
    """
    if threshold < THRESHOLD:
        raise ValueError("the bands are set for similarities of 0.8 or more")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    rows = rows.select("doc_id", F.xxhash64("doc_id", "_text").alias("rid"), "_text")
    made = written(features(rows), "features")
    classes = made.filter("n > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("set_id"), F.min("rid").alias("rid"), F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig"))
    classes = written(classes.withColumn("c", F.monotonically_increasing_id()), "classes")

    values = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda t: F.xxhash64(t, F.col("sig").substr(t * (4 * ROWS) + 1, F.lit(4 * ROWS))))
    bands = classes.select("c", F.posexplode(values).alias("t", "k"))
    shared = bands.groupBy("t", "k").agg(F.min("c").alias("m"), F.max("c").alias("x"), F.count(F.lit(1)).alias("n")).filter("m <> x").select("t", "k", "m", "n")
    shared = written(shared, "buckets")
    near = components(bands.join(shared, ["t", "k"]).filter("c <> m").select(F.col("c").alias("u"), F.col("m").alias("v")))
    group = near.select(F.col("v").alias("c"), F.col("root").alias("g"))
    group = written(group.unionAll(near.select(F.col("root").alias("c"), F.col("root").alias("g")).distinct()), "groups")

    entries = _entries(bands, shared, group, block)
    member = entries.groupBy("c").agg(F.collect_list(F.struct("g", "t", "parts")).alias("_e")).join(classes.select("c", "rid", "h1", "copies", "sig"), "c")
    member = member.join(rows.select("rid", "_text"), "rid").select("c", "h1", "copies", "sig", "_text", F.explode("_e").alias("_e")).select("*", "_e.*")
    member = member.withColumn("side", F.pmod(F.xxhash64("c"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    blocks = member.select("g", "t", "c", "side", "copies", "h1", "sig", "_text", other).withColumn("i", F.least("side", "other")).withColumn("j", F.greatest("side", "other"))
    found = written(_verify(blocks.repartition("g", "t", "i", "j").sortWithinPartitions("g", "t", "i", "j", "c"), threshold), "links")

    count = found.groupBy("c").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("c").alias("u"), F.col("root").alias("v"))).select(F.col("v").alias("c"), "root")
    classes = classes.select("c", "h1", "h2", "set_id", "copies").join(joined, "c", "left").join(count, "c", "left").withColumn("root", F.coalesce("root", "c"))
    classes = written(classes, "classes")
    named = classes.groupBy("root").agg(F.min("set_id").alias("class_id"))
    classes = classes.join(named, "root").select("h1", "h2", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "set_id")
    out = made.select("doc_id", "n", "h1", "h2").join(classes, ["h1", "h2"], "left")
    alone = F.col("n") == 0
    return out.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(alone, F.col("doc_id")).otherwise(F.col("set_id")).alias("set_id"))
