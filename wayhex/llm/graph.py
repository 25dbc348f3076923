"""Connected components by alternating large-star and small-star steps, each written to the shared folder.

Edges are written as they come and read again in tasks of even size, which make stars of theirs, CHUNK at a time; what is left to the
steps are components that lie in many tasks. The least and the greatest neighbour of each vertex tell whether any is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import mark, release, written


SALTS = 8
#: A task makes stars of so many edges at once, about 100 MB with what that takes.
CHUNK = 1 << 20


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """edges (u, v) joined to least (u, m): a hub's edges are dealt out by salt, and as both sides come straight from a shuffle, adaptive execution splits what is still large, by the hub's size."""
    salted = edges.withColumn("_s", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    each = least.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(each.hint("merge"), ["u", "_s"]).drop("_s")  # never broadcast: it grows with the data


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (vertex, least vertex of its component) for all vertices of the edges (u, v) but the least; loops are ignored."""
    names, ends = np.unique(np.concatenate((u, v)), return_inverse=True)
    x, y = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(names))
    while len(x):
        low = root.copy()
        np.minimum.at(low, root[x], root[y])
        np.minimum.at(low, root[y], root[x])
        while (low[low] != low).any():
            low = low[low]
        root = low
        apart = root[x] != root[y]
        x, y = x[apart], y[apart]
    own = np.flatnonzero(root != np.arange(len(names)))
    return names[own], names[root[own]]


def _stars_in_tasks(edges: DataFrame) -> DataFrame:
    """Edges that connect the same vertices: stars of each CHUNK of a task's edges."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done() -> Iterator[pa.RecordBatch]:
            u, v = stars(*(np.concatenate([b.column(k).to_numpy() for b in held]) for k in range(2)))
            for at in range(0, len(u), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(u[at : at + (1 << 16)]), pa.array(v[at : at + (1 << 16)])], ["u", "v"])

        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= CHUNK:
                yield from done()
                held = []
        if held:
            yield from done()

    return edges.select("u", "v").mapInArrow(work, "u long, v long")


def _are_stars(edges: DataFrame) -> bool:
    """Whether every vertex of edges (u, v), u > v, has greater neighbours only or a single one."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    each = both.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("x"))
    return each.agg(F.count(F.when((F.col("m") < F.col("u")) & (F.col("m") < F.col("x")), 1))).first()[0] == 0


def _joined(edges: DataFrame) -> DataFrame:
    """Written edges that connect the same vertices as ``edges``, with stars in each task; repeated ones may stay."""
    before = mark()
    out = written(_stars_in_tasks(written(edges, "edges")), "edges")
    release(before, before + 1)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of ``edges`` (u, v: long) but roots; a root is its component's least vertex.

    Null ends, loops and repeated edges are ignored. A hub's edges meet only in a minimum, computed before they
    are shuffled, and in a join that can be split.
    """
    e = _joined(edges.select("u", "v").filter("u <> v"))
    while not _are_stars(e):
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _with_least(both.filter("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _with_least(large, low).select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("x")).select("x.u", F.col("x.m").alias("v")).filter("u <> v").distinct()
        before = mark()
        e = _joined(small)
        release(before - 1, before)  # the edges before
    return e.groupBy(F.col("u").alias("_v")).agg(F.min("v").alias("root")).select(F.col("_v").alias("v"), "root")
