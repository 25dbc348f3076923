"""Retention policies: which M frames of a stream to keep. Frames are (seq, ts, cell, …).

Random choices are least hashes, so that they are the same on any layout and mergeable. Water-filling a
budget over cells gives each cell a frame per round; that is the first M rows in the order of (rank in
the cell, cell), which needs no loop.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import hash60
from .geo import positions
from .score import episodes
from .sequential import follow


def _key(seed: int, *parts: str) -> Column:
    return hash60(F.concat_ws(":", F.lit(seed), *parts))


def fifo(frames: DataFrame, budget: int) -> DataFrame:
    return frames.orderBy(F.desc("seq")).limit(budget)


def global_reservoir(frames: DataFrame, budget: int, seed: int = 42) -> DataFrame:
    return frames.withColumn("_k", _key(seed, "seq")).orderBy("_k", "seq").limit(budget).drop("_k")


def reservoir_bytes(budget_bytes: int, payload_bytes: int) -> int:
    """The frames that fit a number of bytes."""
    return max(0, budget_bytes // payload_bytes)


def hybrid(frames: DataFrame, budget: int, seed: int = 42) -> DataFrame:
    """Half of the budget for the latest frames, the rest sampled from those before."""
    recent = fifo(frames, budget // 2)
    before = frames.join(recent.select("seq"), "seq", "left_anti").select(*frames.columns)
    return recent.unionAll(global_reservoir(before, budget - budget // 2, seed))


def uniform_time(frames: DataFrame, budget: int) -> DataFrame:
    """Evenly spaced frames, the first and last among them."""
    placed = positions(frames, "seq")
    n = placed.agg(F.count(F.lit(1)).alias("_n"))
    picks = n.select(F.explode(F.sequence(F.lit(0), F.lit(budget - 1))).alias("_m"), "_n")
    step = (F.col("_n") - 1) / max(budget - 1, 1)
    picks = picks.select(F.rint(F.col("_m") * step).cast("long").alias("_i")).distinct()
    return placed.join(F.broadcast(picks), "_i").drop("_i")


def cell_balanced(frames: DataFrame, budget: int, seed: int = 42) -> DataFrame:
    """The budget water-filled over cells, a uniform sample in each."""
    rank = F.row_number().over(Window.partitionBy("cell").orderBy(_key(seed, "cell", "seq"), "seq"))
    rows = frames.withColumn("_r", rank).filter(F.col("_r") <= budget)
    return rows.orderBy("_r", _key(seed, "cell"), "cell").limit(budget).drop("_r")


def visit_balanced(frames: DataFrame, budget: int, gap_sec: float, seed: int = 42) -> DataFrame:
    """Water-filled over cells, and each cell's share over its visits."""
    rows = episodes(frames, gap_sec, ["cell"])
    inner = F.row_number().over(Window.partitionBy("cell", "episode").orderBy(_key(seed, "cell", "episode", "seq"), "seq"))
    rows = rows.withColumn("_e", inner).filter(F.col("_e") <= budget)
    rank = F.row_number().over(Window.partitionBy("cell").orderBy("_e", _key(seed, "cell", "episode"), "episode"))
    rows = rows.withColumn("_r", rank).filter(F.col("_r") <= budget)
    return rows.orderBy("_r", _key(seed, "cell"), "cell").limit(budget).drop("_r", "_e", "episode")


#: Rows that a pass of kcenter brings to the driver at most.
LEADERS = 1024


def kcenter(frames: DataFrame, budget: int, seed: int = 42, leaders: int = LEADERS) -> DataFrame:
    """Farthest-first by cosine over (seq, vec), unit vectors: adds pick (from 0).

    A frame's greatest similarity to the picks only grows. So a pass scans all frames once against the picks so far and brings the
    ``leaders`` of least similarity to the driver; picks are made among them as long as the best is no worse than the last
    of them was, as no other frame can be. A pass gives many picks, and nothing but picks and leaders is on the driver.
    """
    chosen = [(r["seq"], np.array(r["vec"], np.float64)) for r in frames.select("seq", "vec").orderBy(_key(seed, "seq"), "seq").limit(1).collect()]
    while chosen and len(chosen) < budget:
        centers = np.stack([v for _, v in chosen])

        @F.pandas_udf("double")
        def nearest(vec, centers=centers):  # noqa: ANN001, ANN202
            import pandas as pd

            return pd.Series((np.stack(vec.to_numpy()).astype(np.float64) @ centers.T).max(axis=1)) if len(vec) else pd.Series([], dtype=float)

        picks = frames.sparkSession.createDataFrame([(int(s),) for s, _ in chosen], "seq long")
        rest = frames.select("seq", "vec").join(F.broadcast(picks), "seq", "left_anti").withColumn("_s", F.round(nearest("vec"), 9))
        found = rest.orderBy("_s", "seq").limit(leaders).collect()
        if not found:
            break
        seqs, vectors = np.array([r["seq"] for r in found]), np.stack([np.array(r["vec"], np.float64) for r in found])
        near = np.array([r["_s"] for r in found])
        worst = (near[-1], seqs[-1]) if len(found) == leaders else (np.inf, 0)
        left = np.ones(len(found), bool)
        while left.any() and len(chosen) < budget:
            own = np.flatnonzero(left)
            best = own[np.lexsort((seqs[own], near[own]))[0]]
            if (near[best], seqs[best]) > worst:
                break
            left[best] = False
            chosen.append((int(seqs[best]), vectors[best]))
            near = np.maximum(near, np.round(vectors @ vectors[best], 9))
    picks = frames.sparkSession.createDataFrame([(int(s), i) for i, (s, _) in enumerate(chosen)], "seq long, pick int")
    return frames.join(F.broadcast(picks), "seq")


class BalancedBank:
    """At most ``size`` frames, shared out evenly over the cells met so far. Every choice goes by given ranks, so that equal streams give equal banks.

    Cells stand in a heap by (share, rank), the largest share and least rank on top; an entry counts only while the share is still right. A cell's
    frames stand in a heap by rank, the greatest on top, so that a cell of a constant share holds a uniform sample: those of least rank.
    """

    def __init__(self, size: int):
        self.size, self.total = size, 0
        self.held: dict[object, list[tuple[int, int]]] = {}
        self.rank: dict[object, int] = {}
        self.order: list[tuple[int, int, object]] = []

    def _resize(self, cell: object, by: int) -> None:
        self.total += by
        if self.held[cell]:
            heapq.heappush(self.order, (-len(self.held[cell]), self.rank[cell], cell))

    def _largest(self) -> object:
        while len(self.held[self.order[0][2]]) != -self.order[0][0]:
            heapq.heappop(self.order)
        return self.order[0][2]

    def _add(self, cell: object, frame: tuple[int, int]) -> None:
        heapq.heappush(self.held[cell], frame)
        self._resize(cell, 1)

    def _drop(self, cell: object) -> None:
        heapq.heappop(self.held[cell])
        self._resize(cell, -1)

    def offer(self, cell: object, cell_rank: int, frame_rank: int, number: int) -> None:
        own = self.held.setdefault(cell, [])
        self.rank[cell] = cell_rank
        frame = (-frame_rank, number)
        if self.total < self.size:
            self._add(cell, frame)
            return
        donor = self._largest() if self.size else None
        if donor is None:
            return
        share = len(self.held[donor])
        if len(own) < share:
            # a share of one is not split: between cells their ranks decide
            if share > 1 or cell_rank > self.rank[donor]:
                self._drop(donor)
                self._add(cell, frame)
        elif frame > own[0]:
            heapq.heapreplace(own, frame)


def spatial_priority(frames: DataFrame, budget: int, session: str = "session", seed: int = 42) -> DataFrame:
    """A causal bank of exactly min(budget, n) frames per session that balances the cells seen so far.

    When the bank is full, a frame of a cell with less than the largest share takes the place of a random frame
    of a cell with the largest; with more cells than slots, cells of greater rank stay.
    A frame of a cell with the largest share enters as in reservoir sampling. Ranks are hashes. A task follows each session, and keeps its bank and a batch.
    """
    own = list(frames.columns)
    ranked = frames.withColumn("_cell", _key(seed, "cell")).withColumn("_frame", _key(seed, "cell", "seq"))

    def work(parts: Iterator[tuple[bool, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        bank, rows, number = BalancedBank(budget), {}, 0

        def done() -> pd.DataFrame:
            return pd.DataFrame([rows[i] for i in sorted(i for held in bank.held.values() for _, i in held)], columns=own)

        for new, part in parts:
            if new:
                if rows:
                    yield done()
                bank, rows = BalancedBank(budget), {}
            for cell, cell_rank, frame_rank, row in zip(part["cell"].tolist(), part["_cell"].tolist(), part["_frame"].tolist(), part[own].itertuples(index=False, name=None)):
                bank.offer(cell, cell_rank, frame_rank, number)
                rows[number] = row
                number += 1
            kept = {i for held in bank.held.values() for _, i in held}
            rows = {i: r for i, r in rows.items() if i in kept}
        if rows:
            yield done()

    return follow(ranked, session, ["seq"], work, frames.schema)


def accounting(retained: DataFrame, frames: DataFrame, budget: int, payload_bytes: int, capacity: int, precision: int) -> DataFrame:
    """One row: retained frames, their share, cells per budget, payload and sketch bytes."""
    total = frames.agg(F.count(F.lit(1)).alias("frames"), F.count_distinct("cell").alias("cells"))
    kept = retained.agg(F.count(F.lit(1)).alias("retained"), F.count_distinct("cell").alias("kept_cells"))
    return total.crossJoin(F.broadcast(kept)).select(
        "retained", (F.col("retained") / F.col("frames")).alias("share"), "cells", "kept_cells", (F.col("cells") / budget).alias("cells_per_slot"),
        (F.col("retained") * payload_bytes).alias("payload_bytes"), (F.col("cells") * capacity * (1 << precision)).alias("sketch_bytes"),
    )
