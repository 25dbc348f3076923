"""The state of a cell on Structured Streaming: a ring of sketch registers by slot, and a sample of its rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.scalars import hash60
from ..operators.sketch import register

STATE = "seen long, last_slot long, slots array<long>, js array<int>, rhos array<int>, ranks array<long>, seqs array<long>"


def tile_states(stream: DataFrame, window_sec: float, capacity: int, precision: int, exemplars: int, seed: int) -> DataFrame:
    """(cell, seen, last_slot, n_distinct, held) after each micro-batch that touches a cell, of rows (cell, seq, ts seconds, item).

    The ring holds the registers of the last ``capacity`` slots up to the cell's latest, epoch-aligned; a row behind it
    counts as seen, but is in no register. The sample is the ``exemplars`` rows of least hash over the whole stream. So the state of a cell is
    bounded: capacity * 2**precision registers and the sample.
    """
    j, rho = register(hash60(F.col("item")), precision)
    rank = hash60(F.concat_ws(":", F.lit(seed), "cell", "seq"))
    rows = stream.select("cell", "seq", F.floor(F.col("ts") / window_sec).cast("long").alias("slot"), j.alias("j"), rho.alias("rho"), rank.alias("rank"))
    m = 1 << precision
    raw = 0.7213 / (1 + 1.079 / m) * m * m

    def merge(parts: pd.DataFrame) -> pd.DataFrame:
        return parts.groupby(["slot", "j"], as_index=False)["rho"].max()

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, last, slots, js, rhos, ranks, seqs = state.get if state.exists else (0, None, [], [], [], [], [])
        ring = pd.DataFrame({"slot": np.array(slots, np.int64), "j": np.array(js, np.int32), "rho": np.array(rhos, np.int32)})
        held = list(zip(ranks, seqs))
        for b in batches:
            seen += len(b)
            last = int(b["slot"].max()) if last is None else max(last, int(b["slot"].max()))
            ring = merge(pd.concat([ring, b[["slot", "j", "rho"]]]))
            ring = ring[ring["slot"] > last - capacity]
            held = sorted({*held, *zip(b["rank"].tolist(), b["seq"].tolist())})[:exemplars]
        state.update((seen, last, ring["slot"].tolist(), ring["j"].tolist(), ring["rho"].tolist(), [r for r, _ in held], [s for _, s in held]))
        top = ring.groupby("j")["rho"].max().to_numpy()
        estimate = raw / (np.power(2.0, -top.astype(np.float64)).sum() + (m - len(top)))
        if estimate <= 2.5 * m and len(top) < m:
            estimate = m * np.log(m / (m - len(top)))
        yield pd.DataFrame({"cell": [k[0]], "seen": [seen], "last_slot": [last], "n_distinct": [float(estimate)], "held": [sorted(s for _, s in held)]})

    return rows.groupBy("cell").applyInPandasWithState(step, "cell long, seen long, last_slot long, n_distinct double, held array<long>", STATE, "update", GroupStateTimeout.NoTimeout)
