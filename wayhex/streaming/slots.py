"""The slot and sketch semantics on Structured Streaming.

``event_windows`` gives each row its true slot and drops rows behind the watermark.
``arrival_slots`` keeps the batch semantics: a late row falls in the current slot, state
per stream is the anchor and the latest timestamp.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.sketch import register


def event_windows(stream: DataFrame, ts: str, cell: str, hash_col: str, window_sec: int, precision: int, late_sec: int | None = None, start_sec: int = 0, capacity: int = 1) -> DataFrame:
    """(cell, slot_start, j, rho, t_min, t_max): registers per cell and window, to be merged by maximum downstream; ts is a timestamp.

    The watermark is ``late_sec`` behind, or else as far as a ring of ``capacity`` windows reaches back: state is dropped when its window leaves the ring. ``start_sec`` shifts the windows to an anchor known beforehand.
    """
    j, rho = register(F.col(hash_col), precision)
    rows = stream.withWatermark(ts, f"{capacity * window_sec if late_sec is None else late_sec} seconds").select(F.col(ts).alias("_ts"), F.col(cell).alias("cell"), j.alias("j"), rho.alias("rho"))
    slot = F.window("_ts", f"{window_sec} seconds", startTime=f"{start_sec} seconds")
    out = rows.groupBy("cell", slot.alias("_w"), "j").agg(F.max("rho").alias("rho"), F.min("_ts").alias("t_min"), F.max("_ts").alias("t_max"))
    return out.select("cell", F.col("_w.start").alias("slot_start"), "j", "rho", "t_min", "t_max")


def arrival_slots(stream: DataFrame, key: str, window_sec: float) -> DataFrame:
    """(key, seq, ts, slot) of (key, seq, ts seconds): slots by the running maximum over micro-batches, rows of a batch in the order of seq."""
    kind = stream.schema[key].dataType.simpleString()

    def step(k: tuple, batches: Iterator, state: GroupState) -> Iterator:
        import numpy as np
        import pandas as pd

        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        anchor, latest = state.get if state.exists else (None, float("-inf"))
        if anchor is None:
            good = rows.loc[rows["ts"] >= 0, "ts"]
            anchor = float(good.iloc[0]) if len(good) else None
        top = np.maximum(np.maximum.accumulate(rows["ts"].to_numpy()), latest)
        slot = np.zeros(len(rows)) if anchor is None else np.maximum(np.floor((top - anchor) / window_sec), 0)
        state.update((anchor, float(top[-1])))
        yield pd.DataFrame({key: k[0], "seq": rows["seq"].to_numpy(), "ts": rows["ts"].to_numpy(), "slot": slot.astype("int64")})

    return stream.select(key, "seq", "ts").groupBy(key).applyInPandasWithState(step, f"{key} {kind}, seq long, ts double, slot long", "anchor double, latest double", "append", GroupStateTimeout.NoTimeout)


def as_of_replay(df: DataFrame, ts: str, clock: float) -> DataFrame:
    """What a stream had brought by a clock: seeking backwards is a rebuild from this."""
    return df.filter(F.col(ts) <= clock)
