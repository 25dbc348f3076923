"""Recurrences that have to follow a key's rows in order: they read sorted partitions batch by batch and carry a state, so that no key's rows are held at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def runs(batches: Iterator[pd.DataFrame], key: str) -> Iterator[tuple[bool, pd.DataFrame]]:
    """(whether a new key begins, rows): the stretches of one key in each batch."""
    last: object = object()
    for b in batches:
        if not len(b):
            continue
        code = pd.factorize(b[key], use_na_sentinel=False)[0]
        starts = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
        for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(b)]):
            value = b[key].iat[i]
            value = None if pd.isna(value) else value
            yield not (i == 0 and value == last), b.iloc[i:j]
            last = value


def follow(df: DataFrame, key: str, order: list[str], work: Callable[[Iterator[tuple[bool, pd.DataFrame]]], Iterator[pd.DataFrame]], schema: T.StructType | str) -> DataFrame:
    """Applies ``work`` to the runs() of partitions that hold whole keys, rows in order. A task follows each key; it keeps what ``work`` keeps."""
    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(lambda batches: work(runs(batches, key)), schema)


def recurrence(a: np.ndarray, b: np.ndarray, start: float) -> np.ndarray:
    """y with y[i] = a[i] y[i-1] + b[i] and y[-1] = start, by doubling: step k joins two spans of k rows."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    b[:1] += a[:1] * start
    a[:1] = 0.0
    step = 1
    while step < len(b):
        b[step:] = b[step:] + a[step:] * b[:-step]
        a[step:] = a[step:] * a[:-step]
        step *= 2
    return b
