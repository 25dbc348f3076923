"""Vector similarity in Arrow batches: matrix products instead of a function call for each number."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Queries that are multiplied with a batch at once.
WIDTH = 256


def _stack(column) -> dict[int, tuple[np.ndarray, np.ndarray]]:  # noqa: ANN001
    """By length: the rows of that length (nulls left out) and their vectors as a matrix."""
    sizes = np.array([-1 if v is None else len(v) for v in column])
    return {int(n): (rows := np.flatnonzero(sizes == n), np.stack([column.iat[i] for i in rows]).astype(np.float64)) for n in np.unique(sizes) if n > 0}


def _unit(m: np.ndarray) -> np.ndarray:
    """Rows of length one; those of a zero vector are NaN."""
    n = np.sqrt((m * m).sum(axis=1))
    with np.errstate(invalid="ignore", divide="ignore"):
        return m / np.where(n > 0, n, np.nan)[:, None]


def cosines(vec: Column, queries: list) -> Column:
    """array<double>: the cosine of each vector with every query (a block of bounded size, sent with the function); null where sizes differ or a norm is zero."""
    sizes = {len(q) for q in queries if q is not None}
    blocks = {n: ([i for i, q in enumerate(queries) if q is not None and len(q) == n], _unit(np.array([q for q in queries if q is not None and len(q) == n], np.float64))) for n in sizes if n}
    total = len(queries)

    @F.pandas_udf("array<double>")
    def run(v):  # noqa: ANN001, ANN202
        import pandas as pd

        out = np.full((len(v), total), np.nan)
        for n, (rows, m) in _stack(v).items():
            if n in blocks:
                at, q = blocks[n]
                out[np.ix_(rows, at)] = _unit(m) @ q.T
        return pd.Series(list(out), index=v.index)

    return F.transform(run(vec), lambda x: F.when(~F.isnan(x), x))


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two vector columns; null where sizes differ or a norm is zero."""

    @F.pandas_udf("double")
    def run(x, y):  # noqa: ANN001, ANN202
        import pandas as pd

        out = np.full(len(x), np.nan)
        fits = np.array([p is not None and q is not None and len(p) == len(q) for p, q in zip(x, y)], bool)
        for n, (rows, m) in _stack(x[fits].reset_index(drop=True)).items():
            own = np.stack([y[fits].iat[i] for i in rows]).astype(np.float64)
            out[np.flatnonzero(fits)[rows]] = (_unit(m) * _unit(own)).sum(axis=1)
        return pd.Series(out, index=x.index)

    found = run(a, b)
    return F.when(~F.isnan(found), found)


def matrices(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """By length: the rows of a list column (nulls and empty ones left out) and their vectors as a matrix."""
    sizes = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)
    for n in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == n)
        yield rows, col.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), n).astype(np.float64)


def best_rows(sim: np.ndarray, order: np.ndarray, top: int, group: np.ndarray | None = None, cap: int = 1) -> np.ndarray:
    """The rows that can be among the best ``top`` of a larger set when a group gives at most ``cap`` (greatest sim, then least order); NaN never is.

    Without groups: the ``top`` rows by (sim descending, order). With groups, rows that tie with the last of them stay too.
    """
    there = np.flatnonzero(~np.isnan(sim))
    most = 8 * top * (cap if group is not None else 1)
    while True:
        if len(there) > most:
            own = sim[there]
            pick = there[own >= np.partition(own, len(own) - most)[len(own) - most]]
        else:
            pick = there
        pick = pick[np.lexsort((order[pick], -sim[pick]))]
        if group is None:
            return pick[:top]
        g = group[pick]
        by = np.argsort(g, kind="stable")
        first = np.concatenate(([True], g[by][1:] != g[by][:-1])) if len(by) else np.zeros(0, bool)
        place = np.arange(len(by)) - np.maximum.accumulate(np.where(first, np.arange(len(by)), 0))
        number = np.empty(len(by), np.int64)
        number[by] = place
        kept = pick[number < cap]
        if len(kept) >= top or len(pick) == len(there):
            return kept if len(kept) <= top else kept[sim[kept] >= sim[kept[top - 1]]]
        most *= 4


def search(df: DataFrame, vec: str, ids: list, queries: list, id_type: T.DataType, top: int, order: str, group: str | None = None, cap: int = 1, vectors=matrices) -> DataFrame:  # noqa: ANN001
    """The rows of ``df`` that can be among a query's best, without ``vec``, with qid and sim (9 digits): each batch is multiplied with all queries and keeps best_rows().

    So few rows for each batch and query leave a task, however large ``df`` is. Vectors of another length, or of no length, are skipped.
    ``vectors`` yields (rows, matrix) of the column, where it isn't a plain list.
    """
    keep = [c for c in df.columns if c != vec]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("qid", id_type), T.StructField("sim", T.DoubleType())])
    wide: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for n in {len(q) for q in queries if q is not None and len(q)}:
        at = [i for i, q in enumerate(queries) if q is not None and len(q) == n]
        wide[n] = np.array(at), _unit(np.array([queries[i] for i in at], np.float64))
    names, arrow_id = [*keep, "qid", "sim"], pa.array(ids[:1]).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by = b.column(order).to_numpy(zero_copy_only=False)
            groups = b.column(group).to_numpy(zero_copy_only=False) if group else None
            for rows, m in vectors(b.column(vec)):
                if m.shape[1] not in wide:
                    continue
                at, q = wide[m.shape[1]]
                unit = _unit(m)
                for lo in range(0, len(at), WIDTH):
                    sims = np.round(unit @ q[lo : lo + WIDTH].T, 9)
                    kept = [best_rows(sims[:, k], by[rows], top, None if groups is None else groups[rows], cap) for k in range(sims.shape[1])]
                    which = np.repeat(np.arange(len(kept)), [len(k) for k in kept])
                    flat = np.concatenate(kept)
                    part = b.select(keep).take(pa.array(rows[flat]))
                    qid = pa.array([ids[i] for i in at[lo + which]], arrow_id)
                    yield pa.RecordBatch.from_arrays([*part.columns, qid, pa.array(sims[flat, which])], names)

    return df.mapInArrow(run, schema)
