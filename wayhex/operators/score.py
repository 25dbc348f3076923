"""Scoring of retrieved places against ground-truth intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import interval_iou

IOU = 0.3
TOLERANCE_SEC = 1.5


def score_predictions(preds: DataFrame, truth: DataFrame, tolerance: float = TOLERANCE_SEC) -> DataFrame:
    """preds (qid, rank, cell, exemplar_t, t_min, t_max, …) with bucket_iou, exemplar_iou and exemplar_hit.

    truth is (qid, start, end), or (qid, intervals array<struct<start, end>>). Both are the best over the question's intervals: of [t_min, t_max] and
    of exemplar_t -/+ tolerance; the hit says whether exemplar_t lies in one. Without intervals: 0, 0, false. Predictions are
    unique by (qid, rank). A question's intervals are rows that meet its few predictions and are reduced at once, never a list.
    """
    rows = truth.select("qid", F.explode("intervals").alias("i")).select("qid", "i.start", "i.end") if "intervals" in truth.columns else truth
    out = preds.join(rows.select("qid", F.col("start").alias("_s"), F.col("end").alias("_e")), "qid", "left")
    a, b = F.coalesce("t_min", "exemplar_t"), F.coalesce("t_max", "exemplar_t")
    best = lambda lo, hi: F.max(interval_iou(lo, hi, F.col("_s"), F.col("_e")))
    hit = F.coalesce(F.bool_or(F.col("exemplar_t").between(F.col("_s"), F.col("_e"))), F.lit(False))
    return out.groupBy(*preds.columns).agg(best(a, b).alias("bucket_iou"), best(F.col("exemplar_t") - tolerance, F.col("exemplar_t") + tolerance).alias("exemplar_iou"), hit.alias("exemplar_hit"))


def best_iou(spans: DataFrame, truth: DataFrame, bin_sec: float) -> DataFrame:
    """spans (qid, x, y) with iou, the best with any of truth (qid, start, end); 0 without overlap. Only intervals that meet in a bin of time are compared."""
    bins = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / bin_sec).cast("long"), F.floor(F.col(hi) / bin_sec).cast("long"))).alias("_bin")
    left = spans.filter("x <= y").select("qid", "x", "y", bins("x", "y")).distinct()
    right = truth.filter("start <= end").select("qid", "start", "end", bins("start", "end"))
    found = left.join(right, ["qid", "_bin"]).groupBy("qid", "x", "y").agg(F.max(interval_iou(F.col("x"), F.col("y"), F.col("start"), F.col("end"))).alias("iou"))
    return spans.join(found, ["qid", "x", "y"], "left").withColumn("iou", F.coalesce("iou", F.lit(0.0)))


def gather_truth(intervals: DataFrame) -> DataFrame:
    """(qid, intervals) from (qid, start, end)."""
    return intervals.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("intervals"))


def summarize_questions(scored: DataFrame, questions: DataFrame, iou: float = IOU) -> DataFrame:
    """Per question: top-1 and best IoUs, hits. Questions without predictions score 0."""
    per = scored.groupBy("qid").agg(
        F.max(F.when(F.col("rank") == 1, F.col("bucket_iou"))).alias("top1_iou"),
        F.max("bucket_iou").alias("max_iou"),
        F.max("exemplar_iou").alias("max_exemplar_iou"),
        F.bool_or("exemplar_hit").alias("hit"),
        F.count_distinct("cell").alias("cells"),
    )
    out = questions.join(per, "qid", "left")
    zero = {c: F.coalesce(c, F.lit(0.0)).alias(c) for c in ("top1_iou", "max_iou", "max_exemplar_iou")}
    return out.select(*questions.columns, *zero.values(), F.coalesce("hit", F.lit(False)).alias("hit"), F.coalesce("cells", F.lit(0)).alias("cells"), (F.coalesce("max_iou", F.lit(0.0)) >= iou).alias("bucket_hit"))


def by_category(summary: DataFrame, keys: list[str]) -> DataFrame:
    """Mean IoUs and hit rates."""
    rate = lambda c: F.avg(F.col(c).cast("double"))
    return summary.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("top1_iou").alias("mean_top1_iou"), F.avg("max_iou").alias("mean_max_iou"), rate("hit").alias("hit_rate"), rate("bucket_hit").alias("bucket_hit_rate"))


def count_metrics(summary: DataFrame, expected: str) -> DataFrame:
    """Distinct cells found against an expected count: exact matches and mean absolute error."""
    d = F.abs(F.col("cells") - F.col(expected))
    return summary.agg(F.count(F.lit(1)).alias("n"), F.avg((d == 0).cast("double")).alias("exact_rate"), F.avg(d).alias("mae"))


def episodes(df: DataFrame, gap_sec: float, keys: list[str], ts: str = "ts", order: str = "seq") -> DataFrame:
    """Adds episode (from 0): a new one where the step within keys exceeds gap_sec."""
    w = Window.partitionBy(*keys).orderBy(ts, order)
    new = F.coalesce((F.col(ts) - F.lag(ts).over(w) > gap_sec).cast("int"), F.lit(0))
    return df.withColumn("_new", new).withColumn("episode", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def merge_intervals(intervals: DataFrame) -> DataFrame:
    """(qid, start, end): the union of each question's intervals, as intervals that don't meet."""
    before = Window.partitionBy("qid").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("qid").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    new = F.coalesce((F.col("start") > F.max("end").over(before)).cast("int"), F.lit(1))
    rows = intervals.filter("start <= end").select("qid", "start", "end").withColumn("_new", new).withColumn("_i", F.sum("_new").over(upto))
    return rows.groupBy("qid", "_i").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_i")


def _votes(frames: DataFrame, intervals: DataFrame) -> DataFrame:
    """(qid, cell, n, first): the frames (seq, ts, cell) of each cell in a question's intervals, which don't meet, and their least seq.

    Nothing pairs frames with intervals: a task gets some cells' frames, in order of time, and all intervals, batch by batch; ranks of an
    interval's ends give the count, minima over powers of two of rows the least seq.
    """
    blocks = 4 * frames.sparkSession.sparkContext.defaultParallelism
    none = F.lit(None)
    left = frames.filter("ts is not null").select(F.pmod(F.xxhash64("cell"), F.lit(blocks)).cast("int").alias("_b"), F.lit(0).alias("kind"), F.col("seq").cast("long").alias("i"), F.col("cell").cast("long").alias("cell"), F.col("ts").cast("double").alias("a"), none.cast("double").alias("b"))
    right = intervals.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_b"), F.lit(1).alias("kind"), F.col("qid").cast("long").alias("i"), none.cast("long").alias("cell"), F.col("start").cast("double").alias("a"), F.col("end").cast("double").alias("b"))
    rows = left.unionAll(right).repartition(blocks, "_b").sortWithinPartitions("_b", "kind", "cell", "i", "a")
    names = ["qid", "cell", "n", "first"]

    def tables(kept: list) -> list[tuple]:
        """Of each cell: its times in order, and the least seq of 1, 2, 4… rows from each on."""
        cell, seq, ts, null = (np.concatenate(x) for x in zip(*kept))
        out = []
        by = np.lexsort((ts, cell, null))
        cell, seq, ts, null = cell[by], seq[by], ts[by], null[by]
        cuts = np.flatnonzero(np.concatenate(([True], (cell[1:] != cell[:-1]) | (null[1:] != null[:-1]))))
        for i, j in zip(cuts, [*cuts[1:], len(cell)]):
            least = [seq[i:j]]
            while 2 << (len(least) - 1) <= j - i:
                step = 1 << (len(least) - 1)
                least.append(np.minimum(least[-1][:-step], least[-1][step:]))
            out.append((None if null[i] else int(cell[i]), ts[i:j], least))
        return out

    def counted(cells: list[tuple], qid: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[pa.RecordBatch]:
        cuts = np.flatnonzero(np.concatenate(([True], qid[1:] != qid[:-1])))
        for cell, ts, least in cells:
            lo, hi = np.searchsorted(ts, start, "left"), np.searchsorted(ts, end, "right")
            size = hi - lo
            n = np.add.reduceat(size, cuts)
            low = np.full(len(size), np.iinfo(np.int64).max)
            level = np.frexp(np.maximum(size, 1))[1] - 1
            for k, row in enumerate(least):
                at = np.flatnonzero((level == k) & (size > 0))
                low[at] = np.minimum(row[lo[at]], row[hi[at] - (1 << k)])
            found = n > 0
            if found.any():
                yield pa.RecordBatch.from_arrays([pa.array(qid[cuts][found]), pa.array([cell] * int(found.sum()), pa.int64()), pa.array(n[found].astype(np.int64)), pa.array(np.minimum.reduceat(low, cuts)[found])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, kept, cells = None, [], None
        for b in batches:
            at, kind = b.column(0).to_numpy(), b.column(1).to_numpy()
            cuts = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (kind[1:] != kind[:-1])))) if len(at) else []
            for i, j in zip(cuts, [*cuts[1:], len(at)]):
                if at[i] != block:
                    block, kept, cells = at[i], [], None
                part = b.slice(i, j - i)
                if kind[i] == 0:
                    kept.append((pc.fill_null(part.column(3), 0).to_numpy(), part.column(2).to_numpy(), part.column(4).to_numpy(), pc.is_null(part.column(3)).to_numpy(zero_copy_only=False)))
                elif kept:
                    cells = tables(kept) if cells is None else cells
                    yield from counted(cells, *(part.column(k).to_numpy() for k in (2, 4, 5)))

    # a question whose intervals lie in two batches gives two rows
    out = rows.mapInArrow(run, "qid long, cell long, n long, first long")
    return out.groupBy("qid", "cell").agg(F.sum("n").alias("n"), F.min("first").alias("first"))


def question_strata(truth: DataFrame, frames: DataFrame, gap_sec: float, bin_sec: float) -> DataFrame:
    """Per question of truth (qid, start, end) over frames (seq, ts, cell): target cell, support, exposure, visits, age and strata.

    The target cell is the most frequent one in the intervals (first seen wins a tie), or without any frame there the
    one of the frame nearest to the intervals' mean midpoint. Ids and cells are longs. ``bin_sec`` is no longer used: no frame meets an interval.
    """
    from .align import nearest

    session_end = frames.agg(F.max("ts").alias("session_end"), F.count(F.lit(1)).alias("frames"))
    votes = _votes(frames, merge_intervals(truth))
    modal = votes.groupBy("qid").agg(F.max_by("cell", F.struct("n", -F.col("first"))).alias("modal"), F.sum("n").alias("support"))
    spans = truth.groupBy("qid").agg(F.avg((F.col("start") + F.col("end")) / 2).alias("ts"), F.max("end").alias("last_end"), F.min("start").alias("first_start"))
    near = nearest(spans, frames.select("ts", "cell"), "ts", ["cell"])
    visits = episodes(frames.select("seq", "ts", "cell"), gap_sec, ["cell"]).groupBy("cell").agg(F.count(F.lit(1)).alias("size"), (F.max("episode") + 1).alias("visits"))
    out = near.join(modal, "qid", "left").withColumn("target_cell", F.coalesce("modal", "cell")).drop("cell", "modal")
    out = out.join(visits, out["target_cell"] == visits["cell"], "left").drop("cell").crossJoin(F.broadcast(session_end))
    out = out.withColumn("exposure", F.col("size") / F.col("frames")).withColumn("normalized_age", (F.col("session_end") - F.col("ts")) / F.col("session_end"))
    marks = out.agg(F.percentile("exposure", 0.25).alias("q25"), F.percentile("exposure", 0.75).alias("q75"))
    out = out.crossJoin(F.broadcast(marks))
    flag = lambda c: F.coalesce(c, F.lit(False))
    return out.select(
        "qid", "target_cell", F.coalesce("support", F.lit(0)).alias("support"), "exposure", "visits", "normalized_age",
        flag(F.col("last_end") <= 0.5 * F.col("session_end")).alias("old_event"), flag(F.col("first_start") >= 0.75 * F.col("session_end")).alias("recent_event"),
        flag(F.col("exposure") <= F.col("q25")).alias("rare_place"), flag(F.col("exposure") >= F.col("q75")).alias("common_place"), flag(F.col("visits") >= 2).alias("revisited_place"),
    )


def oracle_hits(retained: DataFrame, truth: DataFrame, bin_sec: float) -> DataFrame:
    """(qid, oracle_hit): whether any retained instant lies in any of the question's intervals."""
    from .align import within

    found = within(retained.select("ts"), merge_intervals(truth), "ts", bin_sec).select("qid").distinct().withColumn("oracle_hit", F.lit(True))
    return truth.select("qid").distinct().join(found, "qid", "left").select("qid", F.coalesce("oracle_hit", F.lit(False)).alias("oracle_hit"))
