"""The spatial memory as relations: observed rows, slot registers, slot intervals and exemplars, and the queries over them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import MemoryConfig
from ..functions import cells
from ..functions.scalars import hash60
from ..functions.vectors import cosine, cosines, search
from . import sketch
from .slots import assign_slots, last_slot


@dataclass(frozen=True)
class Memory:
    """Relations of one memory. ``last`` has one row: the last slot, of invalid rows too."""

    cfg: MemoryConfig
    grid: cells.HexGrid
    valid: DataFrame
    rejects: DataFrame
    last: DataFrame

    def live(self, n: int | None = None) -> DataFrame:
        """The valid rows in the current slot and n prior ones (all live slots by default)."""
        n = self.cfg.capacity - 1 if n is None else min(max(n, 0), self.cfg.capacity - 1)
        return self.valid.crossJoin(F.broadcast(self.last)).filter(F.col("slot") >= F.col("last_slot") - n).drop("last_slot")


def observe(df: DataFrame, cfg: MemoryConfig, grid: cells.HexGrid) -> Memory:
    """From (seq, ts, lat, lng, item, ...): every row moves the clock, invalid coordinates and empty items are rejected."""
    rows = assign_slots(df, cfg.window_sec).withColumn("cell", grid.encode(F.col("lat"), F.col("lng"), cfg.resolution))
    good = F.col("cell").isNotNull() & (F.coalesce(F.length("item"), F.lit(0)) > 0)
    return Memory(cfg, grid, rows.filter(good), rows.filter(~good), last_slot(df, cfg.window_sec))


def window_aggregate(mem: Memory, n: int | None = None) -> DataFrame:
    """(cell, t_min, t_max, count) over a window: HLL estimate of distinct items and observed interval. Cells without rows are absent."""
    live = mem.live(n).select("cell", "ts", hash60(F.col("item")).alias("_h"))
    j, rho = sketch.register(F.col("_h"), mem.cfg.precision)
    # one pass: registers carry the interval of their rows
    regs = live.select("cell", "ts", j.alias("j"), rho.alias("rho")).groupBy("cell", "j").agg(F.max("rho").alias("rho"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    out = regs.groupBy("cell").agg(F.min("a").alias("t_min"), F.max("b").alias("t_max"), F.count(F.lit(1)).alias("_k"), F.sum(F.pow(F.lit(2.0), -F.col("rho"))).alias("_p"))
    return out.select("cell", "t_min", "t_max", sketch.estimate_of(F.col("_k"), F.col("_p"), mem.cfg.precision).alias("count"))


def tiles(mem: Memory) -> DataFrame:
    """(cell, seen): every cell ever observed, aged out or not."""
    return mem.valid.groupBy("cell").agg(F.count(F.lit(1)).alias("seen"))


def tile_summary(mem: Memory) -> DataFrame:
    """(cell, seen, current, total, t_min, t_max): distinct items now and over all live slots; zeros for a cell that has aged out."""
    p = mem.cfg.precision
    rows = mem.valid.crossJoin(F.broadcast(mem.last)).select("cell", "ts", hash60(F.col("item")).alias("_h"), (F.col("last_slot") - F.col("slot")).alias("_age"))
    j, rho = sketch.register(F.col("_h"), p)
    live, now = F.col("_age") < mem.cfg.capacity, F.col("_age") <= 0
    # one pass: a register of a cell holds its greatest rank now and over all live slots, the interval and the rows ever seen
    regs = rows.select("cell", "ts", "_age", j.alias("j"), rho.alias("rho")).groupBy("cell", "j").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.when(live, F.col("rho"))).alias("all"), F.max(F.when(now, F.col("rho"))).alias("now"), F.min(F.when(live, F.col("ts"))).alias("a"), F.max(F.when(live, F.col("ts"))).alias("b")
    )
    powers = lambda c: F.coalesce(F.sum(F.pow(F.lit(2.0), -F.col(c))), F.lit(0.0))
    out = regs.groupBy("cell").agg(F.sum("n").alias("seen"), F.count("all").alias("_k"), powers("all").alias("_p"), F.count("now").alias("_c"), powers("now").alias("_q"), F.min("a").alias("t_min"), F.max("b").alias("t_max"))
    return out.select("cell", "seen", sketch.estimate_of(F.col("_c"), F.col("_q"), p).alias("current"), sketch.estimate_of(F.col("_k"), F.col("_p"), p).alias("total"), "t_min", "t_max")


def window_count(mem: Memory, points: DataFrame, n: int) -> DataFrame:
    """points (point_id, lat, lng) with count over n prior slots: 0 in an unknown cell, null for an invalid point."""
    at = points.withColumn("cell", mem.grid.encode(F.col("lat"), F.col("lng"), mem.cfg.resolution))
    out = at.join(window_aggregate(mem, n).select("cell", "count"), "cell", "left")
    return out.withColumn("count", F.when(F.col("cell").isNotNull(), F.coalesce("count", F.lit(0.0))))


def last_seen(mem: Memory, points: DataFrame, k: int, top: int) -> DataFrame:
    """For each point the ``top`` cells within k steps seen last: (point_id, rank, cell, t_min, t_max, count, total_found)."""
    at = points.withColumn("_c", mem.grid.encode(F.col("lat"), F.col("lng"), mem.cfg.resolution)).filter("_c is not null").select("point_id", "_c")
    # points of one cell see the same cells, so a cell is looked up once; the disks are more rows than Spark takes them for, and are never broadcast
    near = cells.disk(at.select("_c").distinct(), "_c", k, "cell")
    best = [F.desc("t_max"), F.desc("count"), F.asc("cell")]
    own = Window.partitionBy("_c")
    found = window_aggregate(mem).hint("merge").join(near.hint("merge"), "cell").withColumn("_k", F.row_number().over(own.orderBy(*best))).withColumn("_n", F.count(F.lit(1)).over(own))
    found = at.join(found.filter(F.col("_k") <= top).hint("merge"), "_c")
    by = Window.partitionBy("point_id")
    ranked = found.withColumn("rank", F.row_number().over(by.orderBy(*best))).withColumn("total_found", F.sum(F.when(F.col("_k") == 1, F.col("_n")).otherwise(0)).over(by))
    return ranked.filter(F.col("rank") <= top).select("point_id", "rank", "cell", "t_min", "t_max", "count", "total_found")


def exemplars(mem: Memory, size: int | None = None) -> DataFrame:
    """A uniform sample of at most ``size`` rows of each cell over the whole stream, by least hash: (cell, seq, ts, pick)."""
    size = mem.cfg.exemplars if size is None else size
    keyed = mem.valid.withColumn("_key", hash60(F.concat_ws(":", F.lit(mem.cfg.seed), "cell", "seq")))
    pick = F.row_number().over(Window.partitionBy("cell").orderBy("_key", "seq"))
    return keyed.withColumn("pick", pick).filter(F.col("pick") <= size).drop("_key")


#: A stated query set goes out with the functions that scan the bank, in blocks of at most so many bytes; a set up to this size is one scan.
BLOCK_BYTES = 32 << 20


def query_blocks(queries: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[list, list]]:
    """(ids, vectors) of (qid, qvec), a block at a time."""
    ids, vectors, size = [], [], 0
    for r in queries.select("qid", "qvec").toLocalIterator():
        ids.append(r["qid"])
        vectors.append(r["qvec"])
        size += 8 * len(r["qvec"] or ()) + 16
        if size >= block_bytes:
            yield ids, vectors
            ids, vectors, size = [], [], 0
    if ids:
        yield ids, vectors


def _over_blocks(bank: DataFrame, queries: DataFrame, scan: Callable[[list, list], DataFrame], block_bytes: int) -> DataFrame:
    parts = [scan(ids, vectors) for ids, vectors in query_blocks(queries, block_bytes)]
    if not parts:
        return bank.drop("vec").limit(0).withColumn("qid", F.lit(None).cast(queries.schema["qid"].dataType)).withColumn("sim", F.lit(None).cast("double"))
    return reduce(DataFrame.unionAll, parts)


def score(bank: DataFrame, queries: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every exemplar (…, vec) against every query (qid, qvec): the bank's columns without vec, and qid, sim. Vectors that don't fit are skipped.

    Matrix products over the bank; no join pairs rows. Where only the best are wanted, best_hits() lets no more leave the scan.
    """

    def scan(ids: list, vectors: list) -> DataFrame:
        sims = F.posexplode(cosines(F.col("vec"), vectors)).alias("_q", "sim")
        keep = [c for c in bank.columns if c != "vec"]
        return bank.select(*keep, sims).filter("sim is not null").select(*keep, F.get(F.lit(ids), F.col("_q")).cast(queries.schema["qid"].dataType).alias("qid"), F.round("sim", 9).alias("sim"))

    return _over_blocks(bank, queries, scan, block_bytes)


def best_hits(bank: DataFrame, queries: DataFrame, top: int, order: str = "seq", group: str | None = None, cap: int = 1, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """As score(), but only rows that can be among a query's best ``top``, with at most ``cap`` of a group: chosen in each batch, before anything is shuffled."""
    return _over_blocks(bank, queries, lambda ids, vectors: search(bank, "vec", ids, vectors, queries.schema["qid"].dataType, top, order, group, max(1, min(cap, top))), block_bytes)


def rank_hits(scored: DataFrame, top: int, cap: int = 1, time: str = "ts") -> DataFrame:
    """Per query: at most ``cap`` hits of a cell (earlier rows win ties), then the best ``top``: adds rank."""
    cap = max(1, min(cap, top))
    own = F.row_number().over(Window.partitionBy("qid", "cell").orderBy(F.desc("sim"), "seq"))
    best = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("sim"), F.desc(time), "cell", "seq"))
    return scored.withColumn("_own", own).filter(F.col("_own") <= cap).withColumn("rank", best).filter(F.col("rank") <= top).drop("_own")


def recall(mem: Memory, bank: DataFrame, queries: DataFrame, top: int, cap: int = 1, k: int | None = None) -> DataFrame:
    """Similarity search: (qid, rank, cell, sim, exemplar_t, t_min, t_max, count).

    ``queries`` is (qid, qvec) and, for a search within k steps, lat and lng. The window is merged
    for the survivors only: limit first, then join. A cell that has aged out keeps its exemplars; its interval is null, its count 0.
    """
    own = queries.select("qid", "qvec")
    if k is None:
        scored = best_hits(bank, own, top, "seq", "cell", cap)
    else:
        at = queries.withColumn("_c", mem.grid.encode(F.col("lat"), F.col("lng"), mem.cfg.resolution)).filter("_c is not null")
        near = cells.disk(at.select("qid", "qvec", "_c"), "_c", k, "cell").drop("_c")
        scored = bank.join(near, "cell").withColumn("sim", F.round(cosine(F.col("vec"), F.col("qvec")), 9)).filter("sim is not null").drop("vec", "qvec")
    hits = rank_hits(scored.select("qid", "cell", "seq", "ts", "sim"), top, cap)
    wanted = hits.select("cell").distinct()
    merged = window_aggregate(Memory(mem.cfg, mem.grid, mem.valid.join(wanted, "cell", "left_semi"), mem.rejects, mem.last))
    out = hits.join(merged, "cell", "left")
    return out.select("qid", "rank", "cell", "sim", F.col("ts").alias("exemplar_t"), "t_min", "t_max", F.coalesce("count", F.lit(0.0)).alias("count"))


def probe(mem: Memory, bank: DataFrame, queries: DataFrame, cap: int = 1, k: int | None = None) -> DataFrame:
    """(qid, total_found): how many hits recall() would rank if nothing were cut, without scoring any: at most ``cap`` exemplars of each cell in reach."""
    per = bank.groupBy("cell").agg(F.least(F.count(F.lit(1)), F.lit(max(1, cap))).alias("n"))
    if k is None:
        return queries.select("qid").crossJoin(F.broadcast(per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_found"))))
    at = queries.withColumn("_c", mem.grid.encode(F.col("lat"), F.col("lng"), mem.cfg.resolution)).filter("_c is not null")
    near = cells.disk(at.select("qid", "_c"), "_c", k, "cell").drop("_c")
    found = near.join(per, "cell").groupBy("qid").agg(F.sum("n").alias("total_found"))
    return queries.select("qid").join(found, "qid", "left").select("qid", F.coalesce("total_found", F.lit(0)).alias("total_found"))
