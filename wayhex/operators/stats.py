"""Evaluation statistics: AUC, adversarial hits, bootstraps, run comparisons, aggregates over seeds and sessions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.hashes import pair_hashes
from ..functions.scalars import hash60
from ..functions.vectors import _unit, matrices


def auc(df: DataFrame, keys: list[str], score: str, positive: str) -> DataFrame:
    """(keys, n_pos, n_neg, auc): the chance that a positive scores above a negative, ties half. From a histogram of scores; null without both kinds."""
    pos = F.col(positive)
    return auc_of_counts(df.select(*keys, score, pos.cast("long").alias("_pos"), (~pos).cast("long").alias("_neg")), keys, score, "_pos", "_neg")


def auc_of_counts(df: DataFrame, keys: list[str], score: str, pos: str, neg: str) -> DataFrame:
    """As auc(), of rows that stand for ``pos`` positives and ``neg`` negatives with one score."""
    bins = df.groupBy(*keys, score).agg(F.sum(pos).alias("_p"), F.sum(neg).alias("_n"))
    below = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = bins.withColumn("_w", F.col("_p") * (below + 0.5 * F.col("_n"))).groupBy(*keys).agg(F.sum("_p").alias("n_pos"), F.sum("_n").alias("n_neg"), F.sum("_w").alias("_w"))
    return out.select(*keys, "n_pos", "n_neg", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("_w") / (F.col("n_pos") * F.col("n_neg"))).alias("auc"))


def adversarial_hits(df: DataFrame, keys: list[str], score: str, positive: str, ks: list[int]) -> DataFrame:
    """(keys, rank0, hit_k…): whether a positive is among the best k when tied negatives rank ahead."""
    p = F.col(positive)
    return adversarial_hits_of_counts(df.select(*keys, score, p.cast("long").alias("_pos"), (~p).cast("long").alias("_neg")), keys, score, "_pos", "_neg", ks)


def adversarial_hits_of_counts(df: DataFrame, keys: list[str], score: str, pos: str, neg: str, ks: list[int]) -> DataFrame:
    """As adversarial_hits(), of rows that stand for ``pos`` positives and ``neg`` others with one score."""
    best = df.groupBy(*keys).agg(F.max(F.when(F.col(pos) > 0, F.col(score))).alias("_best"))
    s = F.col(score)
    rank = F.coalesce(F.sum(F.when(s > F.col("_best"), F.col(pos) + F.col(neg)).when(s == F.col("_best"), F.col(neg))), F.lit(0))
    out = df.join(best, keys).groupBy(*keys).agg(F.max("_best").alias("_b"), rank.alias("rank0"))
    return out.select(*keys, F.when(F.col("_b").isNotNull(), F.col("rank0")).alias("rank0"), *[(F.col("_b").isNotNull() & (F.col("rank0") < k)).alias(f"hit_{k}") for k in ks])


#: Stands for no place; no cell or id has it.
_NOWHERE = -(1 << 63)
#: Cosines that a task keeps at once, in bytes.
SIM_BYTES = 96 << 20


def ranks_of_places(vectors: DataFrame, questions: DataFrame, here: DataFrame, own: DataFrame, sim_bytes: int = SIM_BYTES) -> DataFrame:
    """(qid, n_pos, n_neg, auc, rank0) of every question against frames that are counted by vector; a pair of vector and question never leaves a task.

    vectors is (vec_id, vec, n) with the frames of each vector, questions (qid, qvec, qcell), here (cell, vec_id, n) the frames of each place,
    own (qid, vec_id, n) those in the question's place that are set apart. Positive are the other frames of its place, negative all the rest.
    auc is the chance that a positive scores above a negative, ties half; rank0 the number of frames, set apart or not, ahead of the best
    positive when tied ones rank ahead. Ids are longs; vectors that don't fit a question are skipped, as are questions that none fits.

    Questions go by place into blocks whose cosines with all vectors take ``sim_bytes``. A task gets a block, streams all vectors by
    it, and sorts a question's cosines at a time.
    """
    nv, nq = vectors.count(), questions.count()
    spark = vectors.sparkSession
    per = max(1, min(sim_bytes // (8 * max(nv, 1)), -(-nq // (4 * spark.sparkContext.defaultParallelism))))
    blocks = max(1, -(-nq // per))
    asked = questions.withColumn("_b", F.floor((F.dense_rank().over(Window.orderBy("qcell", "qid")) - 1) / per).cast("int"))
    row = lambda kind, i, cell, n, vec: [F.lit(kind).alias("kind"), F.col(i).cast("long").alias("id"), cell.cast("long").alias("cell"), n.cast("long").alias("n"), vec.cast("array<double>").alias("vec")]
    none = F.lit(None)
    parts = [
        asked.select("_b", *row(0, "qid", F.col("qcell"), none, F.col("qvec"))),
        vectors.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("_b", *row(1, "vec_id", none, F.col("n"), F.col("vec"))),
        here.join(asked.select("_b", F.col("qcell").alias("cell")).distinct(), "cell").select("_b", *row(2, "vec_id", F.col("cell"), F.col("n"), none)),
        own.join(asked.select("_b", "qid").distinct(), "qid").select("_b", *row(3, "vec_id", F.col("qid"), F.col("n"), none)),
    ]
    rows = parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3]).repartition(blocks, "_b").sortWithinPartitions("_b", "kind")
    names = ["qid", "n_pos", "n_neg", "auc", "rank0"]

    def split(cell: np.ndarray, ids: np.ndarray, n: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By cell: ids in order, and their counts."""
        by = np.lexsort((ids, cell))
        cell, ids, n = cell[by], ids[by], n[by]
        at = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))) if len(cell) else []
        return {int(cell[i]): (ids[i:j], n[i:j]) for i, j in zip(at, [*at[1:], len(cell)])}

    def counts(ids: np.ndarray, found: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
        """The count of each id, 0 where there is none."""
        if found is None:
            return np.zeros(len(ids), np.int64)
        at = np.minimum(np.searchsorted(found[0], ids), len(found[0]) - 1)
        return np.where(found[0][at] == ids, found[1][at], 0)

    def answers(kept: dict[int, list]) -> Iterator[pa.RecordBatch]:
        join = lambda kind, k: np.concatenate([x[k] for x in kept[kind]]) if kept[kind] else np.zeros(0, np.int64)
        qids, places, ids, total = join(0, 0), join(0, 1), join(1, 0), join(1, 2)
        here, own = (split(join(k, 1), join(k, 0), join(k, 2)) for k in (2, 3))
        out: list[tuple] = []
        last, there = None, None
        for q in dict.fromkeys(qids.tolist()):
            at = np.flatnonzero(qids == q)
            place = places[at[0]]
            if there is None or place != last:
                last, there = place, counts(ids, here.get(int(place)))
            apart = counts(ids, own.get(q))
            pos, rest = there - apart, total - there
            sim = np.concatenate([x[3][i] for i in at for x in kept[1]]) if kept[1] else np.zeros(0)
            pos, rest, apart = (np.tile(x, len(at)) for x in (pos, rest, apart))
            fits = np.flatnonzero(~np.isnan(sim))
            if not len(fits):
                continue
            by = fits[np.argsort(sim[fits])]
            sim, pos, rest, apart = sim[by], pos[by], rest[by], apart[by]
            start = np.flatnonzero(np.concatenate(([True], sim[1:] != sim[:-1])))
            p, n = np.add.reduceat(pos, start), np.add.reduceat(rest, start)
            n_pos, n_neg = int(p.sum()), int(n.sum())
            won = float((p * (np.cumsum(n) - n + 0.5 * n)).sum())
            rank0 = None
            if n_pos:
                best = np.flatnonzero(p)[-1]
                rank0 = int(n[best:].sum() + apart[start[best] :].sum())
            out.append((q, n_pos, n_neg, won / (float(n_pos) * n_neg) if n_pos and n_neg else None, rank0))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64() if k == "auc" else pa.int64()) for k, x in zip(names, zip(*out))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, kept = None, {}
        for b in batches:
            at, kind = b.column(0).to_numpy(), b.column(1).to_numpy()
            cuts = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (kind[1:] != kind[:-1])))) if len(at) else []
            for i, j in zip(cuts, [*cuts[1:], len(at)]):
                if at[i] != block:
                    if block is not None:
                        yield from answers(kept)
                    block, kept = at[i], {k: [] for k in range(4)}
                part = b.slice(i, j - i)
                ids, cell, n = (pc.fill_null(part.column(k), _NOWHERE).to_numpy() for k in (2, 3, 4))
                sims = None
                if kind[i] == 1:
                    sims = np.full((sum(len(x[0]) for x in kept[0]), j - i), np.nan)
                    for rows, m in matrices(part.column(5)):
                        base = 0
                        for asked_ids, _, _, asked in kept[0]:
                            for own, q in asked:
                                if q.shape[1] == m.shape[1]:
                                    sims[np.ix_(base + own, rows)] = np.round(_unit(q) @ _unit(m).T, 9)
                            base += len(asked_ids)
                elif kind[i] == 0:
                    sims = list(matrices(part.column(5)))
                kept[int(kind[i])].append((ids, cell, n, sims))
        if block is not None:
            yield from answers(kept)

    return rows.mapInArrow(run, "qid long, n_pos long, n_neg long, auc double, rank0 long")


def draws(sizes: DataFrame, keys: list[str], resamples: int, seed: int = 42) -> DataFrame:
    """(keys, _b, _i): for each of ``resamples`` as many places from 0 as sizes (keys, _n) says, by hash. A task makes a few resamples, not all."""
    each = sizes.withColumn("_b", F.explode(F.sequence(F.lit(1), F.lit(resamples)))).repartition(min(resamples, 200), *keys, "_b")
    own = each.withColumn("_d", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    return own.select(*keys, "_b", (hash60(F.concat_ws(":", F.lit(seed), "_b", "_d")) % F.col("_n")).cast("int").alias("_i"))


#: Rows that travel as one array; rows of a key that a task holds at once; draws that are made at once, and that are worth a task.
PACK, HELD, HASHED, DRAWN = 1 << 16, 1 << 22, 1 << 14, 1 << 22


def bootstrap(df: DataFrame, order: str, values: list[str], resamples: int, seed: int = 42, keys: list[str] | None = None, held: int = HELD) -> DataFrame:
    """(keys, and for each value mean, lo, hi): percentile intervals (2.5, 97.5) of resampled means.

    ``df`` is a table of results, a row per question or session; draws are those of draws(), and the same for all values, as a paired
    comparison needs. No draw becomes a row: a key's values go as arrays to tasks, and each makes the draws of some resamples and returns
    their sums. Of a key of more than ``held`` rows a task holds that many and makes the same draws, but takes those that fall there.
    """
    keys = keys or []
    w = Window.partitionBy(*keys)
    own = [f"_v{k}" for k in range(len(values))]
    rows = df.select(*keys, *[F.col(v).cast("double").alias(o) for v, o in zip(values, own)], (F.row_number().over(w.orderBy(order)) - 1).cast("long").alias("_i"), F.count(F.lit(1)).over(w).alias("_n"))
    packs = rows.groupBy(*keys, "_n", F.floor(F.col("_i") / held).alias("_c"), F.floor(F.col("_i") / PACK).alias("_p")).agg(F.sort_array(F.collect_list(F.struct("_i", *own))).alias("_r"))
    tasks = 16 * df.sparkSession.sparkContext.defaultParallelism
    blocks = F.least(F.ceil(F.col("_n") * resamples / DRAWN), F.lit(min(tasks, resamples)))
    dealt = packs.select(*keys, "_n", "_c", F.col("_r")[0]["_i"].alias("_first"), *[F.col(f"_r.{o}").alias(o) for o in own], blocks.alias("_of"))
    dealt = dealt.withColumn("_t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_of") - 1))).repartition(tasks, *keys, "_c", "_t")

    def resampled(part: pa.Table) -> pa.Table:
        part = part.sort_by("_first")
        n, t, of, low = (part[x][0].as_py() for x in ("_n", "_t", "_of", "_first"))
        flat = [pc.list_flatten(part[o]).combine_chunks() for o in own]
        there = [x.is_valid().to_numpy(zero_copy_only=False) if x.null_count else None for x in flat]
        flat = [pc.fill_null(x, 0.0).to_numpy() for x in flat]
        b0, b1 = resamples * t // of + 1, resamples * (t + 1) // of
        sums, counts = np.zeros((len(own), b1 - b0 + 1)), np.zeros((len(own), b1 - b0 + 1), np.int64)
        for first in range(1, n + 1, HASHED):
            last = min(n, first + HASHED - 1)
            step = max(1, HASHED // (last - first + 1))
            for b in range(b0, b1 + 1, step):
                end = min(b1, b + step - 1)
                at = pair_hashes(f"{seed}:", (b, end), (first, last))
                at -= at // np.uint64(n) * np.uint64(n)
                at = at.astype(np.int64) - low
                here = None if len(flat[0]) == n else (at >= 0) & (at < len(flat[0]))
                at = at if here is None else np.where(here, at, 0)
                for k, x in enumerate(flat):
                    taken = here if there[k] is None else there[k][at] if here is None else there[k][at] & here
                    sums[k, b - b0 : end - b0 + 1] += x[at].sum(axis=1) if taken is None else np.where(taken, x[at], 0.0).sum(axis=1)
                    counts[k, b - b0 : end - b0 + 1] += at.shape[1] if taken is None else taken.sum(axis=1)
        made = {k: pa.repeat(part[k][0], b1 - b0 + 1) for k in keys} | {"_b": pa.array(range(b0, b1 + 1), pa.int64())}
        return pa.table(made | {f"_s{k}": sums[k] for k in range(len(own))} | {f"_k{k}": counts[k] for k in range(len(own))})

    schema = T.StructType([df.schema[k] for k in keys]).add("_b", "long")
    for name, kind in [*((f"_s{k}", "double") for k in range(len(own))), *((f"_k{k}", "long") for k in range(len(own)))]:
        schema = schema.add(name, kind)
    parts = dealt.groupBy(*keys, "_c", "_t").applyInArrow(resampled, schema)
    means = parts.groupBy(*keys, "_b").agg(*[F.try_divide(F.sum(f"_s{k}"), F.sum(f"_k{k}")).alias(v) for k, v in enumerate(values)])
    ends = [f(v) for v in values for f in (lambda v: F.percentile(v, 0.025).alias(f"{v}_lo"), lambda v: F.percentile(v, 0.975).alias(f"{v}_hi"))]
    found, whole = means.groupBy(*keys).agg(*ends), df.groupBy(*keys).agg(*[F.avg(v).alias(f"{v}_mean") for v in values])
    return whole.join(found, keys) if keys else F.broadcast(whole).crossJoin(found)


def paired_bootstrap(df: DataFrame, order: str, a: str, b: str, resamples: int, seed: int = 42) -> DataFrame:
    """diff_mean, diff_lo, diff_hi of a - b by row."""
    return bootstrap(df.withColumn("diff", F.col(a).cast("double") - F.col(b).cast("double")), order, ["diff"], resamples, seed)


def seed_aggregate(df: DataFrame, keys: list[str], seed: str, value: str) -> DataFrame:
    """Mean per seed, then mean and sample deviation (0 for one seed) over seeds."""
    per = df.groupBy(*keys, seed).agg(F.avg(value).alias("_v"))
    return per.groupBy(*keys).agg(F.count(F.lit(1)).alias("seeds"), F.avg("_v").alias("mean"), F.coalesce(F.stddev_samp("_v"), F.lit(0.0)).alias("sd"))


def macro_average(df: DataFrame, keys: list[str], file: str, value: str) -> DataFrame:
    """The mean over files of their means."""
    return df.groupBy(*keys, file).agg(F.avg(value).alias("_v")).groupBy(*keys).agg(F.count(F.lit(1)).alias("files"), F.avg("_v").alias("mean"))


def nested_mean(df: DataFrame, levels: list[str], value: str, keep: int = 1) -> DataFrame:
    """(the first ``keep`` levels, n, mean): means of means, level by level from the last to the kept ones; n is the number of groups at the level below."""
    out = df.select(*levels, F.col(value).alias("mean"))
    for k in range(len(levels), keep - 1, -1):
        out = out.groupBy(*levels[:k]).agg(F.count(F.lit(1)).alias("n"), F.avg("mean").alias("mean"))
    return out


def check_pairs(a: DataFrame, b: DataFrame, session: str, same: list[str], allow_unpaired: bool = False, least: int = 1) -> DataFrame:
    """The inner join of two methods' runs (session, same…, value), a row a session; ValueError where the comparison isn't fair.

    Every session needs one setting of ``same`` in each run, and the same one in both; the sets of sessions have to be equal unless
    ``allow_unpaired``, and ``least`` sessions in common.
    """
    for run in (a, b):
        if not run.groupBy(session).agg(F.count_distinct(F.struct(*same)).alias("n")).filter("n > 1").isEmpty():
            raise ValueError("settings differ within a session")
    left, right = (x.groupBy(session).agg(F.first(F.struct(*same)).alias(f"_{n}"), F.avg("value").alias(f"value_{n}")) for x, n in ((a, "a"), (b, "b")))
    both = left.join(right, session, "full")
    found = both.agg(
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("common"), F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("alone"),
        F.count_if(F.col("_a") != F.col("_b")).alias("unlike"),
    ).first()
    if found["alone"] and not allow_unpaired:
        raise ValueError(f"{found['alone']} sessions are in one run only")
    if found["common"] < least:
        raise ValueError(f"{found['common']} common sessions")
    if found["unlike"]:
        raise ValueError(f"inputs or settings differ in {found['unlike']} sessions")
    return both.filter(F.col("_a").isNotNull() & F.col("_b").isNotNull()).select(session, "value_a", "value_b")


def by_sets(df: DataFrame, sets: list[list[str]], value: str) -> DataFrame:
    """Means by several groupings in one pass; a column that isn't in a row's grouping is null."""
    names = list(dict.fromkeys(c for s in sets for c in s))
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *names).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))


def normal_ci(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean and the half width 1.96 sd / sqrt(n)."""
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (1.96 * F.coalesce(F.stddev_samp(value), F.lit(0.0)) / F.sqrt(F.count(value))).alias("half"))


def method_pivot(df: DataFrame, session: str, method: str, value: str, methods: list[str]) -> DataFrame:
    return df.groupBy(session).pivot(method, methods).agg(F.avg(value))


def wins(pivoted: DataFrame, base: str, others: list[str], margin: float) -> DataFrame:
    """(method, wins, neutral, losses) of each other method against the base over sessions that have both."""
    out = None
    for m in others:
        d = F.col(m) - F.col(base)
        row = pivoted.agg(F.lit(m).alias("method"), F.count_if(d > margin).alias("wins"), F.count_if(F.abs(d) <= margin).alias("neutral"), F.count_if(d < -margin).alias("losses"))
        out = row if out is None else out.unionAll(row)
    return out


def drift(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Per question of two runs (qid, rank, cell, sim): Jaccard of the best k cells, Spearman over common cells, same best cell, change of the best similarity.

    A side without hits counts as an empty list; two empty lists agree fully.
    """
    def side(df: DataFrame, n: str) -> DataFrame:
        own = df.filter(F.col("rank") <= k)
        return own.groupBy("qid").agg(F.collect_set("cell").alias(f"set_{n}"), F.min_by("cell", "rank").alias(f"top_{n}"), F.max("sim").alias(f"sim_{n}"))

    both = side(a, "a").join(side(b, "b"), "qid", "full")
    empty = F.array().cast("array<bigint>")
    sa, sb = F.coalesce("set_a", empty), F.coalesce("set_b", empty)
    union = F.size(F.array_union(sa, sb))
    jaccard = F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(sa, sb)) / union)
    pairs = a.filter(F.col("rank") <= k).select("qid", "cell", F.col("rank").alias("ra")).join(b.filter(F.col("rank") <= k).select("qid", "cell", F.col("rank").alias("rb")), ["qid", "cell"])
    rho = pairs.groupBy("qid").agg(F.count(F.lit(1)).alias("common"), F.try_divide(F.covar_pop("ra", "rb"), F.stddev_pop("ra") * F.stddev_pop("rb")).alias("spearman"))
    out = both.select("qid", jaccard.alias("jaccard"), F.coalesce(F.col("top_a") == F.col("top_b"), F.lit(False)).alias("same_top"), (F.col("sim_b") - F.col("sim_a")).alias("delta"))
    return out.join(rho.filter("common >= 2"), "qid", "left").select("qid", "jaccard", "same_top", "delta", "spearman")


def acceptance(df: DataFrame, encoder: str, res: str, value: str, ladder: list[int], lift: float) -> DataFrame:
    """(encoder, lift, monotone, passed): the means rise along the ladder of resolutions, and by at least ``lift`` in all. A missing resolution fails."""
    per = df.groupBy(encoder).pivot(res, ladder).agg(F.avg(value))
    cols = [F.col(str(r)) for r in ladder]
    monotone: Column = F.lit(True)
    for x, y in zip(cols, cols[1:]):
        monotone = monotone & (x <= y)
    gain = cols[-1] - cols[0]
    return per.select(encoder, gain.alias("lift"), F.coalesce(monotone, F.lit(False)).alias("monotone"), F.coalesce(monotone & (gain >= lift), F.lit(False)).alias("passed"))


def verdict(report: DataFrame, rule: str = "any", encoder: str | None = None) -> DataFrame:
    """One row: any, all, or one encoder named beforehand passes."""
    if encoder is not None:
        return report.agg(F.coalesce(F.bool_or((F.col(report.columns[0]) == encoder) & F.col("passed")), F.lit(False)).alias("passed"))
    return report.agg(F.coalesce((F.bool_or if rule == "any" else F.bool_and)("passed"), F.lit(False)).alias("passed"))


def candidate_counts(preds: DataFrame) -> DataFrame:
    """How many questions have at least 1, 2, 3, 5 hits."""
    per = preds.groupBy("qid").agg(F.count(F.lit(1)).alias("c"))
    return per.agg(F.count(F.lit(1)).alias("questions"), *[F.count_if(F.col("c") >= k).alias(f"ge_{k}") for k in (1, 2, 3, 5)])


def latency(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median, nearest-rank p95 (the ceil(0.95 n)-th) and interpolated p95 and p99, from a histogram of values: equal ones meet before they are shuffled."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*keys)
    steps = counts.withColumn("_upto", F.sum("_c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.sum("_c").over(w))
    nth = lambda k: F.min(F.when(F.col("_upto") >= k, F.col(value)))  # noqa: E731  the k-th value, from 1

    def between(q: float) -> list[Column]:
        at = q * (F.col("_n") - 1)
        low = F.floor(at)
        return [nth(low + 1), nth(F.least(low + 2, F.col("_n"))), F.first(at - low)]

    shares = {"median": 0.5, "p95": 0.95, "p99": 0.99}
    parts = [c.alias(f"_{name}{i}") for name, q in shares.items() for i, c in enumerate(between(q))]
    out = steps.groupBy(*keys).agg(*parts, nth(F.ceil(0.95 * F.col("_n"))).alias("p95_rank"))
    mixed = {name: (F.col(f"_{name}0") + F.col(f"_{name}2") * (F.col(f"_{name}1") - F.col(f"_{name}0"))).alias(name) for name in shares}
    return out.select(*keys, mixed["median"], "p95_rank", mixed["p95"], mixed["p99"])


PAIR_BLOCK = 4096
_BINS = 1 << 16


def spread(df: DataFrame, vec: str, order: str, block: int = PAIR_BLOCK) -> DataFrame:
    """One row: pairs, mean, population deviation, least and greatest, 5th and 95th percentile (interpolated) of the cosines of all pairs of vectors.

    Mean and deviation follow from the sum of the unit vectors and their matrix of second moments. Extremes and
    percentiles need the pairs: rows are dealt by hash to blocks of about ``block``, a task multiplies a pair of blocks, and only a histogram
    of its cosines leaves it; a second pass returns the values of the bins that hold the percentiles. Rows need ``order``, a long; null and
    empty vectors are left out. Under two vectors are an error.
    """
    rows = df.filter(F.size(vec) > 0).select(F.col(order).cast("long").alias("_o"), F.col(vec).alias("_v"))
    n = rows.count()
    if n < 2:
        raise ValueError("a spread needs two vectors")
    blocks = -(-n // block)
    rows = rows.withColumn("_b", F.pmod(F.xxhash64("_o"), F.lit(blocks)).cast("int"))

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, m in matrices(b.column(0)):
                u = _unit(m)
                d = u.shape[1]
                both = np.concatenate((u.sum(axis=0), (u.T @ u).ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(d + d * d)), pa.array(both), pa.array(np.full(len(both), d))], ["i", "x", "d"])

    sums = rows.select("_v").mapInArrow(moments, "i long, x double, d long").groupBy("i").agg(F.sum("x").alias("x"), F.max("d").alias("d"))
    pairs = n * (n - 1) // 2
    total = sums.agg(F.sum(F.when(F.col("i") < F.col("d"), F.col("x") * F.col("x"))).alias("s"), F.sum(F.when(F.col("i") >= F.col("d"), F.col("x") * F.col("x"))).alias("q"))
    mean = (F.col("s") - n) / (2.0 * pairs)
    total = total.select(F.lit(pairs).cast("long").alias("pairs"), mean.alias("mean"), F.sqrt(F.greatest((F.col("q") - n) / (2.0 * pairs) - mean * mean, F.lit(0.0))).alias("sd"))

    left = rows.select("_b", "_o", "_v", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_c"))
    both = left.select(F.least("_b", "_c").alias("i"), F.greatest("_b", "_c").alias("j"), "_b", "_v")

    def cosines_of(rows):  # noqa: ANN001, ANN202
        i, j = rows["i"].iloc[0], rows["j"].iloc[0]
        b = rows["_b"].to_numpy()
        unit = lambda own: _unit(np.stack(own.to_numpy()).astype(np.float64)) if len(own) else None
        x, y = unit(rows["_v"][b == i]), unit(rows["_v"][b == j])
        if x is None or y is None:
            return np.zeros(0)
        c = np.round(np.clip(x @ y.T, -1.0, 1.0), 12)
        return c[np.triu_indices(len(c), 1)] if i == j else c.ravel()

    def histogram(rows):  # noqa: ANN001, ANN202
        c = cosines_of(rows)
        bins, count = np.unique(np.minimum((c + 1) * (_BINS / 2), _BINS - 1).astype(np.int64), return_counts=True)
        return pd.DataFrame({"bin": bins, "n": count, "lo": c.min() if len(c) else np.nan, "hi": c.max() if len(c) else np.nan})

    found = both.groupBy("i", "j").applyInPandas(histogram, "bin long, n long, lo double, hi double").groupBy("bin").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).orderBy("bin").toPandas()
    upto = found["n"].cumsum().to_numpy()
    ranks = {q: (int(np.floor(q * (pairs - 1))), q * (pairs - 1) % 1) for q in (0.05, 0.95)}
    wanted = sorted({int(np.searchsorted(upto, k, "right")) for r, _ in ranks.values() for k in (r, min(r + 1, pairs - 1))})
    own = found["bin"].to_numpy()[wanted]

    def values(rows):  # noqa: ANN001, ANN202
        c = cosines_of(rows)
        c = c[np.isin(np.minimum((c + 1) * (_BINS / 2), _BINS - 1).astype(np.int64), own)]
        v, count = np.unique(c, return_counts=True)
        return pd.DataFrame({"v": v, "n": count})

    near = both.groupBy("i", "j").applyInPandas(values, "v double, n long").groupBy("v").agg(F.sum("n").alias("n")).orderBy("v").toPandas()
    bins = np.minimum((near["v"].to_numpy() + 1) * (_BINS / 2), _BINS - 1).astype(np.int64)

    def at(k: int) -> float:
        place = int(np.searchsorted(upto, k, "right"))
        inside = near[bins == found["bin"].iloc[place]]
        return float(inside["v"].iloc[int(np.searchsorted(inside["n"].cumsum().to_numpy(), k - (upto[place - 1] if place else 0), "right").clip(0, len(inside) - 1))])

    marks = {f"p{round(100 * q):02d}": at(r) + part * (at(min(r + 1, pairs - 1)) - at(r)) for q, (r, part) in ranks.items()}
    return total.select("*", F.lit(float(found["lo"].min())).alias("min"), F.lit(float(found["hi"].max())).alias("max"), *[F.lit(v).alias(k) for k, v in marks.items()])


def grid(spark, **values: list) -> DataFrame:  # noqa: ANN001
    """Every combination of parameter values, one row each, numbered."""
    from itertools import product

    rows = [(i, *combo) for i, combo in enumerate(product(*values.values()))]
    return spark.createDataFrame(rows, ["run", *values])
