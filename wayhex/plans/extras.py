"""Queries over quantized payloads, sequential policies, motion, clusters and streams; SQL states most of them by recursion or running maxima."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codec
from ..functions.vectors import search
from ..functions.cells import DEG
from ..functions.scalars import GRAVITY, hash60
from ..operators import cluster, memory, motion, retention, sketch, stats
from ..scratch import shared_path
from ..streaming.slots import arrival_slots, event_windows
from ..streaming.tiles import tile_states
from . import core, data
from .analytics import EST, FRAMES, SEED, frames, key
from .data import CFG, GRID, OBS, QUE, VEC, hash_sql
from .registry import query

r6 = core.r6


def rotated_sql(vec: str) -> str:
    """codec.rotate() of a list of 64 numbers."""
    return f"list_transform(range(0, 64), lambda i: list_sum(list_transform(range(0, 64), lambda j: {vec}[j + 1] * sgn[j + 1] * (CASE WHEN bit_count((i & j)::BIGINT) % 2 = 0 THEN 1 ELSE -1 END))))"


def quantized_sql(bits: int) -> str:
    """CTEs vl (vec_id, x) of quantized vectors and ql (qid, y) of rotated questions."""
    steps = codec.levels(bits).tolist()
    nearest = "CASE " + " ".join(f"WHEN e / s <= {(a + b) / 2!r}::DOUBLE THEN {a!r}::DOUBLE" for a, b in zip(steps, steps[1:])) + f" ELSE {steps[-1]!r}::DOUBLE END"
    return f"""sg AS (SELECT {codec.signs(64).tolist()!r}::DOUBLE[] AS sgn), vr AS (SELECT vec_id, {rotated_sql("vec")} AS x FROM vec, sg), vs AS (SELECT vec_id, x, sqrt(list_dot_product(x, x) / 64) AS s FROM vr),
vl AS (SELECT vec_id, list_transform(x, lambda e: {nearest}) AS x FROM vs), ql AS (SELECT qid, {rotated_sql("qvec")} AS y FROM que, sg)"""


QCOS = "round(list_dot_product(x, y) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y))), 9)"
QSC = f"qsc AS (SELECT qid, cell, seq, ts, {QCOS} AS sim FROM bank JOIN vec ON seq % nvec = vec_id JOIN vl USING (vec_id), ql), qown AS (SELECT *, row_number() OVER (PARTITION BY qid, cell ORDER BY sim DESC, seq) AS k FROM qsc), qp AS (SELECT * FROM (SELECT qid, cell, seq, sim, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, ts DESC, cell, seq) AS rank FROM qown WHERE k = 1) WHERE rank <= 5)"


@query(f"WITH {data.mem_sql()}, {data.BANK}, {VEC}, {QUE}, {quantized_sql(4)}, {QSC} SELECT qid, rank, cell, seq, round(sim, 6) AS sim FROM qp")
def quantized_recall(spark, sf):
    """Recall over 4-bit payloads: scored in the rotated space, the best of each batch alone leave the scan."""
    own = core.bank(spark, sf).select("cell", "seq", "ts", codec.encode_column(F.col("vec"), "4b").alias("vec"))
    q = data.questions(spark, sf).select("qid", "qvec")
    return memory.rank_hits(codec_hits(own, q, "4b", 5), 5).select("qid", "rank", "cell", "seq", r6("sim").alias("sim"))


def codec_hits(bank, questions, name, top):
    """memory.best_hits() of a bank whose vec is a payload."""
    parts = []
    for ids, vectors in memory.query_blocks(questions):
        turned = [None if v is None else codec.CODECS[name].turn(np.array([v], np.float64))[0] for v in vectors]
        parts.append(search(bank, "vec", ids, turned, questions.schema["qid"].dataType, top, "seq", "cell", vectors=codec.CODECS[name].decode))
    return reduce(DataFrame.unionAll, parts)


def drift_sql(bits: int) -> str:
    return f"""{core.recall_sql()}, {quantized_sql(bits)}, {QSC}, x AS (SELECT qid, list(DISTINCT cell) AS s, arg_min(cell, rank) AS top, max(sim) AS sim FROM preds GROUP BY qid), y AS (SELECT qid, list(DISTINCT cell) AS s, arg_min(cell, rank) AS top, max(sim) AS sim FROM qp GROUP BY qid),
rh AS (SELECT a.qid, count(*) AS n, covar_pop(a.rank, b.rank) / nullif(stddev_pop(a.rank) * stddev_pop(b.rank), 0) AS rho FROM preds a JOIN qp b ON a.qid = b.qid AND a.cell = b.cell GROUP BY a.qid)
SELECT qid, round(len(list_intersect(x.s, y.s)) / len(list_distinct(list_concat(x.s, y.s)))::DOUBLE, 6) AS jaccard, x.top = y.top AS same_top, round(y.sim - x.sim, 6) AS delta, CASE WHEN n >= 2 THEN round(rho, 6) END AS spearman FROM x JOIN y USING (qid) LEFT JOIN rh USING (qid)"""


def drift_of(spark, sf, name):
    """Recall over raw vectors against recall over a codec's payloads."""
    own = core.bank(spark, sf).select("cell", "seq", "ts", "vec")
    q = data.questions(spark, sf).select("qid", "qvec")
    raw = memory.rank_hits(memory.best_hits(own, q, 5, "seq", "cell"), 5)
    packed = memory.rank_hits(codec_hits(own.withColumn("vec", codec.encode_column(F.col("vec"), name)), q, name, 5), 5)
    return stats.drift(raw, packed, 5).select("qid", r6("jaccard").alias("jaccard"), "same_top", r6("delta").alias("delta"), r6("spearman").alias("spearman"))


@query(drift_sql(4))
def codec_drift_4b(spark, sf):
    return drift_of(spark, sf, "4b")


@query(drift_sql(3))
def codec_drift_3b(spark, sf):
    return drift_of(spark, sf, "3b")


@query(drift_sql(2))
def codec_drift_2b(spark, sf):
    return drift_of(spark, sf, "2b")


@query(f"""WITH RECURSIVE v AS (SELECT vec_id AS seq, embedding::DOUBLE[] AS vec FROM embeddings), st AS (SELECT 0 AS pick, seq, vec, -2e0 AS s, seq = (SELECT seq FROM v ORDER BY {hash_sql(f"concat_ws(':', {SEED}, seq)")}, seq LIMIT 1) AS c FROM v
  UNION ALL SELECT pick + 1, seq, vec, s2, row_number() OVER (ORDER BY s2, seq) = 1 FROM (SELECT pick, seq, vec, CASE WHEN c OR s > 5 THEN 9 ELSE greatest(s, round(list_dot_product(vec, first_value(vec) OVER (ORDER BY c DESC)), 9)) END AS s2 FROM st) WHERE pick < 15)
SELECT seq, pick FROM st WHERE c""")
def kcenter(spark, sf):
    """Farthest-first over the embeddings, 16 picks."""
    v = data.vectors(spark, sf).select(F.col("vec_id").alias("seq"), "vec")
    return retention.kcenter(v, 16).select("seq", "pick")


@query()
def spatial_priority(spark, sf):
    """A bank of 16 frames for each user."""
    return retention.spatial_priority(frames(spark, sf).select("session", "seq", "ts", "cell"), 16)


STEP = f"""(SELECT s.session, s.seq, s.k, s.t, s.off, s.lat, s.lng, s.wx, s.wy, s.wz, s.t - r.t AS dt, s.t - r.t > 0 AND s.t - r.t <= 5 AS mv, r.gx + 0.02e0 * (s.ax - r.gx) AS gx, r.gy + 0.02e0 * (s.ay - r.gy) AS gy, r.gz + 0.02e0 * (s.az - r.gz) AS gz, r.h AS ph, r.plat, r.plng FROM r JOIN s ON s.session = r.session AND s.k = r.k + 1)"""
TURN = f"(SELECT *, sqrt(gx * gx + gy * gy + gz * gz) AS n, CASE WHEN off < 0.5 THEN 0 WHEN off < 3 THEN 1.2 + least(greatest((off - 0.5) / 2.5, 0), 1) * 1.3 ELSE 2.5 + least(greatest((off - 3) / 7, 0), 1) * 3.5 END * dt / ({6371000.0 * DEG!r}::DOUBLE) AS m FROM {STEP})"
HEAD = f"(SELECT *, ph - CASE WHEN mv AND n >= 1 THEN dt * (wx * gx + wy * gy + wz * gz) / n ELSE 0 END AS h0 FROM {TURN})"


@query(f"""WITH RECURSIVE {OBS}, s AS (SELECT session, seq, ts / 600 AS t, value / 50 AS ax, 0.5e0 AS ay, 9.8e0 AS az, 0e0 AS wx, 0.01e0 AS wy, value / 500 - 0.1e0 AS wz, lat, lng, abs(sqrt(pow(value / 50, 2) + 0.25e0 + 96.04e0) - {GRAVITY}) AS off, row_number() OVER (PARTITION BY session ORDER BY ts, seq) AS k FROM o),
r(session, seq, k, t, off, gx, gy, gz, h, plat, plng) AS (SELECT session, seq, k, t, off, ax, ay, az, 0e0, lat, lng FROM s WHERE k = 1
  UNION ALL SELECT session, seq, k, t, off, gx, gy, gz, h, CASE WHEN mv THEN 0.8e0 * (plat + m * cos(h)) + 0.2e0 * lat ELSE lat END, CASE WHEN mv THEN 0.8e0 * (plng + m * sin(h) / cos(plat * {DEG!r}::DOUBLE)) + 0.2e0 * lng ELSE lng END
  FROM (SELECT *, CASE WHEN abs(h0) <= pi() THEN h0 ELSE h0 - 2 * pi() * round(h0 / (2 * pi())) END AS h FROM {HEAD}))
SELECT session, seq, CASE WHEN off < 0.5 THEN 'stationary' WHEN off < 3 THEN 'walking' ELSE 'running' END AS motion, round(h, 6) AS heading, round(asin(greatest(-1, least(1, -CASE WHEN sqrt(gx * gx + gy * gy + gz * gz) >= 1 THEN gz / sqrt(gx * gx + gy * gy + gz * gz) ELSE 0 END))), 6) AS pitch, round(plat, 6) AS lat, round(plng, 6) AS lng FROM r""")
def imu_dead_reckoning(spark, sf):
    """Events as inertial samples."""
    o = data.observations(spark, sf)
    accel, gyro = F.array(F.col("value") / 50, F.lit(0.5), F.lit(9.8)), F.array(F.lit(0.0), F.lit(0.01), F.col("value") / 500 - 0.1)
    out = motion.dead_reckon(o.select("session", "seq", (F.col("ts") / 600).alias("ts"), accel.alias("accel"), gyro.alias("gyro"), "lat", "lng"), 0.8)
    return out.select("session", "seq", "motion", *(r6(c).alias(c) for c in ("heading", "pitch", "lat", "lng")))


@query()
def kmeans_medoids(spark, sf):
    v = data.vectors(spark, sf).select(F.col("vec_id").alias("seq"), "vec")
    return cluster.medoids(v, 10, starts=3)


@query(f"""WITH {FRAMES}, a AS (SELECT *, row_number() OVER (PARTITION BY cell, session ORDER BY {key('seq')}, seq) AS c FROM f), b AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY c, {key('seq')}, seq) AS t FROM a WHERE c <= 2)
SELECT seq, cell, session FROM b ORDER BY t, {key('cell')}, cell LIMIT 200""")
def query_round_robin(spark, sf):
    """Frames dealt over cells in turn, at most 2 of a cell and user, 200 in all."""
    return cluster.round_robin(frames(spark, sf), "cell", "session", 2, 200).select("seq", "cell", "session")


@query(f"WITH {OBS}, a AS (SELECT session, arg_min(ts, seq) AS t0 FROM o WHERE ts >= 0 GROUP BY session) SELECT session AS user_id, seq, ts, greatest(floor((max(ts) OVER (PARTITION BY session ORDER BY seq) - t0) / 86400), 0)::BIGINT AS slot FROM o JOIN a USING (session)")
def stream_slots(spark, sf):
    """The event stream through Structured Streaming, per user; state decides the slot."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/event[s].parquet")
    rows = stream.select("user_id", F.col("event_id").alias("seq"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"))
    out = arrival_slots(rows, "user_id", 86400.0)
    path = shared_path(spark, "stream")
    run = out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/out")


@query(f"""WITH {data.mem_sql()}, d AS (SELECT *, floor(ts / 86400e0)::BIGINT AS sl FROM r), e AS (SELECT *, max(sl) OVER (PARTITION BY cell) AS last FROM d), ring AS (SELECT cell, count(*) AS k, sum(pow(2e0, -rho)) AS p FROM (SELECT cell, j, max(rho) AS rho FROM e WHERE sl > last - 3 GROUP BY ALL) GROUP BY cell),
kept AS (SELECT cell, list(seq ORDER BY seq) AS held FROM (SELECT cell, seq, row_number() OVER (PARTITION BY cell ORDER BY {hash_sql(f"concat_ws(':', {CFG.seed}, cell, seq)")}, seq) AS k FROM r) WHERE k <= 4 GROUP BY cell), n AS (SELECT cell, count(*) AS seen, max(sl) AS last_slot FROM d GROUP BY cell)
SELECT cell, seen, last_slot, round({EST}, 6) AS n_distinct, array_to_string(held, ',') AS held FROM n JOIN ring USING (cell) JOIN kept USING (cell)""")
def stream_tiles(spark, sf):
    """Each cell's ring of the last three days and its sample of four rows, kept as state of a stream; the latest state of each cell."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/event[s].parquet")
    rows = data.observed(stream).select("seq", "ts", GRID.encode(F.col("lat"), F.col("lng"), CFG.resolution).alias("cell"), "item").filter("cell is not null and length(item) > 0")
    path = shared_path(spark, "tiles")
    out = tile_states(rows, 86400.0, 3, CFG.precision, 4, CFG.seed)

    def keep(batch, number):  # noqa: ANN001, ANN202
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    run = out.writeStream.outputMode("update").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(keep).start()
    run.awaitTermination()
    kept = spark.read.parquet(f"{path}/out")
    latest = kept.groupBy("cell").agg(F.max_by(F.struct("seen", "last_slot", "n_distinct", "held"), F.struct("batch", "seen")).alias("s"))
    return latest.select("cell", "s.seen", "s.last_slot", r6("s.n_distinct").alias("n_distinct"), F.array_join("s.held", ",").alias("held"))


@query(f"WITH {data.mem_sql()}, d AS (SELECT cell, floor(ts / 86400e0)::BIGINT AS slot, j, max(rho) AS rho FROM r GROUP BY ALL) SELECT cell, slot, round({EST}, 6) AS n_distinct FROM (SELECT cell, slot, count(*) AS k, sum(pow(2e0, -rho)) AS p FROM d GROUP BY cell, slot)")
def stream_windows(spark, sf):
    """Registers of each cell and day from a stream with a watermark, merged by maximum over its micro-batches."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{sf}/event[s].parquet")
    rows = data.observed(stream).select(F.timestamp_micros(F.round(F.col("ts") * 1e6).cast("long")).alias("ts"), GRID.encode(F.col("lat"), F.col("lng"), CFG.resolution).alias("cell"), "item")
    rows = rows.filter("cell is not null and length(item) > 0").withColumn("h", hash60(F.col("item")))
    path = shared_path(spark, "windows")

    def keep(batch, number):  # noqa: ANN001, ANN202
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    out = event_windows(rows, "ts", "cell", "h", 86400, CFG.precision, capacity=CFG.capacity)
    run = out.writeStream.outputMode("update").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(keep).start()
    run.awaitTermination()
    regs = spark.read.parquet(f"{path}/out").select("cell", F.floor(F.unix_seconds("slot_start") / 86400).alias("slot"), "j", "rho")
    return sketch.estimate(sketch.merge(regs, ["cell", "slot"]), ["cell", "slot"], CFG.precision, "n_distinct").withColumn("n_distinct", r6("n_distinct"))
