"""Queries over the spatial memory: cells, slots, windows, recall, alignment and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import cells, scalars
from ..functions.vectors import cosine
from ..operators import align, memory, score
from ..operators.slots import assign_slots
from . import data
from .data import BANK, CFG, COS, GT, LIVE, OBS, PLACES, QUE, VEC, agg_sql, cell_sql, disk_sql, mem_sql
from .registry import query

r6 = lambda c: F.round(c, 6)
T0 = 1704067200.0  # the session clock starts here


# cells, slots and windows


@query(f"WITH {OBS} SELECT seq, {cell_sql()} AS cell, {cell_sql(res=8)} AS coarse FROM o")
def cell_encode(spark, sf):
    lat, lng = F.col("lat"), F.col("lng")
    return data.observations(spark, sf).select("seq", data.GRID.encode(lat, lng, CFG.resolution).alias("cell"), data.GRID.encode(lat, lng, 8).alias("coarse"))


@query(f"WITH {PLACES} SELECT point_id, {cell_sql()} IS NOT NULL AS accepted FROM pl")
def validity_filter(spark, sf):
    return data.places(spark, sf).select("point_id", cells.valid(F.col("lat"), F.col("lng")).alias("accepted"))


@query(f"WITH {mem_sql()} SELECT seq, slot FROM s")
def slot_assign(spark, sf):
    return assign_slots(data.observations(spark, sf), CFG.window_sec).select("seq", "slot")


@query(f"""WITH {mem_sql()}, {agg_sql("a", LIVE)}, {agg_sql("c", "slot >= last_slot")},
t AS (SELECT cell, count(*) AS seen FROM v GROUP BY cell)
SELECT cell, seen, round(coalesce(c.n, 0), 6) AS current, round(coalesce(a.n, 0), 6) AS total, a.t_min, a.t_max FROM t LEFT JOIN a USING (cell) LEFT JOIN c USING (cell)""")
def tile_summary(spark, sf):
    out = memory.tile_summary(data.memory(spark, sf))
    return out.select("cell", "seen", r6("current").alias("current"), r6("total").alias("total"), "t_min", "t_max")


@query(f"""WITH {mem_sql()}, {agg_sql("a", "slot >= last_slot - 3")}, {PLACES}, pt AS (SELECT point_id, {cell_sql()} AS cell FROM pl)
SELECT point_id, CASE WHEN pt.cell IS NOT NULL THEN round(coalesce(n, 0), 6) END AS count FROM pt LEFT JOIN a USING (cell)""")
def window_count_n(spark, sf):
    return memory.window_count(data.memory(spark, sf), data.places(spark, sf), 3).select("point_id", r6("count").alias("count"))


@query(f"""WITH {mem_sql()}, {agg_sql("a", LIVE)}, {PLACES}, pt AS (SELECT point_id, {cell_sql()} AS c FROM pl), {disk_sql("near", "pt", "point_id", 2)},
f AS (SELECT point_id, row_number() OVER (PARTITION BY point_id ORDER BY t_max DESC, n DESC, cell) AS rank, cell, t_min, t_max, round(n, 6) AS count, count(*) OVER (PARTITION BY point_id) AS total_found FROM near JOIN a USING (cell))
SELECT * FROM f WHERE rank <= 5""")
def last_seen(spark, sf):
    return memory.last_seen(data.memory(spark, sf), data.places(spark, sf), 2, 5).withColumn("count", r6("count"))


@query(f"""WITH {mem_sql()}, {agg_sql("a", LIVE)}, {agg_sql("c", "slot >= last_slot")}, t AS (SELECT DISTINCT cell FROM v)
SELECT count(*) AS tiles, (SELECT count(*) FROM v) AS records, round(sum(a.n), 6) AS total_mass, round(sum(c.n), 6) AS current_mass, round(max(a.n), 6) AS hottest FROM t LEFT JOIN a USING (cell) LEFT JOIN c USING (cell)""")
def tile_count_mass(spark, sf):
    out = memory.tile_summary(data.memory(spark, sf))
    return out.agg(F.count(F.lit(1)).alias("tiles"), F.sum("seen").alias("records"), r6(F.sum("total")).alias("total_mass"), r6(F.sum("current")).alias("current_mass"), r6(F.max("total")).alias("hottest"))


@query(f"""WITH {mem_sql()}, {agg_sql("a", LIVE)}, {agg_sql("c", "slot >= last_slot")}, t AS (SELECT DISTINCT cell FROM v),
h AS (SELECT cell, coalesce(a.n, 0) AS total, coalesce(c.n, 0) AS current FROM t LEFT JOIN a USING (cell) LEFT JOIN c USING (cell))
SELECT cell, round(CASE WHEN total > 0 THEN current / total ELSE 0 END, 6) AS recency, round(total / max(total) OVER (), 6) AS heat, CASE WHEN current < 1 THEN 0.35 ELSE 1.0 END::DOUBLE AS alpha FROM h""")
def recency_heat(spark, sf):
    out = memory.tile_summary(data.memory(spark, sf))
    most = out.agg(F.max("total").alias("most"))
    recency = F.when(F.col("total") > 0, F.col("current") / F.col("total")).otherwise(0.0)
    return out.crossJoin(F.broadcast(most)).select("cell", r6(recency).alias("recency"), r6(F.col("total") / F.col("most")).alias("heat"), F.when(F.col("current") < 1, 0.35).otherwise(1.0).alias("alpha"))


@query(f"WITH {OBS}, c AS (SELECT DISTINCT {cell_sql()} AS c FROM o), {disk_sql('d', 'c', 'c', 1)} SELECT c AS cell, count(*) AS cells, count(n.cell) AS present FROM d LEFT JOIN (SELECT c AS cell FROM c) n USING (cell) GROUP BY c")
def k_ring_neighbours(spark, sf):
    own = data.observations(spark, sf).select(data.GRID.encode(F.col("lat"), F.col("lng"), CFG.resolution).alias("cell")).distinct()
    near = cells.disk(own, "cell", 1).join(own.select(F.col("cell").alias("near"), F.lit(1).alias("there")), "near", "left")
    return near.groupBy("cell").agg(F.count(F.lit(1)).alias("cells"), F.count("there").alias("present"))


# samples and similarity recall


def bank(spark, sf):
    return data.with_vectors(memory.exemplars(data.memory(spark, sf)).select("cell", "seq", "ts"), spark, sf)


SCORED = f"sc AS (SELECT qid, cell, seq, ts, {COS} AS sim FROM bank JOIN vec ON seq % nvec = vec_id, que)"
NEAR = f"{disk_sql('near', '(SELECT qid, qvec, ' + cell_sql() + ' AS c FROM que)', 'qid, qvec', 2)}, sc AS (SELECT qid, cell, seq, ts, {COS} AS sim FROM bank JOIN vec ON seq % nvec = vec_id JOIN near USING (cell))"


def hits_sql(top: int, cap: int, scored: str = SCORED) -> str:
    return f"""{scored}, own AS (SELECT *, row_number() OVER (PARTITION BY qid, cell ORDER BY sim DESC, seq) AS k FROM sc),
hits AS (SELECT qid, rank, cell, sim, exemplar_t FROM (SELECT qid, cell, sim, ts AS exemplar_t, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, ts DESC, cell, seq) AS rank FROM own WHERE k <= {cap}) WHERE rank <= {top}),
preds AS (SELECT qid, rank, cell, sim, exemplar_t, t_min, t_max, round(coalesce(n, 0), 6) AS count FROM hits LEFT JOIN a USING (cell))"""


def recall_sql(top: int = 5, cap: int = 1, scored: str = SCORED) -> str:
    return f"WITH {mem_sql()}, {agg_sql('a', LIVE)}, {BANK}, {VEC}, {QUE}, {hits_sql(top, cap, scored)}"


def recalled(spark, sf, cap=1, k=None):
    out = memory.recall(data.memory(spark, sf), bank(spark, sf), data.questions(spark, sf), 5, cap, k)
    return out.withColumn("count", r6("count"))


@query(f"WITH {mem_sql()}, {BANK} SELECT cell, seq, ts FROM bank")
def reservoir_sample(spark, sf):
    return memory.exemplars(data.memory(spark, sf)).select("cell", "seq", "ts")


@query(f"{recall_sql()} SELECT * FROM preds")
def similar_global(spark, sf):
    return recalled(spark, sf)


@query(f"{recall_sql(scored=NEAR)} SELECT * FROM preds")
def similar_kring(spark, sf):
    return recalled(spark, sf, k=2)


@query(f"{recall_sql(cap=3)} SELECT * FROM preds")
def similar_cap_n(spark, sf):
    return recalled(spark, sf, cap=3)


ALL = f"WITH {OBS}, {VEC}, {QUE}, sim AS (SELECT qid, vec_id, {COS} AS sim FROM vec, que), sc AS (SELECT qid, seq, ts, sim FROM o JOIN sim ON seq % (SELECT any_value(nvec) FROM vec) = vec_id)"


def leaders(spark, sf, top):
    """(qid, rank, seq, ts, sim): the best observations of each question.

    Vectors are ranked first, by similarity and their first observation: only the ``top`` best of them, and the first ``top`` observations of each, can be among the result.
    """
    o = data.with_vector_ids(data.observations(spark, sf).select("seq", "ts"), spark, sf)
    early = o.withColumn("k", F.row_number().over(Window.partitionBy("vec_id").orderBy("seq"))).filter(F.col("k") <= top)
    first = early.filter("k = 1").select("vec_id", F.col("seq").alias("first"))
    seen = data.vectors(spark, sf).select("vec_id", "vec").join(first, "vec_id")
    best = memory.best_hits(seen, data.questions(spark, sf).select("qid", "qvec"), top, "first")
    near = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("sim"), "first"))
    best = best.withColumn("k", near).filter(F.col("k") <= top).drop("k", "first")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("sim"), "seq"))
    return best.join(early.drop("k"), "vec_id").withColumn("rank", rank).filter(F.col("rank") <= top).select("qid", "rank", "seq", "ts", "sim")


@query(f"{ALL} SELECT qid, rank, seq, sim FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, seq) AS rank FROM sc) WHERE rank <= 5")
def brute_force_topk(spark, sf):
    return leaders(spark, sf, 5).select("qid", "rank", "seq", "sim")


@query(f"WITH {OBS}, b AS (SELECT *, floor(ts / 21600e0)::BIGINT AS bin FROM o) SELECT bin, seq FROM (SELECT bin, seq, row_number() OVER (PARTITION BY bin ORDER BY round(abs(ts - (bin + 0.5e0) * 21600e0), 6), seq) AS k FROM b) WHERE k = 1")
def uniform_bins(spark, sf):
    o = data.observations(spark, sf).withColumn("bin", F.floor(F.col("ts") / 21600.0))
    nearest = F.row_number().over(Window.partitionBy("bin").orderBy(r6(F.abs(F.col("ts") - (F.col("bin") + 0.5) * 21600.0)), "seq"))
    return o.withColumn("k", nearest).filter("k = 1").select("bin", "seq")


@query(f"""WITH {OBS}, e AS (SELECT max(ts) - {T0} AS m FROM o), w AS (SELECT unnest(range(0, ceil((m - 1e-6) / 43200)::BIGINT)) AS k FROM e)
SELECT k AS win, count(*) AS n, round(avg(value), 6) AS mean_value, min(seq) AS first_seq FROM w JOIN o ON ts - {T0} >= k * 43200 AND ts - {T0} < k * 43200 + 86400 GROUP BY k""")
def sliding_windows(spark, sf):
    """Windows of a day every half day from the start of the session; each row goes to the windows that hold it."""
    o = data.observations(spark, sf).withColumn("t", F.col("ts") - T0)
    last = o.agg(F.max("t").alias("m"))
    k = F.floor(F.col("t") / 43200.0)
    rows = o.crossJoin(F.broadcast(last)).select("*", F.explode(F.array(k - 1, k)).alias("win")).filter((F.col("win") >= 0) & (F.col("win") * 43200 < F.col("m") - 1e-6))
    return rows.groupBy("win").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("value")).alias("mean_value"), F.min("seq").alias("first_seq"))


@query(f"""WITH {OBS}, {VEC}, p AS (SELECT floor(ts / 21600e0)::BIGINT AS bin, unnest(range(1, 65)) AS i, unnest(vec) AS x FROM o JOIN vec ON seq % nvec = vec_id)
SELECT bin, i AS dim, round(avg(x), 6) AS mean FROM p GROUP BY bin, i""")
def smooth_vectors(spark, sf):
    o = data.with_vectors(data.observations(spark, sf), spark, sf).select(F.floor(F.col("ts") / 21600.0).alias("bin"), F.posexplode("vec").alias("i", "x"))
    return o.groupBy("bin", (F.col("i") + 1).cast("long").alias("dim")).agg(r6(F.avg(F.col("x").cast("double"))).alias("mean"))


@query(f"""{ALL}, pool AS (SELECT * FROM (SELECT qid, seq, ts, sim, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, seq) AS r0 FROM sc) WHERE r0 <= 20),
re AS (SELECT p.qid, p.seq, p.r0, round(avg(c.sim), 9) AS pooled FROM pool p JOIN sc c ON c.qid = p.qid AND c.ts BETWEEN p.ts - 900 AND p.ts + 900 GROUP BY ALL)
SELECT qid, rank, seq, round(pooled, 6) AS pooled FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY pooled DESC, r0) AS rank FROM re) WHERE rank <= 5""")
def temporal_pool_rerank(spark, sf):
    """The best 20 frames, re-ranked by the mean similarity of the frames at most 900 s away, cut to 5."""
    pool = leaders(spark, sf, 20).select("qid", F.col("rank").alias("r0"), F.col("seq").alias("top_seq"), (F.col("ts") - 900).alias("start"), (F.col("ts") + 900).alias("end"))
    near = align.within(data.with_vector_ids(data.observations(spark, sf).select("seq", "ts"), spark, sf), pool, "ts", 3600.0).select("qid", "r0", "top_seq", "vec_id")
    # only pairs of a question and a vector that is near one of its leaders are scored
    pairs = near.select("qid", "vec_id").distinct().join(data.questions(spark, sf).select("qid", "qvec"), "qid").join(data.vectors(spark, sf).select("vec_id", "vec"), "vec_id")
    sims = pairs.select("qid", "vec_id", F.round(cosine(F.col("vec"), F.col("qvec")), 9).alias("sim"))
    near = near.join(sims, ["qid", "vec_id"]).groupBy("qid", "top_seq", "r0").agg(F.round(F.avg("sim"), 9).alias("pooled"))
    again = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("pooled"), "r0"))
    return near.withColumn("rank", again).filter("rank <= 5").select("qid", "rank", F.col("top_seq").alias("seq"), r6("pooled").alias("pooled"))


# alignment: errors are a coarse track, all other events are frames

TRACK = "tr AS (SELECT session, ts, lat, lng, value FROM o WHERE item LIKE 'error|%'), fr AS (SELECT * FROM o WHERE item NOT LIKE 'error|%')"
BRACKET = "b AS (SELECT fr.seq, fr.session, fr.ts, p.ts AS t0, p.lat AS a0, p.lng AS g0, p.value AS v0, n.ts AS t1, n.lat AS a1, n.lng AS g1, n.value AS v1 FROM fr ASOF LEFT JOIN tr p ON fr.session = p.session AND fr.ts >= p.ts ASOF LEFT JOIN tr n ON fr.session = n.session AND fr.ts <= n.ts)"


def track_and_frames(spark, sf):
    o = data.observations(spark, sf)
    return o.filter("item like 'error|%'").select("session", "ts", "lat", "lng", "value"), o.filter("item not like 'error|%'").select("seq", "session", "ts")


@query(f"""WITH {OBS}, {TRACK}, {BRACKET}, f AS (SELECT *, CASE WHEN t1 - t0 < 1e-12 THEN 0 ELSE (ts - t0) / (t1 - t0) END AS f FROM b)
SELECT seq, round(CASE WHEN t0 IS NULL THEN a1 WHEN t1 IS NULL THEN a0 ELSE a0 + f * (a1 - a0) END, 6) AS lat, round(CASE WHEN t0 IS NULL THEN g1 WHEN t1 IS NULL THEN g0 ELSE g0 + f * (g1 - g0) END, 6) AS lng FROM f""")
def interp_gps(spark, sf):
    track, frames = track_and_frames(spark, sf)
    return align.interpolate(frames, track, "ts", ["lat", "lng"], ["session"]).select("seq", r6("lat").alias("lat"), r6("lng").alias("lng"))


@query(f"WITH {OBS}, {TRACK}, {BRACKET} SELECT seq, CASE WHEN t0 IS NULL THEN v1 ELSE v0 END AS value FROM b")
def asof_map(spark, sf):
    track, frames = track_and_frames(spark, sf)
    return align.as_of(frames, track, "ts", ["value"], ["session"]).select("seq", "value")


@query(f"WITH {OBS}, {TRACK}, {BRACKET} SELECT seq, CASE WHEN t1 IS NULL OR (t0 IS NOT NULL AND ts - t0 <= t1 - ts) THEN v0 ELSE v1 END AS value FROM b")
def nearest_frame(spark, sf):
    track, frames = track_and_frames(spark, sf)
    return align.nearest(frames, track, "ts", ["value"], ["session"]).select("seq", "value")


@query(f"""WITH {OBS}, s AS (SELECT seq, floor((ts - {T0}) / 3600e0)::BIGINT AS segment FROM o), g AS (SELECT seq, segment, segment // 24 AS row, segment % 24 AS col FROM s)
SELECT seq, segment, round(row * 1e-2, 6) AS lat, round((CASE WHEN row % 2 = 1 THEN 23 - col ELSE col END) * 1e-2, 6) AS lng FROM g""")
def snake_grid(spark, sf):
    segment, lat, lng = scalars.snake_grid(F.col("ts") - T0, 3600.0, 24, 1e-2)
    return data.observations(spark, sf).select("seq", segment.alias("segment"), r6(lat).alias("lat"), r6(lng).alias("lng"))


@query(f"""WITH {OBS}, m AS (SELECT *, avg(lat) OVER () AS a0, avg(lng) OVER () AS g0, count(*) OVER () AS n FROM o),
x AS (SELECT *, (lng - g0) * {cells.DEG!r}::DOUBLE * {cells.EARTH_M} * cos(a0 * {cells.DEG!r}::DOUBLE) AS x, (lat - a0) * {cells.DEG!r}::DOUBLE * {cells.EARTH_M} AS y FROM m),
t AS (SELECT *, cos(pi() / 6) * x - sin(pi() / 6) * y + 100 AS x1, sin(pi() / 6) * x + cos(pi() / 6) * y - 50 AS y1 FROM x),
z AS (SELECT row_number() OVER (ORDER BY seq) - 1 AS i, n, seq, round(a0 + y1 / ({cells.DEG!r}::DOUBLE * {cells.EARTH_M}), 6) AS lat, round(g0 + x1 / ({cells.DEG!r}::DOUBLE * {cells.EARTH_M} * cos(a0 * {cells.DEG!r}::DOUBLE)), 6) AS lng FROM t)
SELECT a.seq, b.lat, b.lng FROM z a JOIN z b ON a.i = (b.i + round_even(0.25 * b.n, 0)::BIGINT) % b.n""")
def coord_transform(spark, sf):
    from ..operators.geo import transform_coordinates

    out = transform_coordinates(data.observations(spark, sf).select("seq", "lat", "lng"), "seq", 100.0, -50.0, 30.0, 0.25)
    return out.select("seq", r6("lat").alias("lat"), r6("lng").alias("lng"))


@query(f"WITH {OBS} SELECT seq, round((value - 5) / 111320e0 + 37, 9) AS lat, round((value * 2) / (111320e0 * cos(37e0 * {cells.DEG!r}::DOUBLE)) - 122, 9) AS lng FROM o")
def project_xy(spark, sf):
    lat, lng = scalars.metres_to_degrees(F.col("value") * 2, F.col("value") - 5, 37.0, -122.0)
    return data.observations(spark, sf).select("seq", F.round(lat, 9).alias("lat"), F.round(lng, 9).alias("lng"))


# scoring

IOU = lambda a, b: f"(CASE WHEN ({b}) - ({a}) + (gt.b - gt.a) - greatest(0, least({b}, gt.b) - greatest({a}, gt.a)) > 0 THEN greatest(0, least({b}, gt.b) - greatest({a}, gt.a)) / (({b}) - ({a}) + (gt.b - gt.a) - greatest(0, least({b}, gt.b) - greatest({a}, gt.a))) ELSE 0 END)"  # noqa: E731, E501
SCORE = f"""{GT}, scored AS (SELECT p.qid, rank, cell, coalesce(max({IOU("coalesce(t_min, exemplar_t)", "coalesce(t_max, exemplar_t)")}), 0) AS bucket_iou,
  coalesce(max({IOU("exemplar_t - 1.5", "exemplar_t + 1.5")}), 0) AS exemplar_iou, coalesce(bool_or(exemplar_t BETWEEN gt.a AND gt.b), false) AS exemplar_hit FROM preds p LEFT JOIN gt ON gt.qid = p.qid GROUP BY p.qid, rank, cell)"""
SUMMARY = f"""{SCORE}, sm AS (SELECT que.qid, category, coalesce(max(CASE WHEN rank = 1 THEN bucket_iou END), 0) AS top1_iou, coalesce(max(bucket_iou), 0) AS max_iou, coalesce(max(exemplar_iou), 0) AS max_exemplar_iou,
  coalesce(bool_or(exemplar_hit), false) AS hit, count(DISTINCT cell) AS cells, coalesce(max(bucket_iou), 0) >= 0.3 AS bucket_hit FROM que LEFT JOIN scored USING (qid) GROUP BY que.qid, category)"""


def scored(spark, sf):
    return score.score_predictions(recalled(spark, sf), data.ground_truth(spark, sf))


def summary(spark, sf):
    return score.summarize_questions(scored(spark, sf), data.questions(spark, sf).select("qid", "category"))


@query(f"""WITH {OBS}, {VEC}, {GT}, p AS (SELECT qid, a - 1800 AS x, b - 1800 AS y FROM gt)
SELECT p.qid, round(p.x, 6) AS start, round(max({IOU("p.x", "p.y")}), 6) AS iou FROM p JOIN gt ON gt.qid = p.qid GROUP BY p.qid, p.x""")
def interval_iou(spark, sf):
    gt = data.ground_truth(spark, sf)
    p = gt.select("qid", (F.col("start") - 1800).alias("x"), (F.col("end") - 1800).alias("y"))
    return score.best_iou(p, gt, 7200.0).groupBy("qid", "x").agg(r6(F.max("iou")).alias("iou")).select("qid", r6("x").alias("start"), "iou")


@query(f"{recall_sql()}, {SUMMARY} SELECT qid, round(top1_iou, 6) AS top1_iou, round(max_iou, 6) AS max_iou, round(max_exemplar_iou, 6) AS max_exemplar_iou, hit, cells, bucket_hit FROM sm")
def score_questions(spark, sf):
    return summary(spark, sf).select("qid", r6("top1_iou").alias("top1_iou"), r6("max_iou").alias("max_iou"), r6("max_exemplar_iou").alias("max_exemplar_iou"), "hit", "cells", "bucket_hit")


@query(f"{recall_sql()}, {SUMMARY} SELECT category, count(*) AS n, round(avg(top1_iou), 6) AS mean_top1_iou, round(avg(max_iou), 6) AS mean_max_iou, round(avg(hit::INT), 6) AS hit_rate, round(avg(bucket_hit::INT), 6) AS bucket_hit_rate FROM sm GROUP BY category")
def by_category(spark, sf):
    out = score.by_category(summary(spark, sf), ["category"])
    return out.select("category", "n", *(r6(c).alias(c) for c in out.columns[2:]))


@query(f"""WITH {OBS}, {VEC}, {GT}, f AS (SELECT seq, ts, {cell_sql()} AS cell FROM o), fn AS (SELECT max(ts) - {T0} AS e, count(*) AS n FROM o),
ins AS (SELECT DISTINCT qid, seq, cell FROM f JOIN gt ON ts BETWEEN a AND b), vo AS (SELECT qid, cell, count(*) AS n, min(seq) AS first FROM ins GROUP BY ALL),
mo AS (SELECT qid, cell, sum(n) OVER (PARTITION BY qid) AS support, row_number() OVER (PARTITION BY qid ORDER BY n DESC, first) AS k FROM vo),
ep AS (SELECT cell, count(*) AS size, 1 + sum(new) AS visits FROM (SELECT cell, coalesce((ts - lag(ts) OVER (PARTITION BY cell ORDER BY ts, seq) > 1800)::INT, 0) AS new FROM f) GROUP BY cell),
sp AS (SELECT qid, avg((a + b) / 2) - {T0} AS mid, max(b) - {T0} AS last_end, min(a) - {T0} AS first_start FROM gt GROUP BY qid),
st AS (SELECT sp.qid, mo.cell AS target_cell, support, size / n::DOUBLE AS exposure, visits, (e - mid) / e AS age, last_end <= 0.5 * e AS old_event, first_start >= 0.75 * e AS recent_event FROM sp JOIN mo ON mo.qid = sp.qid AND k = 1 JOIN ep ON ep.cell = mo.cell, fn)
SELECT qid, target_cell, support::BIGINT AS support, round(exposure, 6) AS exposure, visits::BIGINT AS visits, round(age, 6) AS normalized_age, old_event, recent_event,
  exposure <= (SELECT quantile_cont(exposure, 0.25) FROM st) AS rare_place, exposure >= (SELECT quantile_cont(exposure, 0.75) FROM st) AS common_place, visits >= 2 AS revisited_place FROM st""")
def question_strata(spark, sf):
    gt = data.ground_truth(spark, sf).select("qid", (F.col("start") - T0).alias("start"), (F.col("end") - T0).alias("end"))
    o = data.observations(spark, sf)
    frames = o.select("seq", (F.col("ts") - T0).alias("ts"), data.GRID.encode(F.col("lat"), F.col("lng"), CFG.resolution).alias("cell"))
    return score.question_strata(gt, frames, 1800.0, 7200.0).withColumn("exposure", r6("exposure")).withColumn("normalized_age", r6("normalized_age"))


@query(f"{recall_sql()}, {SUMMARY} SELECT count(*) AS n, round(avg((cells = 1 + category % 5)::INT), 6) AS exact_rate, round(avg(abs(cells - (1 + category % 5))), 6) AS mae FROM sm")
def count_questions(spark, sf):
    out = score.count_metrics(summary(spark, sf).withColumn("expected", 1 + F.col("category") % 5), "expected")
    return out.select("n", r6("exact_rate").alias("exact_rate"), r6("mae").alias("mae"))


@query(f"WITH {mem_sql()}, {BANK}, {VEC}, {GT} SELECT qid, bool_or(coalesce(bank.ts IS NOT NULL, false)) AS oracle_hit FROM gt LEFT JOIN bank ON ts BETWEEN a AND b GROUP BY qid")
def oracle_hit(spark, sf):
    kept = memory.exemplars(data.memory(spark, sf)).select("ts")
    return score.oracle_hits(kept, data.ground_truth(spark, sf), 7200.0)
