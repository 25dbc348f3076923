"""Queries: parsers and small functions, payloads, decimation, windows and bins by similarity, comparisons of runs, controls."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import codec, scalars
from ..operators import align, cluster, geo, memory, retention, score, sketch, stats
from ..scratch import shared_path
from ..sources import annotations, groups, sinks, tracks
from ..streaming.slots import as_of_replay
from . import core, data
from .analytics import ALPHA, FRAMES, HLL_M, REG, RUNS, SEED, frames, key, runs
from .core import SUMMARY, T0, r6
from .data import BANK, CFG, COS, OBS, QUE, VEC, cell_sql, disk_sql, hash_sql, mem_sql
from .registry import query

# scalars


@query("SELECT event_id AS seq, round(CASE WHEN abs(a) <= pi() THEN a ELSE a - 2 * pi() * round_even(a / (2 * pi()), 0) END, 6) AS angle FROM (SELECT event_id, value / 5 - 10 AS a FROM events)")
def wrap_angle(spark, sf):
    return data.table(spark, sf, "events").select(F.col("event_id").alias("seq"), r6(scalars.wrap_angle(F.col("value") / 5 - 10)).alias("angle"))


@query(f"WITH {VEC}, z AS (SELECT vec_id, list_transform(vec, lambda x: CASE WHEN vec_id % 10 = 0 THEN 0 ELSE x END) AS v FROM vec) SELECT vec_id, round(CASE WHEN vec_id % 10 = 0 THEN 0 ELSE v[1] / sqrt(list_dot_product(v, v)) END, 6) AS x, CASE WHEN vec_id % 10 = 0 THEN 0 ELSE 1 END::DOUBLE AS norm FROM z")
def l2_normalize(spark, sf):
    """Zero vectors stay zero."""
    v = data.vectors(spark, sf).select("vec_id", F.when(F.col("vec_id") % 10 == 0, F.transform("vec", lambda x: x * 0)).otherwise(F.col("vec")).alias("v"))
    u = v.select("vec_id", scalars.normalize(F.col("v")).alias("u"))
    return u.select("vec_id", r6(F.col("u")[0]).alias("x"), r6(scalars.norm(F.col("u"))).alias("norm"))


@query("SELECT event_id AS seq, round(CASE WHEN event_id % 9 = 0 THEN 0 ELSE (event_id % 7 - least(value, event_id % 7, -1)) / (greatest(value, event_id % 7, -1) - least(value, event_id % 7, -1)) END, 6)::DOUBLE AS x FROM events")
def map_min_max(spark, sf):
    """A map without range is all zero."""
    s = F.col("event_id")
    values = F.when(s % 9 == 0, F.array(F.lit(3.0), F.lit(3.0))).otherwise(F.array((s % 7).cast("double"), F.col("value"), F.lit(-1.0)))
    return data.table(spark, sf, "events").select(s.alias("seq"), r6(scalars.min_max_map(values)[0]).alias("x"))


@query(f"WITH {OBS} SELECT seq, CASE WHEN seq % 8 <> 0 THEN (floor(ts / 60e0) * 60)::BIGINT END AS epoch, CASE WHEN seq % 9 = 0 THEN 0 ELSE round(floor(ts) - floor(ts / 60e0) * 60, 3) END::DOUBLE AS skew FROM o")
def parse_times(spark, sf):
    """Drive ids, and the lag of a first fix behind a video's name; what can't be read is null, or no lag."""
    o = data.observations(spark, sf).withColumn("t", F.timestamp_seconds(F.floor("ts")))
    drive = F.when(F.col("seq") % 8 == 0, "2024x").otherwise(F.date_format("t", "yyyyMMddHHmm"))
    name = F.when(F.col("seq") % 9 == 0, "video.mp4").otherwise(F.concat(F.date_format("t", "yyyy-MM-dd-HH-mm"), F.lit("-00_center.mp4")))
    iso = F.concat(F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("seq") % 2 == 0, "Z").otherwise(""))
    return o.select("seq", scalars.drive_id_epoch(drive).alias("epoch"), F.round(scalars.video_skew(name, iso), 3).alias("skew"))


@query("""WITH t AS (SELECT event_id AS seq, value AS v, CASE event_id % 4 WHEN 0 THEN event_id::VARCHAR WHEN 1 THEN event_id || ' ' WHEN 2 THEN event_id || 'x' ELSE '-' || event_id END AS i FROM events)
SELECT seq, CASE WHEN seq % 4 = 0 AND seq <= 5000 THEN seq WHEN seq % 4 = 3 AND seq <= 100 THEN -seq END AS number, CASE WHEN seq % 3 <> 0 THEN 3 ELSE NULL END::BIGINT AS listed, CASE WHEN seq % 5 <> 0 AND v / 2 <= 90 THEN round(v / 2, 6) END AS lat, CASE WHEN seq % 12 BETWEEN 1 AND 6 THEN seq % 12 END::INT AS choice FROM t""")
def parse_numbers(spark, sf):
    """Whole numbers in a range, lists with commas, coordinate pairs, the first choice of 1 to 6 in an answer."""
    s, v = F.col("event_id"), F.col("value")
    text = F.element_at(F.array(s.cast("string"), F.concat(s, F.lit(" ")), F.concat(s, F.lit("x")), F.concat(F.lit("-"), s)), (s % 4 + 1).cast("int"))
    text = F.when(s % 4 == 1, F.concat(s, F.lit(" y"))).otherwise(text)
    listed = F.size(scalars.number_list(F.when(s % 3 == 0, "1,x,2").otherwise("1, 2.5,,3")))
    pair = scalars.lat_lng_pair(F.when(s % 5 == 0, F.concat(v, F.lit(","))).otherwise(F.concat_ws(",", v / 2, F.lit("20"))))
    choice = scalars.first_choice(F.concat(F.lit("I'd take 0 or "), (s % 12).cast("string"), F.lit(", not 99")), 6)
    return data.table(spark, sf, "events").select(s.alias("seq"), scalars.int_in(text, -100, 5000).alias("number"), F.when(listed >= 0, listed).cast("long").alias("listed"), r6(pair["lat"]).alias("lat"), choice.alias("choice"))


# payloads


@query(f"WITH s(codec, size) AS (VALUES ('raw', 256), ('2b', {16 + 16 + 1}), ('3b', {16 + 24 + 1}), ('4b', {16 + 32 + 1})) SELECT codec, size::BIGINT AS size, (SELECT count(*) FROM embeddings) AS n, (10000 // size)::BIGINT AS frames FROM s")
def payload_bytes(spark, sf):
    """Payload sizes by codec, and the frames that a number of bytes holds."""
    v = data.vectors(spark, sf)
    parts = [v.select(F.lit(c).alias("codec"), F.octet_length(codec.encode_column(F.col("vec"), c)).cast("long").alias("size")) for c in ("raw", "2b", "3b", "4b")]
    sizes = parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3]).groupBy("codec", "size").agg(F.count(F.lit(1)).alias("n"))
    frames = F.coalesce(*[F.when(F.col("codec") == c, retention.reservoir_bytes(10_000, codec.payload_size(c, 64))) for c in ("raw", "2b", "3b", "4b")])
    return sizes.select("codec", "size", "n", frames.cast("long").alias("frames"))


@query("SELECT vec_id, vec_id % 10 > 3 AS scored FROM embeddings")
def payload_guard(spark, sf):
    """Payloads that are cut short, of another codec, of another width or null aren't scored."""
    import numpy as np

    i = F.col("vec_id") % 10
    v = data.vectors(spark, sf)
    p = codec.encode_column(F.col("vec"), "4b")
    p = F.when(i == 0, p.substr(1, 40)).when(i == 1, codec.encode_column(F.col("vec"), "3b")).when(i == 2, codec.encode_column(F.slice("vec", 1, 32), "4b")).when(i > 3, p)
    return v.select("vec_id", codec.score_column(p, "4b", np.ones((1, 64))).isNotNull().alias("scored"))


# records


@query("SELECT user_id, event_type, event_id AS seq FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events) WHERE k = 1")
def keep_first(spark, sf):
    return annotations.first_of(data.table(spark, sf, "events"), ["user_id", "event_type"], [F.col("event_id")]).select("user_id", "event_type", F.col("event_id").alias("seq"))


@query(f"WITH RECURSIVE {OBS}, r AS (SELECT session, min(ts) AS ts FROM o GROUP BY session UNION ALL SELECT r.session, min(o.ts) FROM r JOIN o ON o.session = r.session AND o.ts - r.ts >= 172800 GROUP BY r.session, r.ts) SELECT r.session, min(o.seq) AS seq FROM r JOIN o ON o.session = r.session AND o.ts = r.ts GROUP BY r.session, r.ts")
def decimate_greedy(spark, sf):
    """Frames at least two days after the last kept one."""
    o = data.observations(spark, sf).select("session", "seq", "ts")
    return align.decimate_greedy(o, "ts", "ts", 172800.0, "session").select("session", "seq")


@query(f"WITH {mem_sql()}, {BANK}, {VEC}, {QUE}, per AS (SELECT cell, least(count(*), 2) AS n FROM bank GROUP BY cell), {disk_sql('near', '(SELECT qid, ' + cell_sql() + ' AS c FROM que)', 'qid', 2)}, k AS (SELECT qid, sum(n) AS n FROM near JOIN per USING (cell) GROUP BY qid) SELECT qid, (SELECT sum(n) FROM per)::BIGINT AS total_global, coalesce(k.n, 0)::BIGINT AS total_near FROM que LEFT JOIN k USING (qid)")
def probe_counts(spark, sf):
    """How many hits there are, without scoring any: of all cells, and of those within two steps."""
    mem, bank, q = data.memory(spark, sf), memory.exemplars(data.memory(spark, sf)), data.questions(spark, sf)
    whole = memory.probe(mem, bank, q, 2).withColumnRenamed("total_found", "total_global")
    return whole.join(memory.probe(mem, bank, q, 2, k=2).withColumnRenamed("total_found", "total_near"), "qid").select("qid", "total_global", "total_near")


# windows and bins by similarity


def top3(spark, sf, units, order):
    best = memory.best_hits(units, data.questions(spark, sf).select("qid", "qvec"), 3, order)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("sim"), order))
    return best.withColumn("rank", rank).filter(F.col("rank") <= 3).select("qid", "rank", order, r6("sim").alias("sim"))


@query(f"""WITH {OBS}, {VEC}, {QUE}, w AS (SELECT floor((ts - {T0}) / 43200e0)::BIGINT AS k, ts, vec FROM o JOIN vec ON seq % nvec = vec_id), x AS (SELECT k AS win, vec FROM w UNION ALL SELECT k - 1, vec FROM w WHERE k > 0),
m AS (SELECT win, i, avg(v) AS v FROM (SELECT win, unnest(range(1, 65)) AS i, unnest(vec) AS v FROM x) GROUP BY ALL), p AS (SELECT win, list(v ORDER BY i) AS vec FROM m GROUP BY win), s AS (SELECT qid, win, {COS} AS sim FROM p, que)
SELECT qid, rank, win, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, win) AS rank FROM s) WHERE rank <= 3""")
def topk_windows(spark, sf):
    """The best three windows of a day, every half day, by their mean vectors."""
    rows = data.with_vectors(data.observations(spark, sf).select("seq", "ts"), spark, sf)
    k = F.floor((F.col("ts") - T0) / 43200.0)
    # rows of half a day are added up before they go to the two windows that hold them
    half = rows.groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(F.col("vec")[i].cast("double")) for i in range(64)]).alias("s"))
    wide = half.select("n", "s", F.explode(F.array(F.col("k") - 1, F.col("k"))).alias("win")).filter("win >= 0")
    return top3(spark, sf, wide.groupBy("win").agg(F.array(*[F.sum(F.col("s")[i]) / F.sum("n") for i in range(64)]).alias("vec")), "win")


@query(f"""WITH {OBS}, {VEC}, {QUE}, b AS (SELECT *, floor(ts / 21600e0)::BIGINT AS bin FROM o), f AS (SELECT bin, seq FROM (SELECT bin, seq, row_number() OVER (PARTITION BY bin ORDER BY round(abs(ts - (bin + 0.5e0) * 21600e0), 6), seq) AS k FROM b) WHERE k = 1),
s AS (SELECT qid, bin, {COS} AS sim FROM f JOIN vec ON seq % nvec = vec_id, que) SELECT qid, rank, bin, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, bin) AS rank FROM s) WHERE rank <= 3""")
def topk_bins(spark, sf):
    """The best three bins of six hours, by the frame nearest to their middle."""
    from .core import uniform_bins

    return top3(spark, sf, data.with_vectors(uniform_bins(spark, sf), spark, sf).select("bin", "vec"), "bin")


EST2 = lambda k, p: f"CASE WHEN {ALPHA!r}::DOUBLE / ({p} + ({HLL_M} - {k})) <= {2.5 * HLL_M} AND {k} < {HLL_M} THEN {HLL_M} * ln({HLL_M}::DOUBLE / ({HLL_M} - {k})) ELSE {ALPHA!r}::DOUBLE / ({p} + ({HLL_M} - {k})) END"
GRID_SEC, RING = 172800, 3


@query(f"""WITH {OBS}, {REG}, c AS (SELECT *, {cell_sql(res=7)} AS cell, floor(ts / 86400e0)::BIGINT AS b FROM g), top AS (SELECT cell FROM c GROUP BY cell ORDER BY count(*) DESC, cell LIMIT 5), x AS (SELECT cell, ts, j, rho, b FROM c JOIN top USING (cell)),
tk AS (SELECT DISTINCT cell, ts FROM (SELECT cell, ts FROM x WHERE floor(ts)::BIGINT % 5 = 0 UNION ALL SELECT cell, ({T0} + i * {GRID_SEC})::DOUBLE FROM top, (SELECT unnest(range(0, 20)) AS i))),
pr AS (SELECT tk.cell, tk.ts, j, max(rho) AS a, max(CASE WHEN x.b > floor(tk.ts / 86400e0) - {RING} THEN rho END) AS w FROM tk JOIN x ON x.cell = tk.cell AND x.ts <= tk.ts GROUP BY ALL),
n AS (SELECT tk.cell, tk.ts, count(x.ts) AS n_obs FROM tk LEFT JOIN x ON x.cell = tk.cell AND x.ts <= tk.ts GROUP BY ALL),
e AS (SELECT cell, ts, count(a) AS ka, sum(pow(2e0, -a)) AS pa, count(w) AS kw, coalesce(sum(pow(2e0, -w)), 0) AS pw FROM pr GROUP BY ALL)
SELECT cell, round(ts, 4) AS ts, n_obs, CASE WHEN ka IS NULL THEN 0 ELSE round({EST2("ka", "pa")}, 6) END AS accrued, CASE WHEN ka IS NULL THEN 0 ELSE round({EST2("kw", "pw")}, 6) END AS windowed FROM n LEFT JOIN e USING (cell, ts)""")
def hll_time_grid(spark, sf):
    """Distinct items of the five busiest coarse cells, so far and over three days, on a time grid and at observed instants: the window decays in gaps."""
    o = data.observations(spark, sf).filter("item is not null").select("ts", scalars.hash60(F.col("item")).alias("h"), data.GRID.encode(F.col("lat"), F.col("lng"), 7).alias("cell"))
    top = o.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "cell").limit(5).select("cell")
    own = o.join(F.broadcast(top), "cell")
    grid = top.select("cell", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("i")).select("cell", (F.lit(T0) + F.col("i") * GRID_SEC).alias("ts"))
    ticks = grid.unionAll(own.filter(F.floor("ts") % 5 == 0).select("cell", "ts"))
    out = sketch.over_time(own, ticks, "cell", "h", CFG.precision, 86400.0, RING)
    return out.select("cell", F.round("ts", 4).alias("ts"), "n_obs", r6("accrued").alias("accrued"), r6("windowed").alias("windowed"))


# comparisons of runs


@query(f"WITH {RUNS}, s AS (SELECT method, res, session, seed, avg(rate) AS v FROM ru GROUP BY ALL), e AS (SELECT method, res, session, avg(v) AS v FROM s GROUP BY ALL) SELECT method, res, count(*) AS n, round(avg(v), 8) AS mean FROM e GROUP BY method, res")
def budget_means(spark, sf):
    """Method, budget, session: means over seeds, then over sessions."""
    out = stats.nested_mean(runs(spark, sf).withColumn("k", F.col("id")), ["method", "res", "session", "seed", "k"], "rate", 2)
    return out.select("method", "res", "n", F.round("mean", 8).alias("mean"))


@query(f"WITH {RUNS}, a AS (SELECT session, avg(rate) AS v FROM ru WHERE method = 'view' GROUP BY session), b AS (SELECT session, avg(rate) AS v FROM ru WHERE method = 'click' GROUP BY session) SELECT session, round(a.v - b.v, 6) AS diff FROM a JOIN b USING (session)")
def checked_pairs(spark, sf):
    """Sessions of two methods, paired after their settings are checked."""
    a, b = (runs(spark, sf).filter(F.col("method") == m).select("session", (F.col("session") % 5).alias("config"), F.col("rate").alias("value")) for m in ("view", "click"))
    return stats.check_pairs(a, b, "session", ["config"], allow_unpaired=True).select("session", r6(F.col("value_a") - F.col("value_b")).alias("diff"))


WIDE = SUMMARY.replace("exemplar_t - 1.5", "exemplar_t - 900").replace("exemplar_t + 1.5", "exemplar_t + 900")


@query(f"{core.recall_sql()}, {WIDE} SELECT qid, round(max_exemplar_iou, 6) AS max_exemplar_iou, hit FROM sm")
def rescored(spark, sf):
    """Captured predictions, loaded under an older column name and scored again with another tolerance."""
    path = shared_path(spark, "captures")
    core.recalled(spark, sf).withColumnRenamed("exemplar_t", "t").write.json(path)
    names = {"qid": [], "rank": [], "cell": [], "exemplar_t": ["t"], "t_min": [], "t_max": []}
    back = spark.read.schema("qid long, rank int, cell long, t double, t_min double, t_max double").json(path)
    preds = sinks.read_captures(back, names)
    out = score.summarize_questions(score.score_predictions(preds, data.ground_truth(spark, sf), 900.0), data.questions(spark, sf).select("qid", "category"))
    return out.select("qid", r6("max_exemplar_iou").alias("max_exemplar_iou"), "hit")


@query("SELECT (row_number() OVER (ORDER BY i, j) - 1)::BIGINT AS run, a AS resolution, b AS codec FROM (VALUES (0, 9), (1, 10), (2, 11)) x(i, a), (VALUES (0, 'raw'), (1, '4b')) y(j, b)")
def sweep_grid(spark, sf):
    return stats.grid(spark, resolution=[9, 10, 11], codec=["raw", "4b"]).select(F.col("run").cast("long").alias("run"), F.col("resolution").cast("int").alias("resolution"), "codec")


# controls


@query(f"WITH l AS (SELECT vec_id AS seq, label, row_number() OVER (ORDER BY vec_id) AS i, row_number() OVER (ORDER BY {hash_sql(f'''concat_ws(':', {SEED}, vec_id)''')}) AS k FROM embeddings) SELECT a.seq, b.label FROM l a JOIN l b ON a.i = b.k")
def shuffled_labels(spark, sf):
    """Labels dealt anew at random."""
    return cluster.shuffled(data.vectors(spark, sf).select(F.col("vec_id").alias("seq"), "label"), "label", "seq", SEED).select("seq", "label")


@query(f"WITH {FRAMES}, p AS (SELECT *, row_number() OVER (ORDER BY seq) AS i, row_number() OVER (ORDER BY {key('seq')}) AS k FROM o) SELECT a.seq, round(b.lat, 6) AS lat, round(b.lng, 6) AS lng FROM p a JOIN p b ON a.i = b.k")
def permuted_coordinates(spark, sf):
    """Places dealt anew at random: a null control."""
    from ..operators.geo import transform_coordinates

    out = transform_coordinates(data.observations(spark, sf).select("seq", "lat", "lng"), "seq", permute_seed=SEED)
    return out.select("seq", r6("lat").alias("lat"), r6("lng").alias("lng"))


# tracks, draws and replays


@query(f"WITH {OBS}, x AS (SELECT session, floor(ts)::BIGINT AS s, lat, lng FROM o WHERE seq % 20 <> 0 AND seq % 21 <> 0) SELECT session, s::DOUBLE AS ts, round(p.lat, 6) AS lat, round(p.lng, 6) AS lng FROM (SELECT session, s, min({{'lat': lat, 'lng': lng}}) AS p FROM x GROUP BY session, s)")
def clean_fixes(spark, sf):
    """Fixes of a device with a clock in nanoseconds: out of range, not finite or repeated ones go."""
    s = F.col("seq")
    o = data.observations(spark, sf).select("session", (F.floor("ts") * 1_000_000_000).alias("ns"), F.when(s % 20 == 0, 91.0).when(s % 21 == 0, float("nan")).otherwise(F.col("lat")).alias("lat"), "lng")
    return tracks.clean_fixes(o, "session").select("session", "ts", r6("lat").alias("lat"), r6("lng").alias("lng"))


@query(f"WITH {OBS}, d AS (SELECT seq, coalesce(lead(lng) OVER w, lng) - coalesce(lag(lng) OVER w, lng) AS dx, coalesce(lead(lat) OVER w, lat) - coalesce(lag(lat) OVER w, lat) AS dy FROM o WINDOW w AS (PARTITION BY session ORDER BY ts, seq)) SELECT seq, round(CASE WHEN dx = 0 AND dy = 0 THEN 0 ELSE -dy / sqrt(dx * dx + dy * dy) END, 6) AS nx, round(CASE WHEN dx = 0 AND dy = 0 THEN 0 ELSE dx / sqrt(dx * dx + dy * dy) END, 6) AS ny FROM d")
def track_normals(spark, sf):
    return geo.normals(data.observations(spark, sf), ["session"]).select("seq", r6("nx").alias("nx"), r6("ny").alias("ny"))


@query(f"WITH {FRAMES}, c AS (SELECT DISTINCT cell, (cell & {(1 << 28) - 1}) - {1 << 27} AS r FROM f) SELECT cell, dense_rank() OVER (ORDER BY r DESC) AS layer FROM c")
def draw_order(spark, sf):
    """Cells from north to south: rows of one latitude are one layer."""
    own = frames(spark, sf).select("cell").distinct()
    lat = F.round(data.GRID.center(F.col("cell"), CFG.resolution)[0], 9)
    layers = own.select(lat.alias("lat")).distinct().withColumn("layer", F.row_number().over(Window.orderBy(F.desc("lat"))))
    return own.withColumn("lat", lat).join(layers, "lat").select("cell", F.col("layer").cast("long").alias("layer"))


CLOCK = 1705500000
PAST = mem_sql().replace("FROM events)", f"FROM events WHERE epoch_us(ts) / 1e6 <= {CLOCK})")


@query(f"WITH {PAST}, {data.agg_sql('a', data.LIVE)}, t AS (SELECT cell, count(*) AS seen FROM v GROUP BY cell) SELECT cell, seen, round(coalesce(a.n, 0), 6) AS total FROM t LEFT JOIN a USING (cell)")
def replay_to_clock(spark, sf):
    """The memory as it was at a clock: seeking backwards builds it anew from what had come by then."""
    mem = memory.observe(as_of_replay(data.observations(spark, sf), "ts", float(CLOCK)), CFG, data.GRID)
    return memory.tile_summary(mem).select("cell", "seen", r6("total").alias("total"))


@query(f"{core.recall_sql()}, x AS (SELECT *, CASE WHEN qid % 40 = 0 THEN 2 WHEN qid % 60 = 0 THEN 4 END AS pick FROM preds) SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN rank = pick THEN 0 ELSE 1 END, rank) AS rank, cell FROM x")
def rerank_answers(spark, sf):
    """Hits in the order of a scorer's answers; refusals and numbers that weren't shown change nothing."""
    q = F.col("qid")
    answer = F.when(q % 40 == 0, "Frame 2 of 5, I think").when(q % 60 == 0, "99? no: 4").when(q % 100 == 0, "7").otherwise("I can't help with that.")
    return sinks.rerank(core.recalled(spark, sf), data.questions(spark, sf).select("qid", answer.alias("answer")), 5).select("qid", "rank", "cell")


OTHER = core.recall_sql().replace("vec AS qvec", "list_reverse(vec) AS qvec")


@query(f"{OTHER} SELECT qid, rank, cell, sim, exemplar_t FROM preds")
def alternate_encoder(spark, sf):
    """The same bank asked by vectors of another encoder (a stand-in: components reversed)."""
    q = data.questions(spark, sf).withColumn("qvec", F.reverse("qvec"))
    return memory.recall(data.memory(spark, sf), core.bank(spark, sf), q, 5).select("qid", "rank", "cell", "sim", "exemplar_t")


@query("SELECT user_id AS session, sha256(string_agg(event_id::VARCHAR || chr(10), '' ORDER BY event_id)) AS sha256 FROM events GROUP BY user_id")
def provenance(spark, sf):
    """The hashes of a run's inputs; a run whose inputs are the same may be resumed."""
    ids = data.table(spark, sf, "events").groupBy(F.col("user_id").alias("session")).agg(F.array_join(F.sort_array(F.collect_list("event_id")), "\n").alias("value"))
    path = shared_path(spark, "inputs")
    ids.repartition("session").write.partitionBy("session").text(path)
    files = [f"{path}/session=*/*.txt"]
    found = groups.fingerprint(spark, files)
    groups.check_resume(found, groups.fingerprint(spark, files))
    return found.select(F.regexp_extract("path", "session=([0-9]+)", 1).cast("int").alias("session"), "sha256")
