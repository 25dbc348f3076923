import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayhex.functions import codec, scalars
from wayhex.operators import align, cluster, geo, motion, retention, score, stats
from wayhex.streaming.slots import arrival_slots, as_of_replay, event_windows


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_scalars(spark):
    c = lambda t: scalars.color_ramp(F.lit(t))
    assert [tuple(round(x, 6) for x in r) for r in one(spark, c(-1.0), c(0.5), c(2.0))] == [(0, 0, 0, 0.7), (0, 1, 0.5, 0.85), (1, 1, 1, 1)]
    kinds = [scalars.motion_class(F.lit(0.0), F.lit(0.0), F.lit(a)) for a in (9.81, 11.0, 14.5)]
    assert one(spark, *kinds) == ("stationary", "walking", "running")
    v = lambda m, d: F.round(scalars.speed(F.lit(m), F.lit(d)), 6)
    assert one(spark, v("stationary", 0.0), v("walking", 0.5), v("walking", 3.0), v("running", 3.0), v("running", 10.0), v("running", 99.0)) == (0, 1.2, 2.5, 2.5, 6, 6)
    assert one(spark, *scalars.slippy_tile(F.lit(37.484), F.lit(-122.148), 10)) == (164, 396)
    assert one(spark, *(scalars.zoom_for(F.lit(x)) for x in (500.0, 5.0, 1e-6, 0.0))) == (0, 6, 19, 18)
    assert [round(x, 6) for x in one(spark, *(scalars.wrap_angle(F.lit(x)) for x in (math.pi + 0.1, -math.pi - 0.1, 0.5)))] == [round(0.1 - math.pi, 6), round(math.pi - 0.1, 6), 0.5]
    assert one(spark, scalars.drive_id_epoch(F.lit("201703061033")), scalars.first_choice(F.lit("frame 12, then 3"), 5), scalars.lat_lng_pair(F.lit("91,0"))) == (1488796380, 3, None)
    assert one(spark, scalars.lat_lng_pair(F.lit("51.5,-0.3")))[0].asDict() == {"lat": 51.5, "lng": -0.3}
    assert one(spark, scalars.normalize(F.array(F.lit(3.0), F.lit(4.0))), scalars.normalize(F.array(F.lit(0.0)))) == ([0.6, 0.8], [0.0])
    assert one(spark, scalars.min_max_map(F.array(F.lit(1.0), F.lit(3.0))), scalars.min_max_map(F.array(F.lit(2.0)))) == ([0, 1], [0])
    assert one(spark, scalars.interval_iou(F.lit(0.0), F.lit(2.0), F.lit(1.0), F.lit(3.0)), scalars.interval_iou(F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(1.0))) == (1 / 3, 0)


def test_snake_grid(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.5, 1.0, 1.5, 2.0, 3.0, 5.0)], "t double")
    _, lat, lng = scalars.snake_grid(F.col("t"), 1.0, 3, 0.01)
    out = {r.t: (round(r.a, 9), round(r.g, 9)) for r in df.select("t", lat.alias("a"), lng.alias("g")).collect()}
    assert out[0.0] == out[0.5] and out[0.0][1] == out[5.0][1] and out[0.0][0] != out[5.0][0] and out[3.0] == (0.01, 0.02)
    with pytest.raises(Exception, match="valid coordinates"):
        df.select(scalars.snake_grid(F.col("t") * 1e6, 1.0, 3, 0.01)[1]).collect()


def test_interpolation_clamps(spark):
    gps = spark.createDataFrame([(10.0, 1.0, 4.0), (12.0, 3.0, 6.0)], "ts double, lat double, lng double")
    at = spark.createDataFrame([(9.0,), (10.0,), (11.0,), (13.0,), (500_000.0,)], "ts double")
    out = align.interpolate(at, gps, "ts", ["lat", "lng"]).orderBy("ts").collect()
    assert [(r.lat, r.lng) for r in out] == [(1, 4), (1, 4), (2, 5), (3, 6), (3, 6)]
    assert [r.lat for r in align.as_of(at, gps, "ts", ["lat"]).orderBy("ts").collect()] == [1, 1, 1, 3, 3]
    assert [r.lat for r in align.nearest(at, gps, "ts", ["lat"]).orderBy("ts").collect()] == [1, 1, 1, 3, 3]
    assert align.interpolate(at, gps.limit(0), "ts", ["lat"]).first()["lat"] is None


def test_brackets_over_chunks(spark):
    r = random.Random(3)
    track = sorted(r.uniform(0, 1000) for _ in range(40))
    ask = [r.uniform(-50, 1050) for _ in range(300)]
    left = spark.createDataFrame([(i % 2, t) for i, t in enumerate(ask)], "k int, ts double")
    right = spark.createDataFrame([(i % 2, t, t) for i, t in enumerate(track)], "k int, ts double, v double")
    for row in align.brackets(left, right, "ts", ["v"], ["k"], chunk_sec=37.0).collect():
        own = [t for i, t in enumerate(track) if i % 2 == row.k]
        assert (row._prev.v if row._prev else None) == max((t for t in own if t <= row.ts), default=None)
        assert (row._next.v if row._next else None) == min((t for t in own if t >= row.ts), default=None)


def test_prefixes_and_decimation(spark):
    left = spark.createDataFrame([("berlin_mitte_1",), ("berlin_2",), ("paris",)], "name string")
    right = spark.createDataFrame([("berlin", 1), ("berlin_mitte", 2), ("rome", 3)], "prefix string, v int")
    assert sorted((r.name, r.v) for r in align.longest_prefix(left, right, "name", "prefix").collect()) == [("berlin_2", 1), ("berlin_mitte_1", 2)]
    df = spark.createDataFrame([(1, i, i * 0.1) for i in range(50)], "k int, seq long, ts double")
    assert align.decimate_stride(df, "ts", "seq", 0.5, ["k"]).count() == 10
    assert [r.seq for r in align.decimate_greedy(df, "ts", "seq", 0.95, "k").orderBy("seq").collect()] == [0, 10, 20, 30, 40]


def frames(spark, n=400, cells=9):
    r = random.Random(5)
    return spark.createDataFrame([(1, i, float(i * 7), min(int(r.expovariate(0.5)), cells)) for i in range(n)], "session int, seq long, ts double, cell long")


def test_policies_keep_exactly_the_budget(spark):
    f = frames(spark)
    for budget in (1, 16, 100, 1000):
        want = min(budget, 400)
        picks = [retention.fifo(f, budget), retention.global_reservoir(f, budget), retention.hybrid(f, budget), retention.uniform_time(f, budget), retention.cell_balanced(f, budget), retention.visit_balanced(f, budget, 30.0), retention.spatial_priority(f, budget)]
        assert [p.select("seq").distinct().count() for p in picks] == [want] * 7
    assert sorted(r.seq for r in retention.fifo(f, 3).collect()) == [397, 398, 399]


def test_water_filling(spark):
    f = frames(spark)
    sizes = {r["cell"]: r["count"] for r in f.groupBy("cell").count().collect()}
    level = 1
    while sum(min(s, level + 1) for s in sizes.values()) <= 100:
        level += 1
    got = {r["cell"]: r["count"] for r in retention.cell_balanced(f, 100).groupBy("cell").count().collect()}
    assert all(min(s, level) <= got[c] <= min(s, level + 1) for c, s in sizes.items())
    even = {r["cell"]: r["count"] for r in retention.spatial_priority(f, 40).groupBy("cell").count().collect()}
    assert max(even.values()) <= 3 * (40 // len(sizes) + 1)


def test_kcenter_is_farthest_first(spark):
    r = np.random.default_rng(1)
    v = r.normal(size=(60, 5))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "seq long, vec array<double>")
    picks = [x.seq for x in retention.kcenter(df, 8).orderBy("pick").collect()]
    for k in range(1, 8):
        sim = (v @ v[picks[:k]].T).max(axis=1)
        sim[picks[:k]] = np.inf
        assert picks[k] == int(sim.argmin())


def test_codec():
    r = np.random.default_rng(7)
    v = r.normal(size=(20, 768))
    for name, least in (("raw", 0.999999), ("4b", 0.98), ("3b", 0.95), ("2b", 0.80)):
        payloads = codec.encode(v, name)
        assert {len(p) for p in payloads} == {codec.payload_size(name, 768)}
        score = codec.scorer(v)
        assert all(score(p, name)[i] > least for i, p in enumerate(payloads))
    assert (codec.payload_size("raw", 768), codec.payload_size("4b", 768)) == (3072, 529)
    assert [codec.payload_size(c, 1280) for c in ("raw", "4b", "3b", "2b")] == [5120, 1041, 785, 529]
    q = r.normal(size=256)
    bank = r.normal(size=(32, 256))
    bank[0] = 0.9 * q + 0.1 * r.normal(size=256)
    for name in ("2b", "3b", "4b"):
        sims = [codec.scorer(q[None])(p, name)[0] for p in codec.encode(bank, name)]
        assert int(np.argmax(sims)) == 0
    assert codec.scorer(q[None])(codec.encode(v, "4b")[0], "4b") is None
    assert codec.scorer(q[None])(b"junk", "4b") is None and codec.scorer(q[None])(codec.encode(np.zeros((1, 256)), "raw")[0], "raw") is None
    x = r.normal(size=(3, 100))
    assert np.allclose((codec.rotate(x) ** 2).sum(axis=1), 128 * (x**2).sum(axis=1))
    assert set(codec.signs(64)) == {1.0, -1.0}


def test_codec_columns(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, None), (3, [])], "id int, vec array<float>")
    out = df.select("id", codec.encode_column(F.col("vec"), "4b").alias("p")).withColumn("s", codec.score_column(F.col("p"), "4b", np.array([[1.0, 2.0, 3.0]])))
    rows = {r.id: r for r in out.collect()}
    assert rows[2].p is None and rows[3].p is None and rows[1].s[0] > 0.95


def test_dead_reckoning():
    r = motion.Reckoner(1.0)
    assert [round(r.step(t, (0, 0, 9.81), (0, 0, -0.5), 0, 0)[1], 9) for t in (0.0, 1.0, 2.0)] == [0, 0.5, 1.0]
    r = motion.Reckoner(1.0)
    r.step(0.0, (0, 0, 10.31), (0, 0, 0), 0, 0)
    _, _, pitch, lat, lng = r.step(1.0, (0, 0, 10.31), (0, 0, 0), 0, 0)
    assert abs(lat - 1.2 / 6371000 * 180 / math.pi) < 1e-9 and lng == 0 and abs(pitch + math.pi / 2) < 1e-9
    r = motion.Reckoner(1.0)
    r.step(0.0, (0, 0, 9.81), (0, 0, -0.5), 0, 0)
    assert round(r.step(5.0, (0, 0, 9.81), (0, 0, -0.5), 0, 0)[1], 9) == 2.5
    _, heading, _, lat, lng = r.step(11.0, (0, 0, 9.81), (0, 0, -0.5), 12, 34)
    assert (round(heading, 9), lat, lng) == (2.5, 12, 34)


def test_statistics(spark):
    df = spark.createDataFrame([(1, 0.9, True), (1, 0.5, True), (1, 0.5, False), (1, 0.1, False), (2, 0.3, False), (3, 0.7, True), (3, 0.7, False)], "q int, s double, pos boolean")
    assert {r.q: r.auc for r in stats.auc(df, ["q"], "s", "pos").collect()} == {1: 0.875, 2: None, 3: 0.5}
    out = {r.q: r for r in stats.adversarial_hits(df, ["q"], "s", "pos", [1, 2]).collect()}
    assert (out[1].rank0, out[1].hit_1, out[2].rank0, out[2].hit_2, out[3].rank0, out[3].hit_1, out[3].hit_2) == (0, True, None, False, 1, False, True)
    per = spark.createDataFrame([(i, float(i % 7), float(i % 7) - 1) for i in range(70)], "id int, a double, b double")
    ci = stats.bootstrap(per, "id", ["a"], 300).first()
    assert ci.a_lo < ci.a_mean < ci.a_hi and ci.a_mean == 3.0 and 0.6 < ci.a_hi - ci.a_lo < 1.4
    assert tuple(stats.paired_bootstrap(per, "id", "a", "b", 50).first()) == (1.0, 1.0, 1.0)
    runs = spark.createDataFrame([("m", 1, 1.0), ("m", 1, 3.0), ("m", 2, 4.0), ("n", 1, 5.0)], "method string, seed int, v double")
    assert {r.method: (r.seeds, r["mean"], round(r.sd, 6)) for r in stats.seed_aggregate(runs, ["method"], "seed", "v").collect()} == {"m": (2, 3.0, 1.414214), "n": (1, 5.0, 0.0)}
    rep = stats.acceptance(spark.createDataFrame([("a", 10, 0.1), ("a", 11, 0.2), ("a", 12, 0.3), ("b", 10, 0.1), ("b", 12, 0.5)], "enc string, res int, v double"), "enc", "res", "v", [10, 11, 12], 0.1)
    assert {r.enc: r.passed for r in rep.collect()} == {"a": True, "b": False}
    assert [stats.verdict(rep, x).first()[0] for x in ("any", "all")] == [True, False] and stats.verdict(rep, encoder="b").first()[0] is False
    same = spark.createDataFrame([(1, 1, 10, 0.9), (1, 2, 11, 0.8), (1, 3, 12, 0.7)], "qid int, rank int, cell long, sim double")
    d = stats.drift(same, same, 3).first()
    assert (d.jaccard, d.same_top, d.delta, round(d.spearman, 9)) == (1.0, True, 0.0, 1.0)


def test_scores(spark):
    truth = spark.createDataFrame([(1, 10.0, 20.0), (1, 30.0, 40.0)], "qid int, start double, end double")
    preds = spark.createDataFrame([(1, 1, 5, 15.0, 10.0, 20.0), (1, 2, 6, 50.0, None, None), (2, 1, 5, 15.0, 10.0, 20.0)], "qid int, rank int, cell long, exemplar_t double, t_min double, t_max double")
    out = {(r.qid, r.rank): r for r in score.score_predictions(preds, score.gather_truth(truth)).collect()}
    assert (out[1, 1].bucket_iou, out[1, 1].exemplar_iou, out[1, 1].exemplar_hit) == (1.0, 0.3, True)
    assert (out[1, 2].bucket_iou, out[1, 2].exemplar_hit, out[2, 1].bucket_iou, out[2, 1].exemplar_hit) == (0.0, False, 0.0, False)
    q = spark.createDataFrame([(1,), (2,), (3,)], "qid int")
    s = {r.qid: r for r in score.summarize_questions(score.score_predictions(preds, score.gather_truth(truth)), q).collect()}
    assert s[1].hit and s[1].bucket_hit and s[1].cells == 2 and not s[3].hit and s[3].max_iou == 0


def test_geo(spark):
    df = spark.createDataFrame([(i, 0.0 + i * 1e-3, 1.0) for i in range(20)], "seq long, lat double, lng double")
    back = geo.transform_coordinates(df, "seq", rotation_deg=360.0)
    assert back.join(df.withColumnRenamed("lat", "a"), "seq").filter(F.abs(F.col("lat") - F.col("a")) > 1e-9).count() == 0
    mixed = geo.transform_coordinates(df, "seq", permute_seed=3).orderBy("seq").collect()
    assert sorted(round(r.lat, 6) for r in mixed) == [round(i * 1e-3, 6) for i in range(20)] and [round(r.lat, 6) for r in mixed] != [round(i * 1e-3, 6) for i in range(20)]
    tiers = [geo.mobility_tier(F.lit(x)) for x in (50.0, 15.0, 5.0, 1.0)]
    assert one(spark, *tiers) == ("street", "building", "room", "sub-room")
    turn = cluster.shuffled(df.withColumn("label", F.col("seq")), "label", "seq")
    assert sorted(r.label for r in turn.collect()) == list(range(20))


def test_streams_match_batches(spark, tmp_path):
    from wayhex.operators.slots import assign_slots

    rows = [(k, i, 1000.0 + i * 3.7 + (k * 11) % 5) for i in range(60) for k in (1, 2)]
    src = str(tmp_path / "in")
    for part in range(3):
        spark.createDataFrame([r for r in rows if r[1] // 20 == part], "k int, seq long, ts double").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("k int, seq long, ts double").option("maxFilesPerTrigger", 1).parquet(src)
    run = arrival_slots(stream, "k", 10.0).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    batch = assign_slots(spark.createDataFrame(rows, "k int, seq long, ts double"), 10.0, keys=["k"]).select("k", "seq", "ts", "slot")
    assert got == sorted(tuple(r) for r in batch.collect())
    assert as_of_replay(batch, "ts", 1010.0).count() < 20


def test_event_windows(spark, tmp_path):
    src = str(tmp_path / "in")
    df = spark.createDataFrame([(i, i % 4) for i in range(200)], "i long, cell long").select(F.timestamp_seconds(F.col("i") * 2).alias("at"), "cell", scalars.hash60((F.col("i") % 30).cast("string")).alias("h"))
    df.write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    out = event_windows(stream, "at", "cell", "h", 60, 6, 10)
    run = out.writeStream.format("memory").queryName("ew").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    batch = event_windows(df, "at", "cell", "h", 60, 6, 10)
    assert sorted(map(tuple, spark.table("ew").collect())) == sorted(map(tuple, batch.collect()))
