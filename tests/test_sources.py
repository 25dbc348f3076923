import json
import struct

import pytest
from pyspark.sql import functions as F

from wayhex.sources import annotations, groups, sinks, tracks

FULL = "ts double, lat double, lng double, embedding array<float>, accel array<float>, gyro array<float>"


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_group_contract(spark, tmp_path):
    df = spark.createDataFrame([(float(i), 1.0, 2.0, [1.0, 2.0], [1.0, 2.0, 3.0], [3.0, 2.0, 1.0]) for i in range(3)], FULL)
    attributes = dict.fromkeys(groups.ATTRIBUTES, "x") | {"embedding_dim": 2}
    groups.write_group(df, str(tmp_path), "s1", "clip", attributes)
    assert groups.read_group(spark, f"{tmp_path}/session_id=s1/clip").count() == 3
    assert groups.read_attributes(spark, str(tmp_path), "s1", "clip")["schema_version"] == 2
    for bad in (lambda: groups.write_group(df, str(tmp_path), "s1", "gps", attributes), lambda: groups.write_group(df, str(tmp_path), "s1", "b", {}), lambda: groups.check_columns(df.drop("gyro")), lambda: groups.check_columns(df.drop("lat"))):
        with pytest.raises(groups.ContractError):
            bad()
    with pytest.raises(Exception, match="exists"):
        groups.write_group(df, str(tmp_path), "s1", "clip", attributes)
    with pytest.raises(Exception, match="differ in width"):
        groups.check_rows(df.unionAll(df.withColumn("embedding", F.array(F.lit(1.0).cast("float")))), 2).collect()
    with pytest.raises(Exception, match="square"):
        groups.check_rows(df.withColumn("attention_map", F.array(F.array(F.lit(1.0), F.lit(2.0)))), 2).collect()
    filled, added = groups.migrate({"model": "m"}, df, {"model": "z", "sampling": "all"})
    assert filled["model"] == "m" and added == ["sampling", "embedding_dim", "sample_fps"] and filled["sample_fps"] == 1.0
    assert groups.migrate(filled, df, {}) == (filled, [])
    q = groups.quality(df.withColumn("k", F.lit(1)), "k").first()
    assert q.collapsed and q.valid == 1.0


def test_motion_groups(spark):
    imu = spark.createDataFrame([(1.0, [1.0], [1.0])], "ts double, accel array<double>, gyro array<double>")
    gps = spark.createDataFrame([(1.0, 2.0, 3.0)], "ts double, lat double, lng double")
    assert groups.read_motion(None, gps) is None and groups.read_motion(imu, gps.limit(0))[1] is None and groups.read_motion(imu, gps)[1] is not None
    with pytest.raises(groups.ContractError):
        groups.read_motion(imu, gps.drop("lat"))


def test_query_vectors_and_provenance(spark, tmp_path):
    (tmp_path / "q.f32").write_bytes(struct.pack("<3f", 1, 2, 3))
    assert groups.read_query_vector(spark, str(tmp_path / "q.f32")).first()["qvec"] == [1, 2, 3]
    before = groups.fingerprint(spark, [str(tmp_path / "q.f32")])
    rows = spark.createDataFrame(before.collect(), before.schema)
    groups.check_resume(rows, before)
    with pytest.raises(groups.ContractError):
        groups.check_resume(rows.withColumn("sha256", F.lit("x")), before)
    (tmp_path / "bad.f32").write_bytes(b"12345")
    with pytest.raises(Exception, match="float32"):
        groups.read_query_vector(spark, str(tmp_path / "bad.f32")).collect()
    assert groups.cache_key("m", "c", "v", 1, "g") == groups.cache_key("m", "c", "v", 1.0, "g") != groups.cache_key("m", "c", "v", 2, "g")
    out = groups.embed_texts(spark.createDataFrame([("a b",), ("a b",), (None,)], "t string"), "t", 8).collect()
    assert out[0].embedding == out[1].embedding and sum(out[2].embedding) == 0


def test_sidecars(spark, tmp_path):
    good = [{"timestamp": 3.0, "utc_time_ms": 5000, "latitude": 1, "longitude": 2}, {"timestamp": 1.0, "utc_time_ms": 3000, "latitude": 1.5, "longitude": 2}]
    bad = [{"timestamp": 1.0, "latitude": 0, "longitude": 0}, {"timestamp": 0.0, "latitude": 1, "longitude": 1}, {"timestamp": 2.0, "latitude": None, "longitude": 1}]
    path = put(tmp_path / "a" / "gps.json", json.dumps([{"stream_id": "x", "samples": [good[0], *bad]}, {"stream_id": "y", "samples": good}]))
    out = tracks.gps_sidecar(spark, path).orderBy("ts").collect()
    assert [(r.ts, r.lat, r.offset) for r in out] == [(3.0, 1.5, 2.0), (5.0, 1.0, 2.0)]
    path = put(tmp_path / "b" / "gps.json", json.dumps([{"stream_id": "y", "samples": [good[0], {"timestamp": 1.0, "latitude": 9, "longitude": 2}]}]))
    assert [r.ts for r in tracks.gps_sidecar(spark, path).orderBy("ts").collect()] == [1.0, 3.0]
    path = put(tmp_path / "imu.json", json.dumps([{"stream_id": "y", "samples": [{"timestamp": 1.0, "accel": [1, 2, 3], "gyro": [1, 2, 3]}, {"timestamp": 2.0, "accel": [1, 2], "gyro": [1, 2, 3]}]}]))
    assert tracks.imu_sidecar(spark, path).count() == 1
    path = put(tmp_path / "meta.json", json.dumps({"tags": {"capture_time_epoch": "17.5"}}))
    assert tracks.capture_time(spark, path).first()["epoch"] == 17.5


def test_tracks(spark, tmp_path):
    lines = ["# t,iso,lng,lat", *[f"{i},x,37.{i:02d},-122.0" for i in range(10, 20)], "nan,x,37,-122", "5,x,0,0", "6,x,38.9,-122.0"]
    path = put(tmp_path / "d1" / "rtk.csv", "\n".join(lines))
    put(tmp_path / "d2" / "rtk.csv", "1,x,-122,37\n2,x,-122,37")
    out = tracks.rtk_csv(spark, f"{tmp_path}/d*/rtk.csv", 36, 39, -124, -121)
    assert out.count() == 10 and {r.file.rsplit("/", 2)[-2] for r in out.collect()} == {"d1"}
    speed = spark.createDataFrame([(f"file:{path}", float(t), 0.0 if t < 14 else 9.0) for t in range(10, 20)], "file string, ts double, speed double")
    assert tracks.moving(out, speed, 5.0, 1.0).count() == 6
    path = put(tmp_path / "slam.csv", "tracking_timestamp_us,tx_world_device,ty_world_device\n2000000,2,2\n1000000,1,1\n1000000,9,9\nx,1,1\n")
    slam = tracks.slam_csv(spark, path)
    assert [(r.ts, r.x) for r in slam.orderBy("ts").collect()] == [(1.0, 1.0), (2.0, 2.0)]
    assert [r.ts for r in tracks.rebase(slam).orderBy("ts").collect()] == [0.0, 1.0]
    at = tracks.project(slam, 0.0, 0.0).orderBy("ts").first()
    assert abs(at.lat - 1 / 111320) < 1e-12 and at.lat == at.lng
    with pytest.raises(ValueError):
        tracks.slam_csv(spark, put(tmp_path / "no.csv", "a,b\n1,2\n"))
    path = put(tmp_path / "lidar.txt", "1 2 3 4 0 0 0 1 10.5\n\n0  1 1 1 0 0 0 1 9.5\n")
    assert [(r.ts, r.x) for r in tracks.lidar_txt(spark, path).orderBy("ts").collect()] == [(9.5, 1.0), (10.5, 2.0)]
    with pytest.raises(Exception, match="nine columns"):
        tracks.lidar_txt(spark, put(tmp_path / "short.txt", "1 2 3\n")).collect()
    found = {r.sequence: r.complete for r in tracks.discover(spark, str(tmp_path), ["rtk.csv"]).collect()}
    assert found["d1"] and found["d2"]
    files = spark.createDataFrame([("a", 5, 1), ("b", 5, 2), ("c", 5, 3)], "path string, bytes long, mtime long")
    assert [r.path for r in tracks.cache_prune(files, 10).collect()] == ["a"]


def test_annotations(spark, tmp_path):
    ask = lambda q, a, b: {"query": q, "template": "t", "video_start_sec": a, "video_end_sec": b}
    doc = {"videos": [{"video_uid": "v", "clips": [{"clip_uid": "c", "annotations": [{"annotation_uid": "n", "language_queries": [ask("where", 10.0, 14.0), ask("where", 10.0, 14.0), ask(None, 1, 2), ask("empty", 3, 3), ask("bad", "x", 2)]}]}]}, {"video_uid": "w"}]}
    out = annotations.language_queries(spark, put(tmp_path / "nlq.json", json.dumps(doc))).collect()
    assert [(r.video, r["query"], r.start, r.end, r.clip) for r in out] == [("v", "where", 10.0, 14.0, "c")]
    with pytest.raises(Exception, match="missing top-level"):
        annotations.language_queries(spark, put(tmp_path / "x.json", "{}")).collect()
    d = lambda t, s, **k: {"text": t, "timestamp": s, "subject": "C", "ego_visible": True, "unsure": False} | k
    doc = {"annotations": {"t1": [{"annotation_uid": "a", "annotator_id": "z", "descriptions": [d(" cut ", 1.0), d("cut", 1.0), d("hid", 2.0, ego_visible=False), d("eh", 3.0, unsure=True), d("", 4.0), d("mix", 9.0)]}], "t2": []}}
    names = annotations.take_names(spark.createDataFrame([("t1", "kitchen", False), ("t2", "gone", True)], "take_uid string, take_name string, is_dropped boolean"))
    rows = annotations.atomic_descriptions(spark, put(tmp_path / "atomic.json", json.dumps(doc)), names=names).orderBy("ts").collect()
    assert [(r["name"], r.text, r.start, r.end) for r in rows] == [("kitchen", "cut", 0.0, 3.0), ("kitchen", "mix", 7.0, 11.0)]
    path = put(tmp_path / "s9" / "narration" / "atomic.csv", "start_time,end_time,what,annotator\n105,107,walks,a\n105,107,walks,a\n99,101,early,a\n106,106,empty,a\n")
    rows = annotations.narrations(spark, path, spark.createDataFrame([("s9", 100.0)], "session string, t0 double"), "what")
    assert [(r.session, r.text, r.start, r.end) for r in rows.collect()] == [("s9", "walks", 5.0, 7.0)]
    assert annotations.summary(rows, "session").first()["mean_sec"] == 2.0
    listed = [{"id": "a", "query": "x", "intervals": [[1, 2]]}, {"query": "y", "query_mode": "last_seen"}, {"id": "c", "query": "z"}]
    for path in (put(tmp_path / "q.json", json.dumps(listed)), put(tmp_path / "q.yaml", json.dumps({"questions": listed}))):
        q = annotations.record_kinds(annotations.questions(spark, path)).orderBy("id").collect()
        assert [(r.id, r.scored, r.negative, r.spatial) for r in q] == [("a", True, False, False), ("c", False, True, False), ("q2", False, False, True)]
    with pytest.raises(ValueError):
        annotations.questions(spark, put(tmp_path / "d.json", json.dumps([{"id": "a"}, {"id": "a"}])))


def test_sinks(spark, tmp_path):
    preds = spark.createDataFrame([(1, 2, 11), (1, 1, 10), (2, 1, 10)], "qid long, rank int, cell long")
    out = [json.loads(r.json) for r in sinks.to_json(preds, "search", "qid").collect()]
    one = next(x for x in out if x["qid"] == 1)
    assert one["schema_version"] == 1 and [r["cell"] for r in one["results"]] == ["a", "b"]
    assert json.loads(sinks.to_json(preds, "summary").first()["json"])["row"]["cell"] in ("a", "b")
    summary = spark.createDataFrame([(1, True), (3, False)], "qid long, hit boolean")
    sinks.write_capture(summary, preds, {"codec": "raw"}, str(tmp_path / "cap"))
    back = spark.read.json(str(tmp_path / "cap"))
    assert back.count() == 2 and sinks.read_captures(back, {"was_hit": ["hit"], "codec": []}).columns == ["was_hit", "codec"]
    with pytest.raises(ValueError):
        sinks.read_captures(back, {"nothing": []})
    again = sinks.promote(preds, spark.createDataFrame([(1, 2)], "qid long, pick int")).orderBy("qid", "rank").collect()
    assert [(r.qid, r.cell) for r in again] == [(1, 11), (1, 10), (2, 10)]
