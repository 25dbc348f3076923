"""What larger tables need: no plan sends rows that it multiplied to the driver, and results stay whole."""

from wayhex.operators import stats


def broadcasts(df) -> list[str]:
    """What the plan sends to the driver: the subtree of each broadcast."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    ends = [next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines)) for i in range(len(lines))]
    return ["\n".join(lines[i:j]) for i, j in enumerate(ends) if "BroadcastExchange" in lines[i]]


def test_bootstrap_draws_are_dealt_and_not_broadcast(spark):
    rows = spark.range(50).selectExpr("id", "id * 1.0D as a", "id % 7 * 1.0D as b")
    out = stats.bootstrap(rows, "id", ["a"], 40)
    assert not [x for x in broadcasts(out) if "Generate" in x]
    first = out.first()
    assert first.a_lo < first.a_mean < first.a_hi
    made = stats.draws(rows.groupBy().count().withColumnRenamed("count", "_n"), [], 40)
    assert made.rdd.getNumPartitions() == 40 and made.count() == 40 * 50


def test_paired_bootstrap_equals_brute_force(spark):
    from hashlib import md5

    import numpy as np

    a, b = [float(i * i % 17) for i in range(30)], [float(i % 5) for i in range(30)]
    rows = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(zip(a, b))], "id long, a double, b double")
    out = stats.paired_bootstrap(rows, "id", "a", "b", 25)
    assert not [x for x in broadcasts(out) if "Generate" in x]
    d = np.array(a) - np.array(b)
    means = [d[[int(md5(f"42:{k}:{i}".encode()).hexdigest()[:15], 16) % 30 for i in range(1, 31)]].mean() for k in range(1, 26)]
    assert np.allclose(out.first(), (d.mean(), *np.percentile(means, [2.5, 97.5])), atol=1e-12)


def test_last_seen_looks_up_each_cell_once(spark):
    from wayhex.config import MemoryConfig
    from wayhex.functions.cells import HexGrid
    from wayhex.operators import memory

    grid = HexGrid(51.38, -0.31)
    rows = [(i, float(100 * i), 51.38 + (i % 7) * 1e-3, -0.31, f"x{i}") for i in range(20)]
    mem = memory.observe(spark.createDataFrame(rows, "seq long, ts double, lat double, lng double, item string"), MemoryConfig(window_sec=1000.0), grid)
    at = spark.range(40).selectExpr("if(id = 39, 0, id) as point_id", "51.38D + (id % 2) * 0.001D as lat", "-0.31D as lng")
    out = memory.last_seen(mem, at, 2, 3)
    assert not [x for x in broadcasts(out) if "Generate" in x]
    # point 0 is there twice, at two places: its cells count once for each row, as in a join
    whole = memory.window_aggregate(mem).collect()
    from pyspark.sql import functions as F

    from wayhex.functions.cells import disk

    near = disk(at.withColumn("c", grid.encode(F.col("lat"), F.col("lng"), mem.cfg.resolution)), "c", 2, "cell").select("point_id", "cell").collect()
    want = set()
    for p in {r.point_id for r in near}:
        found = sorted((-w.t_max, -w["count"], w.cell) for r in near if r.point_id == p for w in whole if w.cell == r.cell)
        want |= {(p, i + 1, cell, len(found)) for i, (_, _, cell) in enumerate(found[:3])}
    assert {(r.point_id, r.rank, r.cell, r.total_found) for r in out.collect()} == want


def test_course_from_the_row_before(spark):
    from wayhex.operators import geo

    rows = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 1), (2, 1.0, 1.0, 0.0, 1), (3, 2.0, 1.0, 0.0, 1), (4, 3.0, 1.0, 1.0, 1)], "seq long, ts double, lat double, lng double, session long")
    course = lambda **how: [r.bearing for r in geo.course(rows, "session", **how).orderBy("seq").collect()]
    assert course(distinct=False) == [None, 0.0, 0.0, 90.0] and course() == [None, 0.0, 0.0, 90.0]
    back = rows.withColumn("lat", -rows.lat)
    assert [r.bearing for r in geo.course(back, "session", distinct=False).orderBy("seq").collect()] == [None, 180.0, 0.0, 90.0]
    assert [r.bearing for r in geo.course(back, "session").orderBy("seq").collect()] == [None, 180.0, 180.0, 90.0]


def test_course_query_equals_its_sql_where_a_session_stands_still(spark, tmp_path):
    import duckdb

    from wayhex.plans.all import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    con.execute("CREATE TABLE events AS SELECT i AS event_id, TIMESTAMP '2024-01-01' + INTERVAL (i) SECOND AS ts, 1::BIGINT AS user_id, 'view' AS event_type, 1.0::DOUBLE AS value, '{}' AS props FROM (SELECT unnest([0, 1, 1001, 2001]::BIGINT[]) AS i)")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet'")
    got = {r.seq: r.bearing for r in QUERIES["course_over_ground"](spark, str(tmp_path)).collect()}
    assert got == dict(con.execute(ORACLE_SQL["course_over_ground"]).fetchall()) and got[1001] == got[2001] == 0.0


def ranked(spark, sim_bytes):
    rng = __import__("random").Random(7)
    vecs = [(i, [rng.choice([-1.0, 0.5, 1.0]) for _ in range(3)]) for i in range(40)] + [(40, [0.0, 0.0, 0.0]), (41, None), (42, [1.0])]
    frames = [(rng.randrange(43), rng.randrange(3), rng.randrange(4)) for _ in range(300)]  # vector, place, drive
    asked = [(i, vecs[i][1], rng.randrange(3), rng.randrange(4)) for i in range(0, 40, 4)]
    f = spark.createDataFrame(frames, "vec_id long, cell long, drive long")
    q = spark.createDataFrame(asked, "qid long, qvec array<double>, qcell long, qdrive long")
    here = f.groupBy("cell", "vec_id").count().withColumnRenamed("count", "n")
    own = f.join(q, (f.cell == q.qcell) & (f.drive == q.qdrive)).groupBy("qid", "vec_id").count().withColumnRenamed("count", "n")
    total = f.groupBy("vec_id").count().withColumnRenamed("count", "n")
    v = spark.createDataFrame(vecs, "vec_id long, vec array<double>").join(total, "vec_id")
    return vecs, frames, asked, stats.ranks_of_places(v, q.select("qid", "qvec", "qcell"), here, own, sim_bytes)


def test_ranks_of_places_equal_brute_force_in_blocks_of_any_size(spark):
    import numpy as np

    for sim_bytes in (1, 1 << 20):
        vecs, frames, asked, out = ranked(spark, sim_bytes)
        got = {r.qid: (r.n_pos, r.n_neg, r.auc and round(r.auc, 9), r.rank0) for r in out.collect()}
        want = {}
        for qid, qvec, place, drive in asked:
            sims = {i: round(float(np.dot(v, qvec) / np.linalg.norm(v) / np.linalg.norm(qvec)), 9) for i, v in vecs if v is not None and len(v) == 3 and any(v)}
            rows = [(sims[v], c == place and d != drive, c == place and d == drive) for v, c, d in frames if v in sims]
            pos, neg = [s for s, p, _ in rows if p], [s for s, p, a in rows if not p and not a]
            auc = sum((x > y) + 0.5 * (x == y) for x in pos for y in neg) / (len(pos) * len(neg))
            want[qid] = (len(pos), len(neg), round(auc, 9), sum(s > max(pos) or (not p and s == max(pos)) for s, p, _ in rows))
        assert got == want and len(want) == 10


def test_ranking_makes_no_row_for_a_pair_of_vector_and_question(spark, sf):
    from wayhex.plans.all import QUERIES

    for name in ("hit_at_k_adversarial", "cross_session_auc"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "posexplode" not in plan and "ArrowEvalPython" not in plan


def test_votes_equal_brute_force_and_no_frame_meets_an_interval(spark):
    import random

    from wayhex.operators import score

    rng = random.Random(3)
    frames = [(i, float(rng.randrange(60)), rng.choice([None, 5, 6, 7])) for i in range(300)]
    spans = [(q, 10.0 * k + q, 10.0 * k + q + rng.randrange(9)) for q in range(6) for k in range(5)]
    f, t = spark.createDataFrame(frames, "seq long, ts double, cell long"), spark.createDataFrame(spans, "qid long, start double, end double")
    got = {(r.qid, r.cell): (r.n, r["first"]) for r in score._votes(f, t).collect()}
    want = {}
    for q in range(6):
        for c in (None, 5, 6, 7):
            seqs = [s for s, ts, cell in frames if cell == c and any(p == q and a <= ts <= b for p, a, b in spans)]
            if seqs:
                want[q, c] = (len(seqs), min(seqs))
    assert got == want
    plan = score.question_strata(t, f, 5.0, 10.0)._jdf.queryExecution().executedPlan().toString()
    assert "_bin" not in plan


def test_narrations_keep_every_row_whatever_the_files(spark, sf):
    import duckdb

    from wayhex.plans.all import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 7)
    try:
        got = {tuple(r) for r in QUERIES["read_narrations"](spark, sf).select("session", "text", "start").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert got == set(con.execute(f"SELECT session, text, start FROM ({ORACLE_SQL['read_narrations']})").fetchall())


def test_file_names_are_not_a_task_for_a_few_files(spark, tmp_path):
    from wayhex.sources import tracks

    for i in range(40):
        (tmp_path / f"session={i}" / "kind=track").mkdir(parents=True)
        (tmp_path / f"session={i}" / "kind=track" / "a.txt").write_text("x")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        found = tracks.file_names(spark, f"file://{tmp_path}", r"session=[0-9]+", r"kind=([a-z]+)")
        assert found.rdd.getNumPartitions() <= 4 and {tuple(r) for r in found.collect()} == {(f"session={i}", "track") for i in range(40)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def files_under(root) -> list[str]:
    return sorted(str(p.relative_to(root)) for p in root.rglob("*") if p.is_file())


def test_discovery_makes_files_without_a_program_for_each_and_equals_its_sql_on_odd_sessions(spark, tmp_path, monkeypatch):
    import duckdb

    from wayhex.plans import files
    from wayhex.plans.all import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for users in ([1, 2, 4, 4, 8, -5, -8, None, 10**6 + 1], []):
        root = tmp_path / f"shared{len(users)}"
        con.execute("CREATE OR REPLACE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
        for i, u in enumerate(users):
            con.execute("INSERT INTO events VALUES (?, TIMESTAMP '2024-01-01', ?, 'view', 1.0, '{}')", [i, u])
        con.execute(f"COPY events TO '{tmp_path}/events.parquet'")
        monkeypatch.setattr(files, "shared_path", lambda spark, name: f"file://{root}/{name}")
        got = {tuple(r) for r in QUERIES["discover_sequences"](spark, str(tmp_path)).collect()}
        assert got == set(con.execute(ORACLE_SQL["discover_sequences"]).fetchall()) and len(got) == 2
        # a .crc beside a file is Hadoop's writer, which starts a program for each
        made = [x.split("/", 1)[1] for x in files_under(root)]
        assert made == sorted(f"session={u}/{k}.txt" for u in set(users) - {None} for k in ("track", "extra") if k == "track" or u % 4)


def test_folders_are_written_and_listed_alike_on_a_file_system_that_only_hadoop_knows(spark, tmp_path):
    from wayhex.scratch import local_path
    from wayhex.sources import sinks, tracks

    conf = spark._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.folders.link./in", f"file://{tmp_path}")
    rows = spark.sql("SELECT id AS session, explode(if(id % 2 = 0, array('a', 'b'), array('b'))) AS kind, if(id = 3, null, 'x') AS value FROM range(40)")
    found = []
    for at in (f"file://{tmp_path}/plain", "viewfs://folders/in/far"):
        assert (local_path(spark, at) is None) == at.startswith("viewfs")
        sinks.write_folders(rows, "session", "kind", at)
        found.append({tuple(r) for r in tracks.file_names(spark, at, r"session=[0-9]+", r"[/=]([a-z]+)(?:/part-[^/]*)?[.]txt$").collect()})
    assert found[0] == found[1] == {(f"session={i}", k) for i in range(40) for k in "ab" if k == "b" or i % 2 == 0}
    assert (tmp_path / "plain/session=3/b.txt").read_text() == "\n" and (tmp_path / "plain/session=4/b.txt").read_text() == "x\n"


def test_file_names_of_hidden_nested_and_loose_files(spark, tmp_path):
    from wayhex.sources import tracks

    for x in ("a b/c/d.txt", "a b/_x.txt", "a b/.y", ".h/z.txt", "_t/z.txt", "_k=1/z.txt", "loose.txt", "u/é+%.txt"):
        (tmp_path / x).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / x).write_text("x")
    conf = spark._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.names.link./in", f"file://{tmp_path}")
    own = [{r["name"] for r in tracks.file_names(spark, at, "x", "(?:/|^)([^/]+/[^/]+)$").collect()} for at in (f"file://{tmp_path}", "viewfs://names/in")]
    assert own[0] == {"c/d.txt", "_k=1/z.txt", f"{tmp_path.name}/loose.txt", "u/é+%.txt"}
    assert own[1] == {"c/d.txt", "_k=1/z.txt", "in/loose.txt", "u/é+%.txt"}


def resampled_means(values, resamples, seed=42) -> list:
    """Means of the draws' values by the law, one hash at a time; None where all that is drawn is missing."""
    from hashlib import md5

    n = len(values)
    out = []
    for k in range(1, resamples + 1):
        own = [v for i in range(1, n + 1) if (v := values[int(md5(f"{seed}:{k}:{i}".encode()).hexdigest()[:15], 16) % n]) is not None]
        out.append(sum(own) / len(own) if own else None)
    return out


def test_bootstrap_ci_makes_all_ten_thousand_resamples(spark, sf):
    import numpy as np

    from wayhex.plans import analytics
    from wayhex.plans.all import QUERIES

    view = [r.view for r in analytics.per_session(spark, sf).orderBy("session").collect()]
    lo, hi = np.percentile(resampled_means(view, 10_000), [2.5, 97.5])
    assert np.allclose(tuple(QUERIES["bootstrap_ci"](spark, sf).first()), (np.mean(view), lo, hi), atol=1e-6)


def test_bootstrap_by_keys_in_parts_equals_brute_force_and_no_draw_is_a_row(spark, monkeypatch):
    import random

    import numpy as np

    rng = random.Random(5)
    sizes = {"a": 1, "b": 12, "c": 103, None: 3, "d": 2}
    value = lambda k: None if k == "d" or rng.random() < 0.2 else rng.random()
    rows = [(k, i, value(k), i * 7 % 11) for k, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "k string, id long, x double, y int").repartition(3)
    for held, pack, hashed, drawn in ((stats.HELD, stats.PACK, stats.HASHED, stats.DRAWN), (10, 4, 16, 100)):
        for name, v in (("PACK", pack), ("HASHED", hashed), ("DRAWN", drawn)):
            monkeypatch.setattr(stats, name, v)
        out = stats.bootstrap(df, "id", ["x", "y"], 120, 7, ["k"], held)
        assert "Join" not in out._jdf.queryExecution().executedPlan().toString().split("FlatMapGroupsInArrow")[1]
        got = {r.k: r for r in out.collect()}
        assert set(got) == {"a", "b", "c", "d"}
        for k in got:
            for c, col in (("x", 2), ("y", 3)):
                own = [r[col] for r in rows if r[0] == k]
                means = [m for m in resampled_means(own, 120, 7) if m is not None]
                want = (np.mean([v for v in own if v is not None]), *np.percentile(means, [2.5, 97.5])) if means else (None,) * 3
                found = (got[k][f"{c}_mean"], got[k][f"{c}_lo"], got[k][f"{c}_hi"])
                assert found == want if None in want else np.allclose(found, want, atol=1e-12), (k, c)


def test_hashes_of_pairs_equal_md5_for_any_length(spark):
    from hashlib import md5

    from wayhex.functions.hashes import pair_hashes

    for head in ("42:", "", "é" * 7, "x" * 51, "x" * 60):
        for a, b in (((95, 105), (1, 1203)), ((1, 1), (0, 12)), ((9998, 10001), (99998, 100001)), ((7, 7), (7, 7))):
            want = [[int(md5(f"{head}{i}:{j}".encode()).hexdigest()[:15], 16) for j in range(b[0], b[1] + 1)] for i in range(a[0], a[1] + 1)]
            assert pair_hashes(head, a, b).tolist() == want
