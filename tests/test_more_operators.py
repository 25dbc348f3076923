"""Operators by plain versions: searches inside batches, sequential banks, recurrences, spreads, paired runs, payload bytes."""

import itertools
import math
import random
import struct
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayhex.functions import codec, scalars, vectors
from wayhex.operators import cluster, memory, motion, retention, score, sequential, stats
from wayhex.operators.geo import positions
from wayhex.scratch import shared_path
from wayhex.sources import groups


def test_best_rows_keep_what_a_larger_set_needs():
    r = np.random.default_rng(1)
    for _ in range(200):
        n, top, cap = int(r.integers(1, 80)), int(r.integers(1, 6)), int(r.integers(1, 4))
        sim = np.round(r.random(n) * 5) / 5
        sim[r.random(n) < 0.1] = np.nan
        order, group, ts = r.permutation(n), r.integers(0, 6, n), r.random(n)
        cap = min(cap, top)

        def rank(rows, sim=sim, order=order, group=group, ts=ts, top=top, cap=cap):
            kept = []
            for g in set(group[rows].tolist()):
                kept += sorted((i for i in rows if group[i] == g and not np.isnan(sim[i])), key=lambda i: (-sim[i], order[i]))[:cap]
            return sorted(kept, key=lambda i: (-sim[i], -ts[i], group[i], order[i]))[:top]

        cuts = sorted(r.integers(0, n + 1, 3).tolist())
        parts = [np.arange(a, b) for a, b in zip([0, *cuts], [*cuts, n])]
        left = [p[vectors.best_rows(sim[p], order[p], top, group[p], cap)] for p in parts if len(p)]
        assert rank(np.concatenate(left).tolist()) == rank(list(range(n)))
        flat = [p[vectors.best_rows(sim[p], order[p], top)] for p in parts if len(p)]
        plain = lambda rows, sim=sim, order=order, top=top: sorted((i for i in rows if not np.isnan(sim[i])), key=lambda i: (-sim[i], order[i]))[:top]
        assert plain(np.concatenate(flat).tolist()) == plain(range(n))


def test_search_over_blocks_and_awkward_vectors(spark):
    r = np.random.default_rng(2)
    rows = [(i, i % 4, r.normal(size=8).tolist()) for i in range(60)] + [(60, 0, None), (61, 1, []), (62, 2, [0.0] * 8), (63, 3, [1.0] * 5)]
    bank = spark.createDataFrame(rows, "seq long, cell long, vec array<float>").repartition(3)
    q = spark.createDataFrame([(k, r.normal(size=8).tolist()) for k in range(5)] + [(5, None), (6, [1.0] * 5)], "qid long, qvec array<float>")
    whole = memory.rank_hits(memory.score(bank.withColumn("ts", F.lit(0.0)), q), 4, 2)
    for size in (1, 100, 1 << 20):
        best = memory.best_hits(bank.withColumn("ts", F.lit(0.0)), q, 4, "seq", "cell", 2, size)
        assert sorted(map(tuple, memory.rank_hits(best, 4, 2).collect())) == sorted(map(tuple, whole.collect()))
    assert memory.best_hits(bank, q.limit(0), 3).collect() == []


class PlainBank:
    """The rule of the balanced bank by looking at everything for each frame."""

    def __init__(self, size):
        self.size, self.frames = size, []  # (cell, cell rank, frame rank, number)

    def offer(self, *new):
        if len(self.frames) < self.size:
            self.frames.append(new)
            return
        shares = {c: sum(f[0] == c for f in self.frames) for c in {f[0] for f in self.frames}}
        most = max(shares.values(), default=0)
        own = shares.get(new[0], 0)
        worst = lambda c: max((f for f in self.frames if f[0] == c), key=lambda f: (f[2], -f[3]))
        if own < most:
            donor = min((f[1], f[0]) for f in self.frames if shares[f[0]] == most)
            if most > 1 or new[1] > donor[0]:
                self.frames.remove(worst(donor[1]))
                self.frames.append(new)
        elif own and (new[2], -new[3]) < (worst(new[0])[2], -worst(new[0])[3]):
            self.frames.remove(worst(new[0]))
            self.frames.append(new)


def test_balanced_bank_against_a_plain_one():
    for seed in range(20):
        r = random.Random(seed)
        size, cells = r.choice([1, 3, 8, 20]), r.choice([1, 4, 30])
        ranks = r.sample(range(1000), cells)
        one, two = retention.BalancedBank(size), PlainBank(size)
        for i in range(300):
            c = min(int(r.expovariate(0.3)), cells - 1)
            frame = (c, ranks[c], r.randrange(10**6), i)
            one.offer(*frame)
            two.offer(*frame)
            assert sorted(n for h in one.held.values() for _, n in h) == sorted(f[3] for f in two.frames)
    assert not retention.BalancedBank(0).held


def test_sequential_work_keeps_keys_apart(spark):
    r = random.Random(1)
    rows = [(s, i, float(i), r.randint(0, 3)) for s in (1, 2, None) for i in range(500)]
    df = spark.createDataFrame(rows, "session int, seq long, ts double, cell long").repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        out = retention.spatial_priority(df, 12).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(str, (x.session for x in out))) == ["1"] * 12 + ["2"] * 12 + ["None"] * 12
    assert all(sum(x.session == s and x.cell == c for x in out) == 3 for s in (1, 2, None) for c in range(4))
    whole = retention.spatial_priority(df, 12).collect()
    assert sorted(map(str, out)) == sorted(map(str, whole))


def test_recurrence_and_batches_of_motion():
    r = np.random.default_rng(3)
    a, b = r.random(100), r.normal(size=100)
    y, want = 2.0, []
    for i in range(100):
        y = a[i] * y + b[i]
        want.append(y)
    assert np.allclose(sequential.recurrence(a, b, 2.0), want)
    t = np.cumsum(r.choice([0.0, 0.5, 1.0, 9.0], 200))
    args = (t, r.normal(size=(200, 3)) * 4, r.normal(size=(200, 3)), 50 + r.random(200) / 100, r.random(200) / 100)
    whole = motion.Reckoner(0.7).follow(*args)
    parts, own = [], motion.Reckoner(0.7)
    for i, j in itertools.pairwise([0, 1, 50, 51, 130, 200]):
        parts.append(own.follow(*(x[i:j] for x in args)))
    single, alone = motion.Reckoner(0.7), []
    for i in range(200):
        alone.append(single.step(*(x[i] for x in args)))
    for k in range(5):
        joined = np.concatenate([p[k] for p in parts])
        if k == 0:
            assert (joined == whole[0]).all() and [x[0] for x in alone] == whole[0].tolist()
        else:
            assert np.allclose(joined, whole[k]) and np.allclose([x[k] for x in alone], whole[k])
    assert (np.abs(whole[1]) <= math.pi + 1e-12).all()


def test_kcenter_in_several_passes(spark):
    r = np.random.default_rng(1)
    v = r.normal(size=(80, 4))
    v[40:60] = v[:20]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "seq long, vec array<double>")
    one = [x.seq for x in retention.kcenter(df, 20).orderBy("pick").collect()]
    assert one == [x.seq for x in retention.kcenter(df, 20, leaders=3).orderBy("pick").collect()] and len(set(one)) == 20


def test_spread_of_blocks_and_of_too_few(spark):
    r = np.random.default_rng(5)
    v = r.normal(size=(50, 6))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, None), (100, [])], "seq long, vec array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    c = (u @ u.T)[np.triu_indices(50, 1)]
    for block in (7, 4096):
        x = stats.spread(df, "vec", "seq", block).first()
        got = (x.pairs, x["mean"], x.sd, x["min"], x["max"], x.p05, x.p95)
        assert np.allclose(got, (len(c), c.mean(), c.std(), c.min(), c.max(), *np.percentile(c, [5, 95])), atol=1e-9)
    same = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(5)], "seq long, vec array<double>")
    assert abs(stats.spread(same, "vec", "seq").first().p05 - 1) < 1e-9
    with pytest.raises(ValueError, match="two vectors"):
        stats.spread(df.limit(1), "vec", "seq")


def test_pairs_that_are_not_comparable_are_refused(spark):
    kind = "session long, hash string, value double"
    a = spark.createDataFrame([(1, "x", 1.0), (2, "y", 2.0)], kind)
    assert sorted(map(tuple, stats.check_pairs(a, a, "session", ["hash"]).collect())) == [(1, 1.0, 1.0), (2, 2.0, 2.0)]
    for b, why in (([(1, "x", 1.0)], "one run only"), ([(1, "x", 1.0), (2, "z", 2.0)], "differ in 1"), ([(1, "x", 1.0), (2, "y", 2.0), (2, "q", 2.0)], "within a session")):
        with pytest.raises(ValueError, match=why):
            stats.check_pairs(a, spark.createDataFrame(b, kind), "session", ["hash"])
    with pytest.raises(ValueError, match="common"):
        stats.check_pairs(a, spark.createDataFrame([(9, "x", 1.0)], kind), "session", ["hash"], allow_unpaired=True)


def test_merged_intervals(spark):
    rows = [(1, 0.0, 2.0), (1, 1.0, 3.0), (1, 3.0, 4.0), (1, 5.0, 6.0), (1, 0.5, 1.0), (2, 1.0, 0.0), (2, 1.0, 1.0)]
    out = score.merge_intervals(spark.createDataFrame(rows, "qid long, start double, end double")).collect()
    assert sorted(map(tuple, out)) == [(1, 0.0, 4.0), (1, 5.0, 6.0), (2, 1.0, 1.0)]


def test_positions_of_spread_values_are_counted_in_chunks(spark):
    r = random.Random(2)
    values = [r.randrange(1 << 60) for _ in range(3000)] + [-5, 0]
    df = spark.createDataFrame([(v,) for v in values], "k long")
    assert [(x.k, x._i) for x in positions(df, "k").orderBy("_i").collect()] == [(v, i) for i, v in enumerate(sorted(values))]
    assert positions(df.limit(0), "k").collect() == []


def test_payload_bytes_are_the_published_layout():
    p = codec.encode(np.ones((1, 3)), "2b")[0]
    assert p[:4] == b"\x4e\x51\x54\x00" and struct.unpack_from("<BBHfI", p, 4)[:3] == (1, 0, 3) and struct.unpack_from("<I", p, 12) == (4,)
    assert len(p) == 16 + 1 + 1 and p[-1] == 0
    assert [codec.codec_name(x) for x in ("raw", "quant_4b", "3b", "x_raw", "9b")] == ["raw", "4b", "3b", None, None]


def test_projection_keeps_most_of_the_variance(spark):
    r = np.random.default_rng(4)
    v = r.normal(size=(200, 2)) @ r.normal(size=(2, 10)) + r.normal(size=(200, 10)) * 0.01
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "seq long, vec array<double>")
    out = cluster.project_2d(df).orderBy("seq").collect()
    xy = np.array([(p.x, p.y) for p in out])
    assert np.var(xy, axis=0).sum() > 0.99 * np.var(v, axis=0).sum()


def test_medoids_are_rows_of_their_clusters(spark):
    r = np.random.default_rng(6)
    v = np.concatenate([r.normal(size=(30, 3)) * 0.1 + c for c in ((0, 0, 0), (9, 0, 0), (0, 9, 0))])
    out = cluster.medoids(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "seq long, vec array<double>"), 3).collect()
    assert sorted(x.seq // 30 for x in out) == [0, 1, 2] and all(x["size"] == 30 for x in out)


def test_a_cluster_needs_a_shared_folder():
    def session(master, folder=None):
        get = lambda key, default=None: folder if folder else default
        context = SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=get))
        return SimpleNamespace(conf=SimpleNamespace(get=get), sparkContext=context)

    with pytest.raises(RuntimeError, match="checkpoint"):
        shared_path(session("spark://host:7077"), "x")
    assert shared_path(session("spark://host:7077", "hdfs://a/b/"), "x").startswith("hdfs://a/b/x-")
    assert shared_path(session("local[2]"), "x").startswith("file://")


def test_plans_let_few_rows_leave_a_scan(spark, sf):
    from wayhex.plans import analytics, core

    plan = core.similar_global(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "posexplode" not in plan
    labelled = analytics.labelled(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert labelled.count("Aggregate") >= 4


def test_models_by_name(spark):
    df = spark.createDataFrame([("a walk in the park",), ("a park",), ("",), (None,)], "t string")
    rows = [np.array(r.embedding) for r in groups.embed(df, "t").collect()]
    assert [len(v) for v in rows] == [64] * 4 and np.allclose([np.linalg.norm(v) for v in rows], [1, 1, 0, 0])
    assert rows[0] @ rows[1] > 0
    with pytest.raises(groups.ContractError, match="no model"):
        groups.embed(df, "t", "other")
    with pytest.raises(groups.ContractError, match="already"):
        groups.register_model("words", groups.embed_texts)
    with pytest.raises(ValueError, match="already"):
        codec.register("raw", codec.CODECS["raw"])


def test_the_tangent_plane(spark):
    df = spark.createDataFrame([(51.001, -0.002)], "lat double, lng double")
    x, y = scalars.local_xy(F.col("lat"), F.col("lng"), F.lit(51.0), F.lit(0.0))
    got = df.select(x.alias("x"), y.alias("y")).first()
    assert abs(got.y - 111.195) < 0.1 and abs(got.x + 2 * 111.195 * math.cos(math.radians(51))) < 0.1
