import random

import pytest
from pyspark.sql import functions as F

from wayhex.config import MemoryConfig
from wayhex.functions import cells, scalars
from wayhex.operators import memory, sketch
from wayhex.operators.slots import assign_slots, running_max

BASE = (51.380083, -0.311041)
GRID = cells.HexGrid(*BASE)
SCHEMA = "seq long, ts double, lat double, lng double, item string, vec array<float>"


def mem(spark, rows, **cfg):
    rows = [(i, *r, *[None] * (5 - len(r))) for i, r in enumerate(rows)]
    return memory.observe(spark.createDataFrame(rows, SCHEMA), MemoryConfig(**cfg), GRID)


def count(m, n, place=BASE):
    at = m.valid.sparkSession.createDataFrame([(1, *place)], "point_id long, lat double, lng double")
    return memory.window_count(m, at, n).first()["count"]


def test_gap_keeps_empty_windows(spark):
    m = mem(spark, [(0.0, *BASE, "a"), (11.0, *BASE, "b")], window_sec=5.0, capacity=4)
    assert count(m, 0) >= 1 and count(m, 1) == count(m, 0) and count(m, 2) > count(m, 1)
    assert count(m, 99) == count(m, 3)


def test_invalid_rows_move_the_clock_but_make_no_tile(spark):
    m = mem(spark, [(0.0, *BASE, "a"), (12.0, 100.0, 0.0, "b"), (12.0, float("nan"), 0.0, "b"), (12.0, *BASE, "")], window_sec=5.0, capacity=4)
    assert memory.tiles(m).count() == 1 and m.rejects.count() == 3
    assert count(m, 0) == 0 and count(m, 2) > 0 and count(m, 0, (100.0, 0.0)) is None and count(m, 3, (0.0, 0.0)) == 0


def test_same_item_counts_once(spark):
    one, two = (mem(spark, [(float(t), *BASE, "a") for t in range(n)]) for n in (1, 2))
    assert count(one, 3) == count(two, 3) and memory.tiles(two).first()["seen"] == 2


def test_aged_out_cell_is_listed_with_zeros(spark):
    m = mem(spark, [(0.0, *BASE, "a"), (100.0, 35.68, 139.68, "b")], window_sec=5.0, capacity=4)
    rows = {r.seen: r for r in memory.tile_summary(m).orderBy("total").collect()}
    assert memory.tile_summary(m).count() == 2 and min(r.total for r in memory.tile_summary(m).collect()) == 0 and rows


def test_last_seen_order_and_total(spark):
    m = mem(spark, [(100.0, *BASE, "a"), (200.0, BASE[0] + 0.01, BASE[1], "b"), (150.0, BASE[0] + 0.02, BASE[1], "c")], window_sec=1000.0)
    at = spark.createDataFrame([(1, *BASE), (2, 100.0, 0.0)], "point_id long, lat double, lng double")
    out = memory.last_seen(m, at, 40, 5).orderBy("rank").collect()
    assert [r.t_max for r in out] == [200.0, 150.0, 100.0]
    assert [r.total_found for r in memory.last_seen(m, at, 40, 1).collect()] == [3]
    assert memory.last_seen(m, at, -1, 5).count() == 0


def hits(spark, rows, q, k=None, top=5, cap=1, **cfg):
    m = mem(spark, rows, exemplars=8, **cfg)
    qs = spark.createDataFrame([(1, q, *BASE)], "qid long, qvec array<float>, lat double, lng double")
    return memory.recall(m, memory.exemplars(m), qs, top, cap, k).orderBy("rank").collect()


def test_similarity(spark):
    far = (BASE[0] + 0.01, BASE[1])
    assert hits(spark, [(1.0, *BASE, "a", [1.0, 2.0, 3.0, 4.0])], [1.0, 2.0, 3.0, 4.0])[0].sim > 0.9999
    out = hits(spark, [(10.0, *BASE, "a", [0.0, 1.0, 0.0, 0.0]), (20.0, *BASE, "b", [1.0, 0.0, 0.0, 0.0])], [1.0, 0.0, 0.0, 0.0])
    assert [r.exemplar_t for r in out] == [20.0]
    out = hits(spark, [(6.0, *far, "b", [0.3, 1.0, 0.0, 0.0]), (6.5, *BASE, "a", [1.0, 0.1, 0.0, 0.0])], [1.0, 0.0, 0.0, 0.0])
    assert [r.exemplar_t for r in out] == [6.5, 6.0]
    assert hits(spark, [(1.0, *BASE, "a", [1.0] * 5)], [1.0] * 4) == []
    assert hits(spark, [(1.0, *BASE, "a", [0.0] * 4)], [1.0] * 4) == []
    assert len(hits(spark, [(1.0, *BASE, "a", [1.0] * 4), (2.0, 35.68, 139.68, "b", [1.0] * 4)], [1.0] * 4, k=2)) == 1


def test_cap_and_brute_force(spark):
    r = random.Random(1)
    rows = [(float(i), BASE[0] + 0.01 * (i % 3), BASE[1], f"i{i}", [r.gauss(0, 1) for _ in range(4)]) for i in range(24)]
    q = [1.0, 0.5, -0.5, 0.2]
    sizes = [len(hits(spark, rows, q, top=24, cap=c)) for c in (1, 2, 8, 24)]
    assert sizes == [3, 6, 24, 24]
    dot = lambda v: sum(a * b for a, b in zip(v, q)) / sum(a * a for a in v) ** 0.5
    assert [x.exemplar_t for x in hits(spark, rows, q, top=5, cap=5)] == [t for t, *_ in sorted(rows, key=lambda x: -dot(x[4]))[:5]]


def test_reservoir_is_uniform(spark):
    few = mem(spark, [(float(i), *BASE, f"i{i}") for i in range(3)], exemplars=4)
    assert [r.seq for r in memory.exemplars(few).orderBy("seq").collect()] == [0, 1, 2]
    df = spark.range(4000).select(F.col("id").alias("seq"), (F.col("id") % 40).alias("cell"))
    key = scalars.hash60(F.concat_ws(":", F.lit(7), "cell", "seq"))
    from pyspark.sql.window import Window

    kept = df.withColumn("k", F.row_number().over(Window.partitionBy("cell").orderBy(key))).filter("k <= 20")
    early = kept.filter("seq < 2000").count()
    assert kept.count() == 800 and 340 < early < 460


def test_sketch_laws_and_error(spark):
    df = spark.range(30_000).select((F.col("id") % 3).alias("k"), scalars.hash60(F.col("id").cast("string")).alias("h"))
    regs = sketch.registers(df, ["k"], "h", 10)
    whole = sketch.estimate(sketch.merge(regs, []), [], 10).first()[0]
    direct = sketch.estimate(sketch.registers(df, [], "h", 10), [], 10).first()[0]
    assert whole == direct and abs(whole - 30_000) < 4 * sketch.error_bound(10) * 30_000
    small = sketch.estimate(sketch.registers(df.filter("h % 1000 = 0"), [], "h", 10), [], 10).first()[0]
    assert abs(small - df.filter("h % 1000 = 0").count()) < 4
    own = sketch.native_estimate(sketch.native(df, ["k"], "h", 12), []).first()[0]
    assert abs(own - 30_000) < 3000
    with pytest.raises(ValueError):
        sketch.register(F.lit(1), 3)


def test_running_max_and_late_rows(spark):
    r = random.Random(2)
    ts = [r.uniform(0, 1000) for _ in range(500)]
    df = spark.createDataFrame([(i, i % 3, t) for i, t in enumerate(ts)], "seq long, k int, ts double")
    got = {x.seq: x.m for x in running_max(df, "ts", "seq", "m", ["k"], chunk=7).collect()}
    assert all(got[i] == max(ts[j] for j in range(i % 3, i + 1, 3)) for i in got)
    late = spark.createDataFrame([(0, -5.0), (1, 10.0), (2, 31.0), (3, 12.0), (4, 40.0)], "seq long, ts double")
    assert [x.slot for x in assign_slots(late, 10.0).orderBy("seq").collect()] == [0, 0, 2, 2, 3]
    with pytest.raises(ValueError):
        assign_slots(late, 0.0)


def test_cells(spark):
    df = spark.createDataFrame([(0x8A194ACA6907FFF,)], "id long")
    row = df.select(cells.resolution_of(F.col("id")), cells.hex_string(F.col("id")), cells.hex_string(cells.parent_id(F.col("id"), 9)), cells.parent_id(F.col("id"), 11)).first()
    assert tuple(row) == (10, "8a194aca6907fff", "89194aca693ffff", None)
    grid = cells.HexGrid(37.0, -122.0)
    at = spark.range(200).select((37 + F.rand(1) * 0.1).alias("lat"), (-122 + F.rand(2) * 0.1).alias("lng")).withColumn("cell", grid.encode(F.col("lat"), F.col("lng"), 9))
    a, g = grid.center(F.col("cell"), 9)
    far = at.select(scalars.haversine_km(F.col("lat"), F.col("lng"), a, g).alias("d"), grid.encode(a, g, 9).alias("again"), "cell")
    assert far.filter((F.col("d") > 0.1744 * 1.01) | (F.col("again") != F.col("cell"))).count() == 0
    for k in (0, 1, 3, 20):
        assert cells.disk(at.limit(1), "cell", k).select("near").distinct().count() == 3 * k * (k + 1) + 1
    with pytest.raises(ValueError):
        MemoryConfig(resolution=16)


def test_plan_shapes(spark, sf):
    """Counting reads no vectors and aggregates partially; recall limits before it merges the window."""
    from wayhex.plans import core, data

    plan = lambda df: df._jdf.queryExecution().toString()
    counting = plan(memory.tile_summary(data.memory(spark, sf)))
    assert "embedding" not in counting and "partial_max" in counting
    assert "WindowGroupLimit" in plan(core.similar_global(spark, sf))
