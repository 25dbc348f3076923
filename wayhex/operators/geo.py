"""Analytics of places: coordinate transforms, revisits, gaps, coverage, dwell, growth, track quality."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.cells import DEG, EARTH_M
from ..functions.scalars import hash60, haversine_km


CHUNK = 1 << 16


def positions(df: DataFrame, order: str, out: str = "_i") -> DataFrame:
    """Adds each row's place (from 0) in the order of a long column, counted by chunks so that no task sees all rows.

    Chunks are equal parts of the column's range, as many as make CHUNK rows each if values are spread evenly, as ids and hashes are.
    """
    ends = df.agg(F.min(order).cast("double").alias("_least"), F.max(order).cast("double").alias("_most"), F.ceil(F.count(F.lit(1)) / CHUNK).alias("_parts"))
    chunk = F.floor((F.col(order) - F.col("_least")) / (F.col("_most") - F.col("_least") + 1) * F.col("_parts"))
    rows = df.crossJoin(F.broadcast(ends)).withColumn("_c", chunk).drop("_least", "_most", "_parts")
    before = Window.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("_c").agg(F.count(F.lit(1)).alias("_n")).select("_c", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_b"))
    return rows.join(sizes, "_c").withColumn(out, F.col("_b") + F.row_number().over(Window.partitionBy("_c").orderBy(order)) - 1).drop("_c", "_b")


def transform_coordinates(df: DataFrame, order: str, east_m: float = 0.0, north_m: float = 0.0, rotation_deg: float = 0.0, roll: float = 0.0, permute_seed: int | None = None) -> DataFrame:
    """(order, lat, lng) rotated around the mean place and moved; then rolled by a share of the rows or permuted, as null controls."""
    mean = df.agg(F.avg("lat").alias("_a"), F.avg("lng").alias("_g"), F.count(F.lit(1)).alias("_n"))
    rows = df.crossJoin(F.broadcast(mean))
    flat = EARTH_M * DEG * F.cos(F.col("_a") * DEG)
    x, y = (F.col("lng") - F.col("_g")) * flat, (F.col("lat") - F.col("_a")) * (EARTH_M * DEG)
    c, s = math.cos(math.radians(rotation_deg)), math.sin(math.radians(rotation_deg))
    rows = rows.select(order, (F.col("_a") + (s * x + c * y + north_m) / (EARTH_M * DEG)).alias("lat"), (F.col("_g") + (c * x - s * y + east_m) / flat).alias("lng"), "_n")
    if not roll and permute_seed is None:
        return rows.drop("_n")
    placed = positions(rows, order)
    if permute_seed is not None:
        key = hash60(F.concat_ws(":", F.lit(permute_seed), order))
        mixed = positions(rows.select(key.alias("_k"), "lat", "lng"), "_k")
        return placed.select(order, "_i").join(mixed.select("_i", "lat", "lng"), "_i").drop("_i")
    moved = placed.select(((F.col("_i") + F.rint(roll * F.col("_n")).cast("long")) % F.col("_n")).alias("_i"), "lat", "lng")
    return placed.select(order, "_i").join(moved, "_i").drop("_i")


def cell_visits(df: DataFrame) -> DataFrame:
    """(cell, drives, days, frames) of (cell, drive, day)."""
    return df.groupBy("cell").agg(F.count_distinct("drive").alias("drives"), F.count_distinct("day").alias("days"), F.count(F.lit(1)).alias("frames"))


def revisit_stats(visits: DataFrame) -> DataFrame:
    """One row: cells, those of two drives or days, the share of frames in the latter."""
    many = F.col("days") >= 2
    return visits.agg(
        F.count(F.lit(1)).alias("cells"), F.count_if(F.col("drives") >= 2).alias("drives2"), F.count_if(many).alias("days2"),
        (F.sum(F.when(many, F.col("frames")).otherwise(0)) / F.sum("frames")).alias("coverage"),
        F.count_if(F.col("days") == 1).alias("b1"), F.count_if(F.col("days").between(2, 4)).alias("b2_4"), F.count_if(F.col("days").between(5, 9)).alias("b5_9"), F.count_if(F.col("days") >= 10).alias("b10"),
    )


def normals(track: DataFrame, keys: list[str], ts: str = "ts", order: str = "seq") -> DataFrame:
    """Adds nx, ny: the unit normal of the line from the row before to the row after (an end counts as its own neighbour), left of the direction; 0, 0 where they fall together."""
    w = Window.partitionBy(*keys).orderBy(ts, order)
    before = lambda c: F.coalesce(F.lag(c).over(w), F.col(c))
    after = lambda c: F.coalesce(F.lead(c).over(w), F.col(c))
    rows = track.withColumn("_dx", after("lng") - before("lng")).withColumn("_dy", after("lat") - before("lat"))
    n = F.sqrt(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy"))
    part = lambda c: F.when(n > 0, c / n).otherwise(0.0)
    return rows.withColumn("nx", part(-F.col("_dy"))).withColumn("ny", part(F.col("_dx"))).drop("_dx", "_dy")


def day_gaps(df: DataFrame) -> DataFrame:
    """(cell, gap): days between successive distinct days of each cell."""
    days = df.select("cell", "day").distinct()
    gap = F.datediff("day", F.lag("day").over(Window.partitionBy("cell").orderBy("day")))
    return days.select("cell", gap.alias("gap")).filter("gap is not null")


def nearest_rank(df: DataFrame, value: str, shares: dict[str, float]) -> Column | DataFrame:
    """One row: for each name the value at rank rint(share (n-1)) of the ascending order, from a histogram of values."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    up = Window.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    total = Window.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    steps = counts.select(value, F.sum("n").over(up).alias("upto"), F.sum("n").over(total).alias("all"))
    return steps.agg(*[F.min(F.when(F.col("upto") > F.rint(q * (F.col("all") - 1)), F.col(value))).alias(name) for name, q in shares.items()])


def top_cells(visits: DataFrame, n: int) -> DataFrame:
    """The n most revisited cells: by days, drives, then cell."""
    return visits.orderBy(F.desc("days"), F.desc("drives"), "cell").limit(n)


def coverage_without_top(visits: DataFrame, ks: list[int]) -> DataFrame:
    """(k, coverage): the share of frames in cells of two days or more when the k busiest cells are left out."""
    busy = visits.orderBy(F.desc("frames"), "cell").limit(max(ks))
    rank = F.row_number().over(Window.orderBy(F.desc("frames"), "cell"))
    top = busy.withColumn("rank", rank)
    sums = lambda d, name: d.agg(F.sum("frames").alias("f" + name), F.sum(F.when(F.col("days") >= 2, F.col("frames")).otherwise(0)).alias("m" + name))
    whole = sums(visits, "")
    out = None
    for k in ks:
        part = whole.crossJoin(sums(top.filter(F.col("rank") <= k), "k"))
        row = part.select(F.lit(k).alias("k"), ((F.col("m") - F.coalesce("mk", F.lit(0))) / (F.col("f") - F.coalesce("fk", F.lit(0)))).alias("coverage"))
        out = row if out is None else out.unionAll(row)
    return out


def dwell(df: DataFrame, most_sec: float) -> DataFrame:
    """(cell, dwell_sec): each row dwells until the next of its drive, at most most_sec; df is (cell, drive, ts, seq)."""
    step = F.lead("ts").over(Window.partitionBy("drive").orderBy("ts", "seq")) - F.col("ts")
    return df.withColumn("_d", F.least(F.coalesce(step, F.lit(0.0)), F.lit(most_sec))).groupBy("cell").agg(F.sum("_d").alias("dwell_sec"))


def memory_model(dwells: DataFrame, fps: list[float], reservoir: int, dim: int, capacity: int, precision: int) -> DataFrame:
    """(fps, bounded_mb, dense_mb): exemplars capped by the reservoir plus each cell's ring, against a bank of all frames."""
    rows = dwells.withColumn("fps", F.explode(F.array(*[F.lit(float(x)) for x in fps])))
    frames = F.col("dwell_sec") * F.col("fps")
    out = rows.groupBy("fps").agg(F.sum(F.least(frames, F.lit(float(reservoir)))).alias("kept"), F.sum(frames).alias("all"), F.count(F.lit(1)).alias("cells"))
    return out.select("fps", ((F.col("kept") * 4 * dim + F.col("cells") * capacity * (1 << precision)) / 1e6).alias("bounded_mb"), (F.col("all") * 4 * dim / 1e6).alias("dense_mb"))


def growth(df: DataFrame) -> DataFrame:
    """(drive, new_cells, cells, frames): distinct cells and frames so far, drives in the order of their start; df is (cell, drive, ts)."""
    first = df.groupBy("cell").agg(F.min_by("drive", F.struct("ts", "drive")).alias("drive"))
    new = first.groupBy("drive").agg(F.count(F.lit(1)).alias("new_cells"))
    drives = df.groupBy("drive").agg(F.min("ts").alias("t"), F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("t", "drive").rowsBetween(Window.unboundedPreceding, 0)
    out = drives.join(new, "drive", "left").withColumn("new_cells", F.coalesce("new_cells", F.lit(0)))
    return out.select("drive", "new_cells", F.sum("new_cells").over(w).alias("cells"), F.sum("n").over(w).alias("frames"))


def box_guard(df: DataFrame, south: float, north: float, west: float, east: float, key: str, least: float = 0.5) -> DataFrame:
    """Rows in the box, of files (key) of which at least a share ``least`` lies in it."""
    good = F.col("lat").between(south, north) & F.col("lng").between(west, east)
    share = df.groupBy(key).agg(F.avg(good.cast("double")).alias("_share")).filter(F.col("_share") >= least)
    return df.filter(good).join(share.select(key), key, "left_semi")


def near_median(df: DataFrame, key: str, most_km: float) -> DataFrame:
    """Rows at most most_km from their file's median place."""
    mid = df.groupBy(key).agg(F.median("lat").alias("_a"), F.median("lng").alias("_g"))
    return df.join(mid, key).filter(haversine_km(F.col("lat"), F.col("lng"), F.col("_a"), F.col("_g")) <= most_km).drop("_a", "_g")


def track_length(df: DataFrame, key: str) -> DataFrame:
    """(key, metres, extent_m, diagonal_m, points): path length and extents of (key, ts, seq, lat, lng) on its mean's tangent plane."""
    mean = df.groupBy(key).agg(F.avg("lat").alias("_a"))
    rows = df.join(mean, key).withColumn("x", F.col("lng") * (DEG * EARTH_M) * F.cos(F.col("_a") * DEG)).withColumn("y", F.col("lat") * (DEG * EARTH_M))
    w = Window.partitionBy(key).orderBy("ts", "seq")
    step = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    out = rows.withColumn("_s", step).groupBy(key).agg(F.sum("_s").alias("metres"), (F.max("x") - F.min("x")).alias("dx"), (F.max("y") - F.min("y")).alias("dy"), F.count(F.lit(1)).alias("points"))
    return out.select(key, F.coalesce("metres", F.lit(0.0)).alias("metres"), F.greatest("dx", "dy").alias("extent_m"), F.hypot("dx", "dy").alias("diagonal_m"), "points")


def mobility_tier(metres: Column) -> Column:
    return F.when(metres >= 50, "street").when(metres >= 15, "building").when(metres >= 5, "room").otherwise("sub-room")


def course(df: DataFrame, key: str, distinct: bool = True) -> DataFrame:
    """Adds bearing (degrees from north) from the last distinct place of the key before each row, or (not ``distinct``) from the row before, 0 where they fall together; null at the first."""
    w = Window.partitionBy(key).orderBy("ts", "seq")
    before = F.struct(F.lag("lat").over(w).alias("a"), F.lag("lng").over(w).alias("g"))
    if distinct:
        moved = F.coalesce((F.col("lat") != F.lag("lat").over(w)) | (F.col("lng") != F.lag("lng").over(w)), F.lit(False))
        df = df.withColumn("_from", F.when(moved, before))
        before = F.last(F.col("_from"), True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = df.withColumn("_p", before)
    dy, dx = F.col("lat") - F.col("_p.a"), (F.col("lng") - F.col("_p.g")) * F.cos(F.col("lat") * DEG)
    return out.withColumn("bearing", F.degrees(F.atan2(dx, dy))).drop("_from", "_p")


def inventory(tracks: DataFrame, counts: list[DataFrame], key: str) -> DataFrame:
    """Sessions with their tracks' figures, rank by path length and tier, and counts (key, …) from other tables (missing: 0)."""
    out = tracks.withColumn("tier", mobility_tier(F.col("metres")))
    for c in counts:
        names = [n for n in c.columns if n != key]
        out = out.join(c, key, "left").fillna(0, names)
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("metres", 3)), key)))


def one_per_tier(tracks: DataFrame, key: str) -> DataFrame:
    """The longest session of each mobility tier."""
    best = F.row_number().over(Window.partitionBy("tier").orderBy(F.desc(F.round("metres", 3)), key))
    return tracks.withColumn("tier", mobility_tier(F.col("metres"))).withColumn("_k", best).filter("_k = 1").drop("_k")


def centered_mean(df: DataFrame, value: str, width_sec: float, keys: list[str], ts: str = "ts", out: str = "mean") -> DataFrame:
    """Adds the mean of ``value`` over rows of the same keys at most width_sec / 2 away, both ends included."""
    half = int(round(width_sec * 5e5))
    w = Window.partitionBy(*keys).orderBy(F.round(F.col(ts) * 1e6).cast("long")).rangeBetween(-half, half)
    return df.withColumn(out, F.avg(value).over(w))
