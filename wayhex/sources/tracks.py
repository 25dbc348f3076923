"""Track readers: GPS and IMU sidecars in JSON, positions in CSV and text, as tables of (file, ts, lat, lng, …)."""

from __future__ import annotations

import os
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.cells import DEG
from ..functions.scalars import metres_to_degrees
from ..operators.geo import near_median
from ..scratch import local_path

TINY = 1e-300
GPS = "array<struct<stream_id string, samples array<struct<timestamp double, utc_time_ms double, latitude double, longitude double>>>>"
IMU = "array<struct<stream_id string, samples array<struct<timestamp double, utc_time_ms double, accel array<double>, gyro array<double>>>>>"


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def _sidecar(spark: SparkSession, path: str, kind: str, good: Column) -> DataFrame:
    """(file, s): the valid samples of each file's stream that has most of them, the first on a tie."""
    docs = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", kind).alias("_a"))
    each = docs.select("file", F.posexplode("_a").alias("stream", "_s")).select("file", "stream", F.explode("_s.samples").alias("s"))
    each = each.filter(finite(F.col("s.timestamp")) & (F.abs("s.timestamp") >= TINY) & good)
    sizes = each.groupBy("file", "stream").agg(F.count(F.lit(1)).alias("n"))
    best = sizes.groupBy("file").agg(F.max_by("stream", F.struct("n", -F.col("stream"))).alias("stream"))
    return each.join(best, ["file", "stream"])


def _clock(rows: DataFrame) -> DataFrame:
    """Adds ts and offset: absolute time where all samples of the file have it; the offset is that of the earliest sample with both clocks."""
    utc = F.when(finite(F.col("s.utc_time_ms")) & (F.col("s.utc_time_ms") > 0), F.col("s.utc_time_ms") / 1000)
    per = rows.groupBy("file").agg((F.count(utc) == F.count(F.lit(1))).alias("_all"), F.min_by(utc - F.col("s.timestamp"), F.when(utc.isNotNull(), F.col("s.timestamp"))).alias("offset"))
    return rows.join(per, "file").withColumn("ts", F.when(F.col("_all"), utc).otherwise(F.col("s.timestamp"))).drop("_all")


def gps_sidecar(spark: SparkSession, path: str) -> DataFrame:
    """(file, ts, lat, lng, offset): positions that aren't finite or are (0, 0) are dropped."""
    a, g = F.col("s.latitude"), F.col("s.longitude")
    rows = _clock(_sidecar(spark, path, GPS, finite(a) & finite(g) & ~((a == 0) & (g == 0))))
    return rows.select("file", "ts", a.alias("lat"), g.alias("lng"), "offset")


def imu_sidecar(spark: SparkSession, path: str) -> DataFrame:
    """(file, ts, accel, gyro, offset): vectors of three finite numbers."""
    three = lambda c: (F.size(c) == 3) & F.forall(c, finite)
    rows = _clock(_sidecar(spark, path, IMU, three("s.accel") & three("s.gyro")))
    return rows.select("file", "ts", "s.accel", "s.gyro", "offset")


def capture_time(spark: SparkSession, path: str) -> DataFrame:
    """(file, epoch): tags.capture_time_epoch where it is a number, else null."""
    docs = spark.read.option("wholetext", True).text(path)
    return docs.select(F.col("_metadata.file_path").alias("file"), F.get_json_object("value", "$.tags.capture_time_epoch").try_cast("double").alias("epoch"))


def rtk_csv(spark: SparkSession, path: str, south: float = -90, north: float = 90, west: float = -180, east: float = 180, most_km: float = 80.0) -> DataFrame:
    """(file, ts, iso, lat, lng): columns time, ISO time, latitude, longitude, '#' comments.

    Drops rows that aren't finite, files of which less than half lies in the box, rows outside it and those far from their file's median place.
    """
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("ts", "iso", "lat", "lng")])
    raw = spark.read.schema(schema).option("comment", "#").csv(path)
    rows = raw.select(F.col("_metadata.file_path").alias("file"), F.col("ts").try_cast("double").alias("ts"), "iso", F.col("lat").try_cast("double").alias("lat"), F.col("lng").try_cast("double").alias("lng"))
    rows = rows.filter(finite(F.col("ts")) & finite(F.col("lat")) & finite(F.col("lng")))
    from ..operators.geo import box_guard

    return near_median(box_guard(rows, south, north, west, east, "file"), "file", most_km)


def moving(track: DataFrame, speeds: DataFrame, gate: float, hz: float, key: str = "file") -> DataFrame:
    """Rows faster than ``gate`` by the interpolated speed of (key, ts, speed), thinned to about ``hz`` a second."""
    from ..operators.align import decimate_stride, interpolate

    fast = interpolate(track, speeds, "ts", ["speed"], [key]).filter(F.col("speed") > gate)
    return decimate_stride(fast, "ts", "ts", 1.0 / hz, [key])


def slam_csv(spark: SparkSession, path: str) -> DataFrame:
    """(file, ts, x, y): microseconds to seconds, bad rows and repeated instants dropped (the first stays)."""
    raw = spark.read.option("header", True).csv(path)
    need = ("tracking_timestamp_us", "tx_world_device", "ty_world_device")
    missing = [c for c in need if c not in raw.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    rows = raw.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("_i"), (F.col(need[0]).try_cast("long") / 1e6).alias("ts"), F.col(need[1]).try_cast("double").alias("x"), F.col(need[2]).try_cast("double").alias("y"))
    first = F.row_number().over(Window.partitionBy("file", "ts").orderBy("_i"))
    return rows.filter("ts is not null and x is not null and y is not null").withColumn("_k", first).filter("_k = 1").drop("_k", "_i")


def clean_fixes(fixes: DataFrame, key: str = "file") -> DataFrame:
    """(key, ts, lat, lng) of a device's fixes (key, ns, lat, lng): nanoseconds to seconds; coordinates that aren't finite or out of range and repeated instants go (the first by place stays)."""
    from ..functions.cells import valid

    rows = fixes.filter(finite(F.col("lat")) & finite(F.col("lng")) & valid(F.col("lat"), F.col("lng")) & F.col("ns").isNotNull())
    first = rows.groupBy(key, "ns").agg(F.min(F.struct("lat", "lng")).alias("p"))
    return first.select(key, (F.col("ns") / 1e9).alias("ts"), "p.lat", "p.lng")


def project(track: DataFrame, lat0: float, lng0: float) -> DataFrame:
    """Metres (x east, y north) as coordinates around an origin."""
    lat, lng = metres_to_degrees(F.col("x"), F.col("y"), lat0, lng0)
    return track.withColumn("lat", lat).withColumn("lng", lng)


def rebase(track: DataFrame, key: str = "file") -> DataFrame:
    """Times from the start of each track."""
    start = track.groupBy(key).agg(F.min("ts").alias("_t0"))
    return track.join(start, key).withColumn("ts", F.col("ts") - F.col("_t0")).drop("_t0")


def sequence(track: DataFrame, origins: DataFrame, name: str, key: str = "file") -> DataFrame:
    """``track`` (key, name, ts, x, y) with its clock from 0 and lat, lng around the origin (prefix, lat0, lng0) of the longest prefix of its name."""
    from ..operators.align import longest_prefix

    named = longest_prefix(track.select(key, name).distinct(), origins, name, "prefix").select(key, "lat0", "lng0")
    rows = rebase(track, key).join(named, key)
    per = 111_320.0
    return rows.withColumn("lat", F.col("y") / per + F.col("lat0")).withColumn("lng", F.col("x") / (per * F.cos(F.col("lat0") * DEG)) + F.col("lng0")).drop("lat0", "lng0")


def take(track: DataFrame, frames: DataFrame, key: str) -> DataFrame:
    """``frames`` (key, ts from the track's start) with the track's rebased positions (x, y) interpolated at their instants, and lat, lng around (0, 0)."""
    from ..operators.align import interpolate

    return project(interpolate(frames, rebase(track, key), "ts", ["x", "y"], [key]), 0.0, 0.0)


def lidar_txt(spark: SparkSession, path: str) -> DataFrame:
    """(file, ts, x, y, z): white space, frame x y z and a quaternion, then the time; a line of under nine numbers fails the job."""
    parts = F.split(F.trim("value"), r"\s+")
    number = lambda i: F.get(parts, F.lit(i)).cast("double")
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value").filter(F.trim("value") != "")
    checked = F.when(F.size(parts) >= 9, number(8)).otherwise(F.raise_error(F.lit("a line has under nine columns")).cast("double"))
    return lines.select("file", checked.alias("ts"), number(1).alias("x"), number(2).alias("y"), number(3).alias("z"))


def discover(spark: SparkSession, root: str, needed: list[str]) -> DataFrame:
    """(sequence, files, complete): folders directly under root, and whether they hold a file of each needed name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    rest = F.regexp_replace(F.split("path", f"{root.rstrip('/').rsplit('/', 1)[-1]}/", 2)[1], "^/", "")
    rows = files.select(F.substring_index(rest, "/", 1).alias("sequence"), F.substring_index("path", "/", -1).alias("name"))
    has = [F.bool_or(F.col("name") == n) for n in needed]
    out = has[0] if has else F.lit(True)
    for h in has[1:]:
        out = out & h
    return rows.groupBy("sequence").agg(F.count(F.lit(1)).alias("files"), out.alias("complete"))


def file_names(spark: SparkSession, root: str, sequence: str, name: str) -> DataFrame:
    """(sequence, name) of the files under root, by regular expressions of their paths (the first group of ``name``); contents aren't read.

    Hidden files and folders are left out, as Spark does. On a local or mounted file system the driver lists the entries of root only, and
    tasks what is below them. On others the names are those that Spark's listing holds: a scan would open as many tasks as a few files each make.
    """
    top = local_path(spark, root)
    if top is None:
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).inputFiles()
        files = spark.createDataFrame([(unquote(x),) for x in listed], "path string")
    else:
        hidden = lambda x: x.startswith(".") or x.startswith("_") and "=" not in x or x.endswith("._COPYING_")

        def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = []
                for x in b.column(0).to_pylist():
                    at = os.path.join(top, x)
                    if not os.path.isdir(at):
                        found.append(at)
                        continue
                    for folder, folders, names in os.walk(at, onerror=_fail, followlinks=True):
                        folders[:] = [f for f in folders if not hidden(f)]
                        found += [os.path.join(folder, f) for f in names if not hidden(f)]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["path"])

        entries = [x for x in os.listdir(top) if not hidden(x)]
        files = spark.createDataFrame(pa.table({"entry": pa.array(entries, pa.string())})).repartition(spark.sparkContext.defaultParallelism).mapInArrow(below, "path string")
    return files.select(F.regexp_extract("path", sequence, 0).alias("sequence"), F.regexp_extract("path", name, 1).alias("name"))


def _fail(error: OSError) -> None:
    raise error


def probe(files: DataFrame, needed: list[str]) -> DataFrame:
    """(sequence, files, state) of (sequence, name): "ok", or the first needed name that has no file."""
    has = [F.bool_or(F.col("name") == n).alias(f"_{i}") for i, n in enumerate(needed)]
    out = files.groupBy("sequence").agg(F.count(F.lit(1)).alias("files"), *has)
    state = F.coalesce(*[F.when(~F.col(f"_{i}"), f"no file of the name {n}") for i, n in enumerate(needed)], F.lit("ok"))
    return out.select("sequence", "files", state.alias("state"))


def cache_prune(files: DataFrame, most_bytes: int) -> DataFrame:
    """The least recently used (path, bytes, mtime) to delete so that the rest fits: all but the newest that add up to most_bytes."""
    newest = Window.orderBy(F.desc("mtime"), F.desc("path")).rowsBetween(Window.unboundedPreceding, 0)
    return files.withColumn("_sum", F.sum("bytes").over(newest)).filter(F.col("_sum") > most_bytes).drop("_sum")
