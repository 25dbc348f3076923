"""Scalar column functions: hashes, vectors, geometry, motion, colours, intervals."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cells import DEG, EARTH_M

EARTH_KM = 6371.0
GRAVITY = 9.81


def hash60(text: Column) -> Column:
    """A 60-bit hash that any SQL engine with md5 can reproduce."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def dot(a: Column, b: Column) -> Column:
    """Inner product in doubles; null where a vector is null or sizes differ."""
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a norm is zero or sizes differ."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def normalize(a: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    h = F.pow(F.sin((lat2 - lat1) * (DEG / 2)), 2) + F.cos(lat1 * DEG) * F.cos(lat2 * DEG) * F.pow(F.sin((lng2 - lng1) * (DEG / 2)), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def snake_grid(t: Column, segment_sec: float, columns: int, step_deg: float, lat0: float = 0.0, lng0: float = 0.0) -> tuple[Column, Column, Column]:
    """(segment, lat, lng): time segments laid out row by row, odd rows backwards."""
    if segment_sec <= 0 or columns < 1:
        raise ValueError("segment_sec and columns must be positive")
    segment = F.floor(t / segment_sec)
    row, col = F.floor(segment / columns), F.pmod(segment, F.lit(columns))
    col = F.when(F.pmod(row, F.lit(2)) == 1, columns - 1 - col).otherwise(col)
    lat, lng = lat0 + row * step_deg, lng0 + col * step_deg
    good = (lat <= 89.0) & lng.between(-179.0, 179.0)
    checked = F.when(good, lat).otherwise(F.raise_error(F.lit("the snake grid leaves the valid coordinates")).cast("double"))
    return segment, checked, lng


def metres_to_degrees(x: Column, y: Column, lat0: float, lng0: float, per_degree: float = 111_320.0) -> tuple[Column, Column]:
    """East and north metres from an origin as (lat, lng)."""
    return y / per_degree + lat0, x / (per_degree * math.cos(lat0 * DEG)) + lng0


def interval_iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """0 where the union is empty."""
    shared = F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))
    union = (a1 - a0) + (b1 - b0) - shared
    return F.when(union > 0, shared / union).otherwise(0.0)


def motion_class(x: Column, y: Column, z: Column) -> Column:
    """By the deviation of the acceleration from gravity: under 0.5 stationary, under 3 walking, else running."""
    d = deviation(x, y, z)
    return F.when(d < 0.5, "stationary").when(d < 3.0, "walking").otherwise("running")


def deviation(x: Column, y: Column, z: Column) -> Column:
    return F.abs(F.sqrt(x * x + y * y + z * z) - GRAVITY)


def speed(motion: Column, d: Column) -> Column:
    """Metres per second, linear in the deviation: 0 stationary, 1.2 to 2.5 walking, 2.5 to 6 running (from 10 on)."""
    between = lambda lo, hi, a, b: a + F.least(F.greatest((d - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0)) * (b - a)
    return F.when(motion == "stationary", 0.0).when(motion == "walking", between(0.5, 3.0, 1.2, 2.5)).otherwise(between(3.0, 10.0, 2.5, 6.0))


def wrap_angle(a: Column) -> Column:
    """Into [-pi, pi]; values inside stay."""
    return F.when(F.abs(a) <= math.pi, a).otherwise(a - 2 * math.pi * F.rint(a / (2 * math.pi)))


def slippy_tile(lat: Column, lng: Column, zoom: int) -> tuple[Column, Column]:
    """Web-map tile (x, y)."""
    n = 1 << zoom
    rad = lat * DEG
    return F.floor((lng + 180.0) / 360.0 * n), F.floor((1.0 - F.log(F.tan(rad) + 1.0 / F.cos(rad)) / math.pi) / 2.0 * n)


def zoom_for(degrees: Column, most: int = 19) -> Column:
    """The zoom whose tiles show a half-span of degrees; 0.001 where it isn't positive."""
    half = F.when(degrees > 0, degrees).otherwise(0.001)
    return F.least(F.greatest(F.ceil(F.log2(360.0 / (2.0 * half))), F.lit(0)), F.lit(most)).cast("int")


#: Corners of the colour ramp, equal steps from cold to hot.
RAMP = ((0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 1, 1), (0, 0, 1), (1, 0, 1), (1, 1, 1))


def color_ramp(t: Column) -> Column:
    """(r, g, b, a) along the edges of the colour cube; t is clamped to 0..1, a = 0.7 + 0.3 t."""
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    steps = len(RAMP) - 1
    i = F.least(F.floor(t * steps), F.lit(steps - 1)).cast("int")
    f = t * steps - i
    parts = []
    for k, name in enumerate("rgb"):
        ends = F.array(*[F.lit(float(c[k])) for c in RAMP])
        parts.append((F.get(ends, i) + (F.get(ends, i + 1) - F.get(ends, i)) * f).alias(name))
    return F.struct(*parts, (0.7 + 0.3 * t).alias("a"))


def drive_id_epoch(text: Column) -> Column:
    """Unix seconds (UTC session) of YYYYMMDDHHMM."""
    return F.unix_timestamp(F.try_to_timestamp(text, F.lit("yyyyMMddHHmm")))


def video_skew(name: Column, first_iso: Column) -> Column:
    """Seconds from a video's start (YYYY-MM-DD-HH-MM-SS begins its name) to the first fix; 0 where either can't be read.

    A time with an offset is taken to the session's wall clock, in which videos are named; one without is that wall clock.
    """
    start = F.try_to_timestamp(F.substring(name, 1, 19), F.lit("yyyy-MM-dd-HH-mm-ss"))
    return F.coalesce(F.unix_micros(first_iso.try_cast("timestamp")) - F.unix_micros(start), F.lit(0)) / 1e6


def int_in(text: Column, least: int, most: int) -> Column:
    """A whole number in [least, most]; null for anything else, blanks after it too."""
    n = F.when(text.rlike(r"^\s*[+-]?[0-9]+$"), F.trim(text).try_cast("long"))
    return F.when(n.between(least, most), n)


def number_list(text: Column) -> Column:
    """The numbers of a list with commas; null where a part isn't one, empty parts are left out."""
    parts = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    numbers = F.transform(parts, lambda x: x.try_cast("double"))
    return F.when(F.forall(numbers, lambda x: x.isNotNull()), numbers)


def lat_lng_pair(text: Column) -> Column:
    """'LAT,LNG' as a struct; null where it isn't two valid numbers."""
    parts = F.split(text, ",")
    lat, lng = (F.get(parts, i).try_cast("double") for i in (0, 1))
    return F.when((F.size(parts) == 2) & lat.between(-90.0, 90.0) & lng.between(-180.0, 180.0), F.struct(lat.alias("lat"), lng.alias("lng")))


def first_choice(text: Column, k: int) -> Column:
    """The first integer in 1..k that stands in the text; null if there is none."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"(\d+)")), lambda x: x.try_cast("int"))
    return F.get(F.filter(found, lambda x: x.between(1, k)), F.lit(0))


def local_xy(lat: Column, lng: Column, lat0: Column, lng0: Column) -> tuple[Column, Column]:
    """East and north metres on the tangent plane at (lat0, lng0)."""
    return (lng - lng0) * DEG * EARTH_M * F.cos(lat0 * DEG), (lat - lat0) * DEG * EARTH_M


def min_max_map(values: Column) -> Column:
    """A map scaled to 0..1; all 0 where its range is 1e-8 or less."""
    lo, hi = F.array_min(values), F.array_max(values)
    return F.transform(values, lambda x: F.when(hi - lo > 1e-8, (x - lo) / (hi - lo)).otherwise(0.0))
