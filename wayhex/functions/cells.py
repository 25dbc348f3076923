"""Hexagonal cells as column expressions.

A cell is a BIGINT: resolution, then axial coordinates q and r on a tangent plane,
pointy-top. The plane's origin is a setting; cells aren't hierarchical. ``parent_id`` and
``resolution_of`` instead read ids in the public 64-bit hierarchical layout (mode, resolution, base cell, 3-bit digits).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Mean edge length in metres by resolution, of the published hexagon table.
EDGE_M = (1107712.591, 418676.005, 158244.656, 59810.858, 22606.379, 8544.408, 3229.483, 1220.629, 461.355, 174.375668, 65.907807, 24.910561, 9.415526, 3.559893, 1.348575, 0.509713)
EARTH_M = 6371008.8
DEG = math.pi / 180
_HALF = 1 << 27


def valid(lat: Column, lng: Column) -> Column:
    """Closed ranges; false for NaN and null."""
    return F.coalesce(lat.between(-90.0, 90.0) & lng.between(-180.0, 180.0), F.lit(False))


@dataclass(frozen=True)
class HexGrid:
    """Cells around an origin in degrees."""

    lat0: float = 0.0
    lng0: float = 0.0

    @property
    def scale(self) -> float:
        """Metres per radian of longitude."""
        return EARTH_M * math.cos(self.lat0 * DEG)

    def axial(self, lat: Column, lng: Column, res: int) -> tuple[Column, Column]:
        """Rounded axial coordinates (doubles)."""
        x, y = (lng - self.lng0) * DEG * self.scale, (lat - self.lat0) * DEG * EARTH_M
        q = (x * (math.sqrt(3) / 3) - y * (1 / 3)) / EDGE_M[res]
        r = y * (2 / 3) / EDGE_M[res]
        s = -q - r
        rq, rr, rs = F.rint(q), F.rint(r), F.rint(s)
        dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
        first = (dq > dr) & (dq > ds)
        return F.when(first, -rr - rs).otherwise(rq), F.when(~first & (dr > ds), -rq - rs).otherwise(rr)

    def encode(self, lat: Column, lng: Column, res: int) -> Column:
        """The cell of a point; null where the point is invalid."""
        q, r = self.axial(lat, lng, res)
        return F.when(valid(lat, lng), pack(F.lit(res), q.cast("long"), r.cast("long")))

    def center(self, cell: Column, res: int) -> tuple[Column, Column]:
        """(lat, lng) of a cell's centre."""
        q, r = q_of(cell), r_of(cell)
        x, y = EDGE_M[res] * (math.sqrt(3) * q + math.sqrt(3) / 2 * r), EDGE_M[res] * 1.5 * r
        return y / (EARTH_M * DEG) + self.lat0, x / (self.scale * DEG) + self.lng0


def pack(res: Column, q: Column, r: Column) -> Column:
    return F.shiftleft(res.cast("long"), 56).bitwiseOR(F.shiftleft(q + _HALF, 28)).bitwiseOR(r + _HALF)


def q_of(cell: Column) -> Column:
    return F.shiftright(cell, 28).bitwiseAND((1 << 28) - 1) - _HALF


def r_of(cell: Column) -> Column:
    return cell.bitwiseAND((1 << 28) - 1) - _HALF


def disk(points: DataFrame, cell: str, k: int, out: str = "near") -> DataFrame:
    """Each row once for every cell at most k steps away: 3k(k+1)+1 rows; none for a negative k."""
    if k < 0:
        return points.limit(0).withColumn(out, F.col(cell))
    offsets = [(q, r) for q in range(-k, k + 1) for r in range(max(-k, -q - k), min(k, -q + k) + 1)]
    if len(offsets) <= 500:
        move = F.explode(F.array(*[F.struct(F.lit(q).cast("long").alias("q"), F.lit(r).cast("long").alias("r")) for q, r in offsets]))
        spread = points.withColumn("_d", move)
    else:
        span = F.sequence(F.lit(-k).cast("long"), F.lit(k).cast("long"))
        spread = points.withColumn("_q", F.explode(span)).withColumn("_r", F.explode(span)).filter(F.abs(F.col("_q") + F.col("_r")) <= k)
        spread = spread.withColumn("_d", F.struct(F.col("_q").alias("q"), F.col("_r").alias("r"))).drop("_q", "_r")
    return spread.withColumn(out, F.col(cell) + F.shiftleft(F.col("_d.q"), 28) + F.col("_d.r")).drop("_d")


def resolution_of(index: Column) -> Column:
    """The resolution of a hierarchical 64-bit id."""
    return F.shiftright(index, 52).bitwiseAND(15).cast("int")


def parent_id(index: Column, res: int) -> Column:
    """The ancestor of a hierarchical 64-bit id: finer digits become 7. Null where the id is coarser than res."""
    ones = (1 << (3 * (15 - res))) - 1
    out = index.bitwiseAND(~(15 << 52)).bitwiseOR(F.lit(res << 52).cast("long")).bitwiseOR(F.lit(ones).cast("long"))
    return F.when(resolution_of(index) >= res, out)


def hex_string(index: Column) -> Column:
    return F.lower(F.hex(index))
