"""Inertial motion per session: heading, pitch and dead reckoning, as array work over sorted batches.

Gravity, latitude and longitude are linear recurrences, the heading is a sum: each is solved for a batch at once, from the state that the batch before left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions.cells import DEG
from ..functions.scalars import GRAVITY
from .sequential import follow, recurrence

EARTH_M = 6371000.0
GRAVITY_SHARE = 0.02
LONGEST_STEP = 5.0
MOTIONS = np.array(["stationary", "walking", "running"], object)


class Reckoner:
    """Follows one session: gravity is a running average of the acceleration, turning about it moves the heading."""

    def __init__(self, blend: float):
        self.blend = blend
        self.before, self.heading, self.gravity, self.place = np.nan, 0.0, np.zeros(3), np.zeros(2)

    def follow(self, t: np.ndarray, accel: np.ndarray, gyro: np.ndarray, lat: np.ndarray, lng: np.ndarray) -> tuple[np.ndarray, ...]:
        """(motion, heading, pitch, lat, lng) after each sample. Steps that aren't in (0, 5] s turn nothing and snap to the fix."""
        force = np.sqrt((accel * accel).sum(axis=1))
        off = np.abs(force - GRAVITY)
        kind = np.digitize(off, (0.5, 3.0))
        dt = np.diff(t, prepend=self.before)
        first = np.isnan(dt)
        moving = ~first & (dt > 0.0) & (dt <= LONGEST_STEP)

        keep = np.where(first, 0.0, 1 - GRAVITY_SHARE)
        gravity = np.stack([recurrence(keep, np.where(first, 1.0, GRAVITY_SHARE) * accel[:, k], self.gravity[k]) for k in range(3)], axis=1)
        size = np.sqrt((gravity * gravity).sum(axis=1))
        up = gravity * np.where(size >= 1.0, 1 / np.where(size >= 1.0, size, 1.0), 0.0)[:, None]
        pitch = np.arcsin(np.clip(-up[:, 2], -1.0, 1.0))

        turns = np.where(moving, np.nan_to_num(dt) * (gyro * up).sum(axis=1), 0.0)
        heading = self.heading - np.cumsum(turns)
        heading = np.where(np.abs(heading) <= np.pi, heading, heading - 2 * np.pi * np.round(heading / (2 * np.pi)))

        speed = np.choose(kind, (np.zeros(len(off)), 1.2 + np.clip((off - 0.5) / 2.5, 0, 1) * 1.3, 2.5 + np.clip((off - 3) / 7, 0, 1) * 3.5))
        degrees = np.where(moving, speed * np.nan_to_num(dt), 0.0) / (EARTH_M * DEG)
        share = np.where(moving, self.blend, 0.0)
        lat = recurrence(share, share * degrees * np.cos(heading) + (1 - share) * lat, self.place[0])
        from_lat = np.concatenate((self.place[:1], lat[:-1]))
        lng = recurrence(share, share * degrees * np.sin(heading) / np.cos(from_lat * DEG) + (1 - share) * lng, self.place[1])
        if len(t):
            self.before, self.heading, self.gravity, self.place = float(t[-1]), float(heading[-1]), gravity[-1], np.array([lat[-1], lng[-1]])
        return MOTIONS[kind], heading, pitch, lat, lng

    def step(self, t: float, accel: tuple[float, ...], gyro: tuple[float, ...], lat: float, lng: float) -> tuple[str, float, float, float, float]:
        """follow() for one sample."""
        out = self.follow(np.array([t], float), np.array([accel], float), np.array([gyro], float), np.array([lat], float), np.array([lng], float))
        return (out[0][0], *(float(x[0]) for x in out[1:]))


def dead_reckon(samples: DataFrame, blend: float = 1.0, session: str = "session") -> DataFrame:
    """(session, seq, motion, heading, pitch, lat, lng) of samples (session, seq, ts, accel, gyro, lat, lng); the last two are the fixes."""
    kind = samples.schema[session].dataType.simpleString()

    def work(parts: Iterator[tuple[bool, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        own = Reckoner(blend)
        for new, rows in parts:
            own = Reckoner(blend) if new else own
            columns = [np.stack(rows[c].to_numpy()) if c in ("accel", "gyro") else rows[c].to_numpy(float) for c in ("ts", "accel", "gyro", "lat", "lng")]
            motion, heading, pitch, lat, lng = own.follow(*columns)
            yield pd.DataFrame({session: rows[session].to_numpy(), "seq": rows["seq"].to_numpy(), "motion": motion, "heading": heading, "pitch": pitch, "lat": lat, "lng": lng})

    rows = samples.select(session, "seq", "ts", "accel", "gyro", "lat", "lng")
    return follow(rows, session, ["ts", "seq"], work, f"{session} {kind}, seq long, motion string, heading double, pitch double, lat double, lng double")
