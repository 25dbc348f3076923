"""Immutable settings of a spatial memory."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class MemoryConfig:
    """resolution 0-15, capacity slots >= 1, HLL precision 4-18, exemplars per cell >= 0, slot width in seconds > 0."""

    resolution: int = 10
    capacity: int = 12
    precision: int = 10
    exemplars: int = 8
    window_sec: float = 5.0
    codec: str = "raw"
    seed: int = 42

    def __post_init__(self) -> None:
        if not 0 <= self.resolution <= 15:
            raise ValueError("resolution must be in 0..15")
        if self.capacity < 1:
            raise ValueError("capacity must be at least 1")
        if not 4 <= self.precision <= 18:
            raise ValueError("precision must be in 4..18")
        if self.exemplars < 0:
            raise ValueError("exemplars must not be negative")
        if not self.window_sec > 0:
            raise ValueError("window_sec must be positive")
        if self.codec not in ("raw", "2b", "3b", "4b"):
            raise ValueError(f"unknown codec {self.codec}")
