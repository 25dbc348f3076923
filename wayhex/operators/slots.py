"""Time slots by the running maximum of timestamps, in closed form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CHUNK = 1 << 16


def running_max(df: DataFrame, value: str, order: str, out: str, keys: list[str] | None = None, chunk: int = CHUNK) -> DataFrame:
    """The maximum of ``value`` over all rows up to this one by ``order`` (a long), within ``keys``.

    In two steps, so that a long stream isn't one task: the maxima of chunks of
    ``order`` first, then within each chunk.
    """
    keys = keys or []
    parts = df.withColumn("_chunk", F.floor(F.col(order) / chunk))
    tops = parts.groupBy(*keys, "_chunk").agg(F.max(value).alias("_top"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*keys, "_chunk", F.max("_top").over(before).alias("_before"))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return parts.join(tops, [*keys, "_chunk"]).withColumn(out, F.greatest(F.max(value).over(inside), F.coalesce(F.col("_before"), F.col(value)))).drop("_chunk", "_before")


def assign_slots(df: DataFrame, window_sec: float, ts: str = "ts", order: str = "seq", keys: list[str] | None = None) -> DataFrame:
    """Adds slot (long): whole windows between the stream's first timestamp >= 0 and the latest up to this row.

    Late rows fall in the current slot. Rows before the anchor have slot 0.
    """
    if not window_sec > 0:
        raise ValueError("window_sec must be positive")
    keys = keys or []
    anchor = df.filter(F.col(ts) >= 0).groupBy(*keys).agg(F.min_by(ts, order).alias("_t0"))
    out = running_max(df, ts, order, "_latest", keys)
    out = out.join(anchor, keys, "left") if keys else out.crossJoin(F.broadcast(anchor))
    slot = F.greatest(F.floor((F.col("_latest") - F.col("_t0")) / window_sec), F.lit(0))
    return out.withColumn("slot", F.coalesce(slot, F.lit(0)).cast("long")).drop("_latest", "_t0")


def last_slot(df: DataFrame, window_sec: float, ts: str = "ts", order: str = "seq") -> DataFrame:
    """One row (last_slot): the greatest slot of assign_slots(), from two aggregates."""
    ends = df.agg(F.max(ts).alias("_m"), F.min_by(F.col(ts), F.when(F.col(ts) >= 0, F.col(order))).alias("_t0"), F.count(F.lit(1)).alias("_n"))
    slot = F.greatest(F.floor((F.col("_m") - F.col("_t0")) / window_sec), F.lit(0))
    return ends.select(F.when(F.col("_n") > 0, F.coalesce(slot, F.lit(0))).cast("long").alias("last_slot"))


def event_slots(df: DataFrame, window_sec: float, ts: str = "ts", out: str = "slot") -> DataFrame:
    """Adds the epoch-aligned slot floor(ts / window_sec)."""
    return df.withColumn(out, F.floor(F.col(ts) / window_sec).cast("long"))
