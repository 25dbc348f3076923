"""HyperLogLog as a relation of registers: merging is a maximum, so everything aggregates partially."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HASH_BITS = 60


def register(hash60: Column, precision: int) -> tuple[Column, Column]:
    """(j, rho): the top bits choose the register, rho is the first set bit of the rest (all zero: one past the end)."""
    if not 4 <= precision <= 18:
        raise ValueError("precision must be in 4..18")
    rest = HASH_BITS - precision
    w = hash60.bitwiseAND((1 << rest) - 1)
    return F.shiftright(hash60, rest).cast("int"), F.when(w == 0, rest + 1).otherwise(rest - F.length(F.bin(w)) + 1)


def registers(df: DataFrame, keys: list[str], hash_col: str, precision: int) -> DataFrame:
    """(keys, j, rho)."""
    j, rho = register(F.col(hash_col), precision)
    return df.select(*keys, j.alias("j"), rho.alias("rho")).groupBy(*keys, "j").agg(F.max("rho").alias("rho"))


def merge(regs: DataFrame, keys: list[str]) -> DataFrame:
    return regs.groupBy(*keys, "j").agg(F.max("rho").alias("rho"))


def estimate_of(present: Column, powers: Column, precision: int) -> Column:
    """From the number of registers set and the sum of their 2**-rho; absent ones count 1. Linear counting below 2.5 m."""
    m = 1 << precision
    raw = 0.7213 / (1 + 1.079 / m) * m * m / (powers + (m - present))
    return F.when((raw <= 2.5 * m) & (present < m), m * F.log(m / (m - present))).otherwise(raw)


def estimate(regs: DataFrame, keys: list[str], precision: int, out: str = "n_distinct") -> DataFrame:
    """(keys, out) of merged registers."""
    powers = F.sum(F.pow(F.lit(2.0), -F.col("rho")))
    return regs.groupBy(*keys).agg(F.count(F.lit(1)).alias("_k"), powers.alias("_p")).select(*keys, estimate_of(F.col("_k"), F.col("_p"), precision).alias(out))


def over_time(obs: DataFrame, ticks: DataFrame, key: str, hash_col: str, precision: int, bucket_sec: float, capacity: int) -> DataFrame:
    """(key, ts, n_obs, accrued, windowed) at each tick (key, ts) of obs (key, ts, hash): distinct items so far, and in the last ``capacity`` buckets up to the tick.

    Buckets are epoch-aligned. Registers accrue by running maxima, a register of a key at a time; ticks needn't have rows, so the window decays in gaps.
    """
    j, rho = register(F.col(hash_col), precision)
    regs = obs.select(key, "ts", j.alias("j"), rho.alias("rho"))
    marks = ticks.select(key, "ts").distinct()
    # a tick comes after the rows of its instant
    at = marks.join(regs.select(key, "j").distinct(), key).select(key, "ts", "j", F.lit(None).cast("int").alias("rho"), F.lit(1).alias("tick"))
    rows = regs.select(key, "ts", "j", "rho", F.lit(0).alias("tick")).unionAll(at).withColumn("_b", F.floor(F.col("ts") / bucket_sec).cast("long"))
    own = Window.partitionBy(key, "j")
    upto = own.orderBy("ts", "tick").rowsBetween(Window.unboundedPreceding, 0)
    before = F.max("rho").over(own.orderBy("_b").rangeBetween(-(capacity - 1), -1)) if capacity > 1 else F.lit(None).cast("int")
    inside = Window.partitionBy(key, "j", "_b").orderBy("ts", "tick").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("a", F.max("rho").over(upto)).withColumn("w", F.greatest(before, F.max("rho").over(inside))).filter("tick = 1")
    powers = lambda c: F.coalesce(F.sum(F.pow(F.lit(2.0), -F.col(c))), F.lit(0.0))
    out = rows.groupBy(key, "ts").agg(F.count("a").alias("_k"), powers("a").alias("_p"), F.count("w").alias("_c"), powers("w").alias("_q"))
    counts = obs.select(key, "ts", F.lit(1).alias("n")).unionAll(marks.select(key, "ts", F.lit(0).alias("n")))
    seen = counts.withColumn("n_obs", F.sum("n").over(Window.partitionBy(key).orderBy("ts"))).groupBy(key, "ts").agg(F.max("n_obs").alias("n_obs"), F.min("n").alias("_m")).filter("_m = 0")
    return out.join(seen, [key, "ts"]).select(key, "ts", "n_obs", estimate_of(F.col("_k"), F.col("_p"), precision).alias("accrued"), estimate_of(F.col("_c"), F.col("_q"), precision).alias("windowed"))


def error_bound(precision: int) -> float:
    """The standard relative error."""
    return 1.04 / math.sqrt(1 << precision)


def native(df: DataFrame, keys: list[str], item: str, precision: int) -> DataFrame:
    """(keys, sketch): Spark's own sketches, for speed; not register-compatible with the relation."""
    return df.groupBy(*keys).agg(F.hll_sketch_agg(F.xxhash64(item), precision).alias("sketch"))


def native_estimate(sketches: DataFrame, keys: list[str], out: str = "n_distinct") -> DataFrame:
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias(out))
