"""Sharding by a two-pass external shuffle.

Pass one scatters the records uniformly, by a seeded hash, into buckets sized to
memory. Pass two applies a Fisher-Yates shuffle to each bucket. The buckets
in order are one uniform permutation of all records; shards are equal
runs of it, so their counts differ by one at most.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .storage import written


SHARDS = 16
SEED = 42
BUCKET_BYTES = 8 << 20
#: The buckets' places are a table, broadcast if it has at most so many rows of 16 bytes, and joined by sorting beyond.
MOST_BROADCAST = 1 << 20
#: Buckets whose counts are summed up in one task.
RUN = 1 << 12


def fisher_yates(n: int, seed: tuple[int, ...]) -> np.ndarray:
    """A uniform permutation of range(n), drawn by the Fisher-Yates shuffle."""
    order = np.arange(n)
    np.random.default_rng(seed).shuffle(order)  # NumPy's shuffle of one axis is Fisher-Yates
    return order


def external_shuffle(df: DataFrame, text_col: str = "text", shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The records of ``df``, all columns, with shard (int) and slot (long, gapless from 0 in each shard).

    The hash takes a record's place in ``df``, so that repeated rows and hot keys scatter like any others; ``df`` should be
    a table's scan, whose rows have the same places when a task runs again. Within a bucket
    records are put in the order of that hash before they are shuffled. The shuffled buckets are written once, and
    their sizes, which give each its run of the permutation, are counted from what was written, and stay in a table. A null text counts as empty. Columns named shard, slot and
    starting with _bucket, _key, _place or _run are replaced. An empty table gives an empty result; shards may stay empty. A record longer than
    ``bucket_bytes`` makes its bucket that much larger. The permutation depends on the seed and on the table's files and their splits.
    """
    own = [c for c in df.columns if c not in ("shard", "slot") and not c.startswith(("_bucket", "_key", "_place", "_run"))]
    size = df.agg(F.sum(F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + 64)).first()[0]
    buckets = max(1, -(-(size or 0) // bucket_bytes))
    placed = df.select(*own, F.monotonically_increasing_id().alias("_key"))
    placed = placed.withColumn("_key", F.xxhash64(F.lit(seed), "_key")).withColumn("_bucket", F.pmod("_key", F.lit(buckets)))

    def shuffle(bucket: pa.Table) -> pa.Table:
        keys = bucket.column("_key").to_numpy()
        number = bucket.column("_bucket")[0].as_py()
        return bucket.take(np.argsort(keys, kind="stable")[fisher_yates(len(keys), (seed, number))]).append_column("_place", pa.array(np.arange(len(keys))))

    schema = T.StructType([*placed.schema.fields, T.StructField("_place", T.LongType())])
    mixed = written(placed.groupBy("_bucket").applyInArrow(shuffle, schema).drop("_key"), "shuffled")
    before = written(bucket_starts(mixed), "buckets")
    before = F.broadcast(before) if buckets <= MOST_BROADCAST else before
    at = F.col("_before") + F.col("_place")
    shard = F.expr(f"(_before + _place) * {shards} div _total")
    out = mixed.join(before, "_bucket").select(*own, shard.cast("int").alias("shard"), at.alias("_at"), "_total")
    # the first place of shard s is the least n with n * shards >= s * total
    return out.select(*own, "shard", (F.col("_at") - F.expr(f"(shard * _total + {shards - 1}) div {shards}")).alias("slot"))


def bucket_starts(mixed: DataFrame) -> DataFrame:
    """(_bucket, _before, _total): the number of records in lower buckets and in all, by prefix sums in runs of RUN buckets."""
    sizes = mixed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")).withColumn("_run", F.expr(f"_bucket div {RUN}"))
    runs = sizes.groupBy("_run").agg(F.sum("_n").alias("_s"))
    lower = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = runs.select("_run", F.coalesce(F.sum("_s").over(lower), F.lit(0)).alias("_low"), F.sum("_s").over(everything).alias("_total"))
    inside = Window.partitionBy("_run").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    return sizes.join(runs, "_run").select("_bucket", (F.col("_low") + F.col("_in")).alias("_before"), "_total")


def write_shards(df: DataFrame, path: str, **options) -> DataFrame:  # noqa: ANN003
    """Writes the shards under path/shard=N as Parquet in slot order, and returns them as read back."""
    out = external_shuffle(df, **options)
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return df.sparkSession.read.parquet(path)
