import collections
import struct
import zlib

import xxhash
from pyspark.sql import functions as F

from wayhex.llm import queries, sharding

from .common import awkward, frame


def test_query_follows_its_law(spark, sf):
    rows = queries.op2_external_shuffle(spark, sf).collect()
    docs = {d.doc_id: (d.text or "").encode() for d in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.size == len(docs[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(docs[r.doc_id]) and r.law == "rows" and r.grown_shard is None for r in rows)
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_order_is_seeded_and_mixed(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    order = lambda **x: [r.doc_id for r in sharding.external_shuffle(docs, **x).orderBy("shard", "slot").collect()]
    one = order(bucket_bytes=20_000)
    assert one == order(bucket_bytes=20_000) != order(bucket_bytes=20_000, seed=1)
    assert sorted(one) == sorted(order()) and one != sorted(one)
    assert sum(abs(a - b) == 1 for a, b in zip(one, one[1:])) < len(one) / 5


def test_awkward_rows_and_files(spark, tmp_path):
    df = frame(spark, [*awkward(), *[(9, "hot")] * 300]).withColumnRenamed("lang", "shard").withColumnRenamed("source", "_key")
    rows = sharding.external_shuffle(df, shards=5, bucket_bytes=500).collect()
    assert collections.Counter((r.doc_id, r.text) for r in rows) == collections.Counter((r[0], r[1]) for r in [*awkward(), *[(9, "hot")] * 300])
    sizes = collections.Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert sharding.external_shuffle(df.limit(0)).collect() == []
    back = sharding.write_shards(df, str(tmp_path / "out"), shards=3)
    assert back.count() == 309 and {r.shard for r in back.select("shard").distinct().collect()} == {0, 1, 2}


def spark_hash(value, kind, seed):
    """xxHash64 of one value as Spark takes it: a signed number."""
    h = xxhash.xxh64_intdigest(struct.pack(kind, value), seed % 2**64)
    return h - 2**64 if h >= 2**63 else h


def test_order_against_a_plain_version(spark, sf):
    """The permutation anew: hashes of places, buckets one after another, each shuffled; shards are equal runs."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("place"), F.octet_length("text").alias("n")).collect()
    buckets = -(-sum((r.n or 0) + 64 for r in rows) // 50_000)
    keyed = [(spark_hash(r.place, "<q", spark_hash(7, "<i", 42)), r.doc_id) for r in rows]
    order = []
    for b in range(buckets):
        own = [d for k, d in sorted(x for x in keyed if x[0] % buckets == b)]
        order += [own[i] for i in sharding.fisher_yates(len(own), (7, b))]
    n = len(order)
    want = {}
    for s in range(16):
        run = [i for i in range(n) if i * 16 // n == s]
        want |= {order[i]: (s, i - run[0]) for i in run}
    got = {r.doc_id: (r.shard, r.slot) for r in sharding.external_shuffle(docs, seed=7, bucket_bytes=50_000).collect()}
    assert got == want and buckets > 3


def test_fisher_yates_is_uniform():
    seen = collections.Counter(tuple(sharding.fisher_yates(3, (1, i))) for i in range(6000))
    assert len(seen) == 6 and all(800 < n < 1200 for n in seen.values())
