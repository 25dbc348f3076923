"""The observation stream and the question set that the registered queries share, in Spark and in SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import MemoryConfig
from ..functions.cells import DEG, EARTH_M, EDGE_M, HexGrid
from ..operators.memory import Memory, observe

GRID = HexGrid(37.0, -122.0)
CFG = MemoryConfig(resolution=10, capacity=12, precision=10, exemplars=8, window_sec=86400.0)
GT_SEC = 3600.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """observed() of all events."""
    return observed(table(spark, sf_dir, "events"))


def observed(events: DataFrame) -> DataFrame:
    """(seq, ts, session, day, lat, lng, item, value) of events, at derived places."""
    e, u = F.col("event_id"), F.col("user_id")
    lat = 37.0 + (u % 10) * 2e-2 + ((e * 7919) % 1000) / 1e6
    lng = -122.0 + (u % 7) * 2e-2 + ((e * 104729) % 1000) / 1e6
    ts = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return events.select(e.alias("seq"), ts.alias("ts"), u.alias("session"), F.to_date("ts").alias("day"), lat.alias("lat"), lng.alias("lng"), F.concat("event_type", F.lit("|"), "props").alias("item"), "value")


def memory(spark: SparkSession, sf_dir: str, cfg: MemoryConfig = CFG) -> Memory:
    return observe(observations(spark, sf_dir), cfg, GRID)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"), "label")


def with_vectors(df: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with the vector and label of embedding seq % number of embeddings."""
    v = vectors(spark, sf_dir)
    n = v.agg(F.count(F.lit(1)).alias("_n"))
    return df.crossJoin(F.broadcast(n)).withColumn("vec_id", F.col("seq") % F.col("_n")).drop("_n").join(v, "vec_id")


def with_vector_ids(df: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """As with_vectors(), with the vector's id alone."""
    n = vectors(spark, sf_dir).agg(F.count(F.lit(1)).alias("_n"))
    return df.crossJoin(F.broadcast(n)).withColumn("vec_id", F.col("seq") % F.col("_n")).drop("_n")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query set: every embedding whose id is divisible by 20, as (qid, qvec, category, lat, lng)."""
    q = vectors(spark, sf_dir).filter("vec_id % 20 = 0")
    return q.select(F.col("vec_id").alias("qid"), F.col("vec").alias("qvec"), F.col("label").alias("category"), (37.0 + (F.col("vec_id") % 10) * 2e-2).alias("lat"), (-122.0 + (F.col("vec_id") % 7) * 2e-2).alias("lng"))


def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, start, end): around every observation of a question's vector."""
    seen = with_vector_ids(observations(spark, sf_dir).select("seq", "ts"), spark, sf_dir).select(F.col("vec_id").alias("qid"), "ts")
    return seen.join(questions(spark, sf_dir).select("qid"), "qid").select("qid", (F.col("ts") - GT_SEC).alias("start"), (F.col("ts") + GT_SEC).alias("end"))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(point_id, lat, lng): the base place of every customer, and an invalid one."""
    c = F.col("c_custkey")
    lat = F.when(c == 1, 100.0).otherwise(37.0 + (c % 10) * 2e-2 + 4e-4)
    return table(spark, sf_dir, "customer").select(c.alias("point_id"), lat.alias("lat"), (-122.0 + (c % 7) * 2e-2 + 4e-4).alias("lng"))


def sql_num(x: float) -> str:
    return f"{x!r}::DOUBLE"


def cell_sql(lat: str = "lat", lng: str = "lng", res: int = CFG.resolution, grid: HexGrid = GRID) -> str:
    """A scalar subquery-free expression of HexGrid.encode."""
    x = f"(({lng} - {sql_num(grid.lng0)}) * {sql_num(DEG)} * {sql_num(grid.scale)})"
    y = f"(({lat} - {sql_num(grid.lat0)}) * {sql_num(DEG)} * {sql_num(EARTH_M)})"
    q = f"(({x} * {sql_num(math.sqrt(3) / 3)} - {y} * {sql_num(1 / 3)}) / {sql_num(EDGE_M[res])})"
    r = f"({y} * {sql_num(2 / 3)} / {sql_num(EDGE_M[res])})"
    s = f"(-{q} - {r})"
    rq, rr, rs = (f"round_even({v}, 0)" for v in (q, r, s))
    dq, dr, ds = (f"abs({a} - {b})" for a, b in ((rq, q), (rr, r), (rs, s)))
    first = f"({dq} > {dr} AND {dq} > {ds})"
    aq = f"CASE WHEN {first} THEN -{rr} - {rs} ELSE {rq} END"
    ar = f"CASE WHEN NOT {first} AND {dr} > {ds} THEN -{rq} - {rs} ELSE {rr} END"
    return f"CASE WHEN {lat} BETWEEN -90 AND 90 AND {lng} BETWEEN -180 AND 180 THEN ({res}::BIGINT << 56) | ((({aq})::BIGINT + 134217728) << 28) | (({ar})::BIGINT + 134217728) END"


def hash_sql(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 15))::BIGINT"


#: CTEs: observations o, with cells and slots v; l holds the last slot. Each ends without a comma.
OBS = """o AS (SELECT event_id AS seq, epoch_us(ts) / 1e6 AS ts, user_id AS session, CAST(ts AS DATE) AS day,
  37e0 + (user_id % 10) * 2e-2 + ((event_id * 7919) % 1000) / 1e6 AS lat, -122e0 + (user_id % 7) * 2e-2 + ((event_id * 104729) % 1000) / 1e6 AS lng,
  event_type || '|' || props AS item, value FROM events)"""


def mem_sql(cfg: MemoryConfig = CFG) -> str:
    w, p = sql_num(cfg.window_sec), cfg.precision
    return f"""{OBS},
s AS (SELECT *, greatest(floor((max(ts) OVER (ORDER BY seq) - (SELECT arg_min(ts, seq) FROM o WHERE ts >= 0)) / {w}), 0)::BIGINT AS slot FROM o),
l AS (SELECT max(slot) AS last_slot FROM s),
v AS (SELECT * FROM (SELECT *, {cell_sql(res=cfg.resolution)} AS cell, {hash_sql("item")} AS h FROM s) WHERE cell IS NOT NULL AND length(item) > 0),
g AS (SELECT *, (h >> {60 - p})::INTEGER AS j, h & {(1 << (60 - p)) - 1} AS w0 FROM v),
r AS (SELECT * EXCLUDE (w0), CASE WHEN w0 = 0 THEN {60 - p + 1} ELSE {60 - p + 1} - length(bin(w0)) END AS rho FROM g)"""


def agg_sql(name: str, where: str = "TRUE", cfg: MemoryConfig = CFG) -> str:
    """A CTE of window_aggregate over rows of r that pass ``where`` (may use l)."""
    m = 1 << cfg.precision
    raw = f"({0.7213 / (1 + 1.079 / m) * m * m!r}::DOUBLE / (p + ({m} - k)))"
    return f"""{name} AS (SELECT cell, t_min, t_max, CASE WHEN {raw} <= {2.5 * m} AND k < {m} THEN {m} * ln({m}::DOUBLE / ({m} - k)) ELSE {raw} END AS n FROM (
  SELECT cell, min(a) AS t_min, max(b) AS t_max, count(*) AS k, sum(pow(2e0, -rho)) AS p FROM (
    SELECT cell, j, max(rho) AS rho, min(ts) AS a, max(ts) AS b FROM r, l WHERE {where} GROUP BY ALL) GROUP BY cell))"""


LIVE = f"slot >= last_slot - {CFG.capacity - 1}"
BANK = f"""bank AS (SELECT cell, seq, ts FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY {hash_sql(f"concat_ws(':', {CFG.seed}, cell, seq)")}, seq) AS pick FROM v) WHERE pick <= {CFG.exemplars})"""
VEC = "vec AS (SELECT vec_id, embedding::DOUBLE[] AS vec, label, (SELECT count(*) FROM embeddings) AS nvec FROM embeddings)"
QUE = "que AS (SELECT vec_id AS qid, vec AS qvec, label AS category, 37e0 + (vec_id % 10) * 2e-2 AS lat, -122e0 + (vec_id % 7) * 2e-2 AS lng FROM vec WHERE vec_id % 20 = 0)"
COS = "round(list_dot_product(vec, qvec) / (sqrt(list_dot_product(vec, vec)) * sqrt(list_dot_product(qvec, qvec))), 9)"
GT = f"gt AS (SELECT vec_id AS qid, ts - {GT_SEC} AS a, ts + {GT_SEC} AS b FROM o JOIN vec ON seq % nvec = vec_id WHERE vec_id % 20 = 0)"
PLACES = "pl AS (SELECT c_custkey AS point_id, CASE WHEN c_custkey = 1 THEN 100e0 ELSE 37e0 + (c_custkey % 10) * 2e-2 + 4e-4 END AS lat, -122e0 + (c_custkey % 7) * 2e-2 + 4e-4 AS lng FROM customer)"


def disk_sql(name: str, source: str, keep: str, k: int) -> str:
    """A CTE of the cells within k steps of source.c."""
    return f"""{name} AS (SELECT {keep}, c + dq * 268435456 + dr AS cell FROM {source}, (SELECT unnest(range(-{k}, {k + 1})) AS dq) a, (SELECT unnest(range(-{k}, {k + 1})) AS dr) b WHERE abs(dq + dr) <= {k} AND c IS NOT NULL)"""
