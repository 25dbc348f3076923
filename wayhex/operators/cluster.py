"""Clusters of frames for question synthesis: k-means and the medoid of each cluster; 2-D projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _with_features(df: DataFrame, vec: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.withColumn("_f", array_to_vector(F.transform(vec, lambda x: x.cast("double"))))


def medoids(df: DataFrame, k: int, vec: str = "vec", order: str = "seq", seed: int = 42, iterations: int = 50, starts: int = 1) -> DataFrame:
    """(cluster, order, size): the frame nearest to each k-means centre, of the best of ``starts`` runs by cost.

    Where clusters come out empty, frames at random fill up to k, as clusters of their own size 0; with k frames or fewer all are taken.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import vector_to_array

    from ..functions.scalars import hash60

    key = hash60(F.concat_ws(":", F.lit(seed), order))
    few = df.select(order).limit(k + 1).count()
    if few <= k:
        return df.select(order).withColumn("cluster", (F.row_number().over(Window.orderBy(order)) - 1).cast("int")).select("cluster", order, F.lit(1).cast("long").alias("size"))
    rows = _with_features(df.select(order, vec), vec)
    fits = [KMeans(k=k, seed=seed + i, maxIter=iterations, featuresCol="_f", predictionCol="cluster").fit(rows) for i in range(starts)]
    model = min(fits, key=lambda m: m.summary.trainingCost)
    centers = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])
    far = F.aggregate(F.zip_with(vector_to_array("_f"), F.get(centers, F.col("cluster")), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    found = model.transform(rows).groupBy("cluster").agg(F.min_by(order, F.struct(F.round(far, 9), order)).alias(order), F.count(F.lit(1)).alias("size"))
    missing = k - found.count()
    if not missing:
        return found
    rest = df.select(order).join(F.broadcast(found.select(order)), order, "left_anti").orderBy(key, order).limit(missing)
    fill = rest.withColumn("cluster", (F.lit(k) + F.row_number().over(Window.orderBy(order)) - 1).cast("int")).select("cluster", order, F.lit(0).cast("long").alias("size"))
    return found.unionAll(fill)


def project_2d(df: DataFrame, vec: str = "vec", order: str = "seq") -> DataFrame:
    """(order, x, y): the first two principal components."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array

    rows = _with_features(df.select(order, vec), vec)
    out = PCA(k=2, inputCol="_f", outputCol="_p").fit(rows).transform(rows).withColumn("_a", vector_to_array("_p"))
    return out.select(order, F.col("_a")[0].alias("x"), F.col("_a")[1].alias("y"))


def round_robin(df: DataFrame, group: str, within: str, cap: int, total: int, seed: int = 42) -> DataFrame:
    """At most ``cap`` rows of each (group, within) and ``total`` in all, dealt over groups in turn; rows need seq."""
    from ..functions.scalars import hash60

    key = hash60(F.concat_ws(":", F.lit(seed), "seq"))
    own = F.row_number().over(Window.partitionBy(group, within).orderBy(key, "seq"))
    rows = df.withColumn("_c", own).filter(F.col("_c") <= cap)
    turn = F.row_number().over(Window.partitionBy(group).orderBy("_c", key, "seq"))
    rows = rows.withColumn("_t", turn).filter(F.col("_t") <= total)
    return rows.orderBy("_t", hash60(F.concat_ws(":", F.lit(seed), group)), group).limit(total).drop("_c", "_t")


def shuffled(df: DataFrame, label: str, order: str, seed: int = 42) -> DataFrame:
    """The rows with their labels dealt anew at random: a control."""
    from ..functions.scalars import hash60
    from .geo import positions

    mixed = positions(df.select(hash60(F.concat_ws(":", F.lit(seed), order)).alias("_k"), label), "_k")
    return positions(df.drop(label), order).join(mixed.select("_i", label), "_i").drop("_i")
