"""Written intermediate tables: they cut lineage and outlive executors.

Tables go to the folder named by ``spark.checkpoint.dir`` (shared by driver and
executors); only where that is unset, and the master is local, as in tests, to a temporary folder.
"""

from __future__ import annotations

import atexit

from pyspark.sql import DataFrame, SparkSession

from ..scratch import shared_path

_written: list[tuple[SparkSession, str]] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back with the same schema."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """The number of tables so far, for release()."""
    return len(_written)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(since: int, upto: int) -> None:
    """Deletes the tables since one mark() and before another; nothing may read them any more."""
    for spark, path in _written[since:upto]:
        _delete(spark, path)
    del _written[since:upto]


@atexit.register
def _remove() -> None:
    """Drops what this driver has written, if its JVM still answers."""
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the JVM is gone: nothing is left to do
            return
