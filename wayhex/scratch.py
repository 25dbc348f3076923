"""Where intermediate tables go: the folder that the session's spark.checkpoint.dir names, shared by driver and executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_own: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; in a temporary folder of this machine only where none is set and all runs on this machine, as in tests. On a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="wayhex-"))
        found = _own[0]
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def local_path(spark: SparkSession, path: str) -> str | None:
    """``path`` as a path of the operating system, where Hadoop takes it for one of a local (or mounted) file system; else None."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toUri()
    return full.getPath() if full.getScheme() == "file" else None
