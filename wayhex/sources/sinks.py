"""Results as JSON: summaries, last-seen and search answers, and evaluation captures."""

from __future__ import annotations

import contextlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cells import hex_string
from ..functions.scalars import first_choice
from ..scratch import local_path

VERSION = 1


def to_json(df: DataFrame, mode: str, key: str | None = None) -> DataFrame:
    """(json): a document for each key (or each row): schema_version, mode and its rows, cells in hexadecimal."""
    rows = df.withColumn("cell", hex_string(F.col("cell"))) if "cell" in df.columns else df
    if key is None:
        return rows.select(F.to_json(F.struct(F.lit(VERSION).alias("schema_version"), F.lit(mode).alias("mode"), F.struct(*rows.columns).alias("row"))).alias("json"))
    first = [c for c in ("rank", "cell", "seq") if c in rows.columns]
    inner = F.struct(*first, *[c for c in rows.columns if c not in (*first, key)])
    out = rows.groupBy(key).agg(F.array_sort(F.collect_list(inner)).alias("results"))
    return out.select(F.to_json(F.struct(F.lit(VERSION).alias("schema_version"), F.lit(mode).alias("mode"), key, "results")).alias("json"))


def write_capture(summary: DataFrame, preds: DataFrame, settings: dict[str, str], path: str) -> None:
    """A capture: settings, and a record with its predictions for each question, as JSON lines."""
    own = preds.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", *[c for c in preds.columns if c not in ("qid", "rank")]))).alias("preds"))
    out = summary.join(own, "qid", "left")
    for k, v in settings.items():
        out = out.withColumn(k, F.lit(v))
    out.write.json(path)


def write_summary(summary: DataFrame, preds: DataFrame, settings: dict[str, str], keys: list[str], path: str) -> None:
    """A capture as one JSON document: schema_version, settings, summary (n, hit_rate), by_category (the same by keys) and the number of predictions."""
    parts = [F.count(F.lit(1)).alias("n"), F.avg(F.col("hit").cast("double")).alias("hit_rate")]
    each = summary.groupBy(*keys).agg(*parts).agg(F.sort_array(F.collect_list(F.struct(*keys, "n", "hit_rate"))).alias("by_category"))
    whole = summary.agg(*parts).select(F.struct("n", "hit_rate").alias("summary"))
    count = preds.agg(F.count(F.lit(1)).alias("preds"))
    out = whole.crossJoin(F.broadcast(each)).crossJoin(F.broadcast(count))
    out.select(F.lit(VERSION).alias("schema_version"), F.struct(*[F.lit(v).alias(k) for k, v in settings.items()]).alias("settings"), "*").write.json(path)


def read_captures(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Columns by name or, where a capture lacks one, by its older names; a column that no name gives is an error."""
    picked = []
    for name, other in aliases.items():
        there = [c for c in (name, *other) if c in df.columns]
        if not there:
            raise ValueError(f"captures have no {name}")
        picked.append(F.coalesce(*there).alias(name))
    return df.select(*picked)


def rerank(preds: DataFrame, answers: DataFrame, shown: int) -> DataFrame:
    """Ranks anew by what a scorer answered, (qid, answer): the first number from 1 to ``shown`` in it is the rank it picks; without one, a refusal for instance, the order stays."""
    picks = answers.select("qid", first_choice(F.col("answer"), shown).alias("pick")).filter("pick is not null")
    return promote(preds, picks)


def promote(preds: DataFrame, picks: DataFrame) -> DataFrame:
    """Ranks anew with the picked rank of (qid, pick) first and the rest in order; a question without a valid pick stays as it is."""
    from pyspark.sql.window import Window

    out = preds.join(picks, "qid", "left")
    order = Window.partitionBy("qid").orderBy((F.col("rank") != F.coalesce("pick", F.lit(-1))).cast("int"), "rank")
    return out.withColumn("rank", F.row_number().over(order)).drop("pick")


def write_folders(df: DataFrame, folder: str, name: str, path: str) -> None:
    """A text file with the ``value`` of each row: path/folder=…/….txt by the values of the columns ``folder`` and ``name``; no pair is there twice, none is null.

    Rows are dealt evenly: a few bytes a file would all be one task's. On a local or mounted file system tasks make the files by themselves,
    as Hadoop starts a program for the rights of each file and folder where it has no native library; a task that runs again writes the
    same names. On others Spark's writer makes path/folder=…/name=…/part-….txt.
    """
    spark = df.sparkSession
    rows = df.select(folder, name, "value").repartition(4 * spark.sparkContext.defaultParallelism, folder)
    root = local_path(spark, path)
    if root is None:
        # tasks commit their own files: the driver moves none
        rows.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy(folder, name).text(path)
        return
    os.makedirs(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for own, file, value in zip(*(c.to_pylist() for c in b.columns)):
                at = os.path.join(root, f"{folder}={own}")
                with contextlib.suppress(FileExistsError):
                    os.mkdir(at)
                with open(os.path.join(at, f"{file}.txt"), "wb") as f:
                    f.write(f"{'' if value is None else value}\n".encode())
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    rows.mapInArrow(run, "n long").agg(F.sum("n")).collect()
