"""The corpus pipeline: each stage works on what its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. Each row gets a verdict of its own, whether or not its id is null or repeated. An empty table gives
an empty table. Texts of any length are read whole. Further columns go along whatever their names are, but _row, which the stages use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayhex.llm import containment, jaccard, language, lines, packing
from wayhex.llm.queries import vocabulary
from wayhex.llm.storage import mark, release, written

#: Language ID rejects a document if it is less sure than this of every language: a smaller share of its n-grams is known.
LEAST_KNOWN = 0.2
VOCABULARY = "word_bpe_49k.json"
#: A table of its files' numbers is broadcast for at most so many files, about 40 MB; beyond, it is joined by sorting.
MOST_FILES = 200_000


def _keyed(docs: DataFrame) -> DataFrame:
    """The rows with a key _row of their own, the same whenever they are read: for a table its file's number and the place in the file, else the place in a copy that is written."""
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":  # not just a table's scan
        return written(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    files = written(docs.select("_metadata.file_path").distinct().withColumn("_file", F.row_number().over(Window.orderBy("file_path")) - 1), "files")
    files = F.broadcast(files) if files.count() <= MOST_FILES else files
    rows = docs.select(*docs.columns, F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_place"))
    row = F.shiftleft(F.col("_file").cast("long"), 36).bitwiseOR(F.col("_place")).alias("_row")
    return rows.join(files, F.col("_path") == F.col("file_path")).select(*docs.columns, row)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without text or letters, or in no language that was learned, go."""
    found = language.identify(docs, keep=True).filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("known") >= LEAST_KNOWN))
    return found.select(*[F.col("_text").alias(c) if c == "text" else F.col("_r")[c].alias(c) for c in docs.columns])


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go from texts; documents stay, those without text too, and repeated rows. A text that is boilerplate for the most part stays whole: it is a copy, for the next stage to judge."""
    out = lines.remove_boilerplate(docs, most_lost=lines.MOST_LOST).select(*docs.columns)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies one row stays, of those with the least id; a null id is the greatest, and equal ids go by place. Texts without words are no copies: all stay."""
    rows = _keyed(docs)
    since = mark()
    found = jaccard.jaccard_join(rows, id_col="_row").select(F.col("doc_id").alias("_row"), F.col("class_id").alias("_class"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")
    first = found.join(rows.select("_row", "doc_id"), "_row").groupBy("_class").agg(F.min(order).alias("_first")).select(F.col("_first._row").alias("_row"))
    first = written(first, "kept")
    release(since, mark() - 1)  # what the join has written
    return rows.join(first, "_row", "left_semi").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go; documents without words stay. Without items all stay."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = _keyed(docs)
    found = written(containment.contained(rows, items, id_col="_row").select(F.col("doc_id").alias("_row")).distinct(), "leaks")
    return rows.join(found, "_row", "left_anti").select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces, with their ids; a document without text is a piece of one id."""
    return packing.pack_documents(docs, vocabulary(VOCABULARY))


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", join_near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("best-fit packing", pack_sequences),
]
#: SQL can't express the stages; tests/llm holds the pipeline against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents, each written and read again; what a stage read and wrote on its way is then deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        since = mark() - (k > 0)
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            upto = mark()
            docs = written(docs, "stage")
            release(since, upto)
    return docs
