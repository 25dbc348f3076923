"""Documents with every awkward case, for tests of the operators."""

from pyspark.sql import types as T

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType())])


def frame(spark, rows, schema=DOC):
    return spark.createDataFrame([(*r, *[None] * (len(schema) - len(r)))[: len(schema)] for r in rows], schema)


def awkward():
    """Null id, null and empty texts, a repeated row, equal texts, a very long text."""
    long = " ".join(f"wörd{i % 977} x{i}" for i in range(30_000))
    return [(None, "no id here"), (1, None), (2, ""), (3, "same text"), (4, "same text"), (4, "same text"), (5, long), (6, " \n\t"), (7, "ünï čödé ☃ 你好")]
