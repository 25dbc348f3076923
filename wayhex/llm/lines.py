"""Line dedup by distinct-site spread.

A HyperLogLog sketch of sites for each line hash, merged by aggregation, estimates on how many
sites a line stands. Lines near the threshold get exact distinct counts. Lines
on enough sites are boilerplate and go from all documents. Where near-duplicate removal follows, a mode leaves documents whole
that boilerplate makes up for the most part: they are copies, which it would not know any more without those lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import written

SITES = 10
LG_K = 12
#: Estimates within this share of the threshold are counted exactly; it is over six standard errors of a sketch of 2**LG_K registers.
NEAR = 0.1
#: The share of characters for the mode that leaves such documents whole; the operator's default is to leave none.
MOST_LOST = 0.5


def lines_of(text: Column) -> Column:
    """The lines of a text; their trimmed form (spaces only) counts."""
    return F.split(text, "\n")


def spread(docs: DataFrame, text_col: str = "text", site_col: str = "source", sites: int = SITES) -> DataFrame:
    """(h): the hashes of trimmed lines, not blank, that stand on at least ``sites`` distinct sites. Null sites don't count."""
    own = docs.select(F.col(site_col).cast("string").alias("_site"), F.col(text_col).cast("string").alias("_text")).filter("_site is not null")
    occurs = own.select("_site", F.explode(F.array_distinct(F.transform(lines_of(F.col("_text")), lambda x: F.trim(x)))).alias("_line"))
    occurs = occurs.filter("_line <> ''").select("_site", F.xxhash64("_line").alias("h"))
    sketches = occurs.groupBy("h").agg(F.hll_sketch_agg("_site", LG_K).alias("s"))
    guess = sketches.select("h", F.hll_sketch_estimate("s").alias("n")).filter(F.col("n") >= sites * (1 - NEAR))
    guess = written(guess, "spread")
    near = guess.filter(F.col("n") <= sites * (1 + NEAR)).select("h")
    exact = occurs.join(near, "h", "left_semi").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= sites)
    return guess.filter(F.col("n") > sites * (1 + NEAR)).select("h").unionAll(exact.select("h"))


def remove_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", sites: int = SITES, most_lost: float | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, the text without boilerplate lines, and n_lines, n_removed (columns of these names are replaced; others may have any names).

    With ``most_lost`` a text that would lose over this share of its characters stays whole, with an n_removed of 0.
    A null text stays null and has no lines; an empty one has one blank line, and blank lines stay. Null sites count
    for no line, but lines go from their documents too. Repeated rows give repeated rows, an empty table an empty result. A text may be
    as long as an array of its lines can be.
    """
    keep = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    rows = docs.select(F.struct(*keep).alias("_r"), F.xxhash64(*[F.col(c) for c in (id_col, site_col, text_col)]).alias("_rid"))
    read = F.col("_r")[text_col].cast("string")
    bad = written(spread(docs, text_col, site_col, sites).distinct(), "boilerplate")
    occurs = rows.select("_rid", F.explode(F.array_distinct(F.transform(lines_of(read), lambda x: F.trim(x)))).alias("_line")).filter("_line <> ''").select("_rid", F.xxhash64("_line").alias("h"))
    mine = occurs.join(bad, "h").groupBy("_rid").agg(F.collect_set("h").alias("_bad"))
    all_lines = lines_of(F.col("_text"))
    good = F.when(F.col("_bad").isNull(), all_lines).otherwise(F.filter(all_lines, lambda x: ~F.array_contains("_bad", F.xxhash64(F.trim(x)))))
    size = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda n, x: n + F.char_length(x))
    out = rows.join(mine, "_rid", "left").withColumn("_text", read)  # after the join: a text goes through it once
    out = out.withColumn("_all", all_lines).withColumn("_good", good)
    whole = F.lit(False) if most_lost is None else size(F.col("_all")) - size(F.col("_good")) > most_lost * size(F.col("_all"))
    out = out.withColumn("_kept", F.when(whole, F.col("_all")).otherwise(F.col("_good")))
    n = F.when(F.col("_text").isNull(), F.lit(0)).otherwise(F.size("_all"))
    text = F.array_join("_kept", "\n")
    columns = [text.alias(c) if c == text_col else F.col("_r")[c].alias(c) for c in keep]
    return out.select(*columns, n.alias("n_lines"), F.when(F.col("_text").isNull(), F.lit(0)).otherwise(F.size("_all") - F.size("_kept")).alias("n_removed"))


ORACLE_SQL = f"""
WITH l AS (SELECT DISTINCT source, trim(x) AS line FROM (SELECT source, unnest(string_split(text, chr(10))) AS x FROM documents)),
bad AS (SELECT list(line) AS b FROM (SELECT line FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= {SITES})),
d AS (SELECT doc_id, text, string_split(text, chr(10)) AS a, coalesce(b, []) AS b FROM documents, bad),
k AS (SELECT doc_id, text, a, list_filter(a, lambda x: NOT list_contains(b, trim(x))) AS k FROM d)
SELECT doc_id, CAST(coalesce(len(a), 0) AS INTEGER) AS n_lines, CAST(coalesce(len(a) - len(k), 0) AS INTEGER) AS n_removed, md5(array_to_string(k, chr(10))) AS text_md5 FROM k"""
