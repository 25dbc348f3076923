import random
import re

import pytest

from wayhex.llm import containment, queries

from .common import awkward, frame


def shingles(text):
    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(docs, items, threshold=0.8):
    out = []
    parts = [(i, s) for i, t in items if (s := shingles(t))]
    for d, text in docs:
        own = shingles(text)
        out += [(d, i, len(s), k) for i, s in parts if (k := len(s & own)) >= threshold * len(s)]
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.item_id, r.item_shingles, r.shared) for r in df.collect()), key=str)


def test_query_against_brute_force(spark, sf):
    read = lambda t: [tuple(r)[:2] for r in spark.read.parquet(f"{sf}/{t}.parquet").collect()]
    want = brute(read("documents"), read("benchmark"))
    assert got(queries.op10_minhash_containment(spark, sf)) == want and want


@pytest.mark.parametrize("block", [3, 100])
def test_planted_items_of_all_sizes(spark, block):
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdefgh", k=r.randint(2, 7)))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([1, 4, 5, 6, 7, 8, 9, 13, 20, 21, 40, 77, 130, 300])]
    docs = []
    for k, text in items:
        w = text.split()
        for at in (0, 1, 17, 400):
            around = [word() for _ in range(3000)]
            docs.append((len(docs), " ".join([*around[:at], *w, *around[at:]])))
        if len(w) > 60:
            w[30] = "changed"
            docs.append((len(docs), " ".join([*around[:50], *w, *around[50:]])))
        docs.append((len(docs), text.upper() + "!"))
    want = brute(docs, items)
    assert len(want) >= 4 * 12
    assert got(containment.contained(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), block=block)) == want


def test_awkward_rows(spark):
    df = frame(spark, [*awkward(), (8, "x one two three four five six")]).withColumnRenamed("lang", "containment").withColumnRenamed("source", "item_id")
    items = [(1, None), (2, ""), (3, "same text"), (3, "same text"), (None, "One, two three; four FIVE"), (5, "x29000 wörd")]
    want = brute([*[r[:2] for r in awkward()], (8, "x one two three four five six")], items)
    assert len(want) == 7
    item_df = spark.createDataFrame(items, "item_id long, text string")
    assert got(containment.contained(df, item_df)) == want
    assert got(containment.contained(df.limit(0), item_df)) == [] == got(containment.contained(df, item_df.limit(0)))
