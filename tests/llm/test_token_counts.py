import collections

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from wayhex.llm import queries, token_counts

from .common import awkward, frame


def brute(docs, spans_of):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    out = []
    for doc, text in docs:
        ends = spans_of(text)
        starts = [0, *ends[:-1]]
        n = [0] * len(ends)
        for a, b in t.encode(text, add_special_tokens=False).offsets:
            held = [min(b, e) - max(a, s) for s, e in zip(starts, ends)]
            n[held.index(max(held))] += 1
        out += [(doc, k, s, e, c) for k, (s, e, c) in enumerate(zip(starts, ends, n))]
    return collections.Counter(out)


def line_ends(text):
    ends, at = [], 0
    for x in text.split("\n"):
        at += len(x) + 1
        ends.append(at)
    ends[-1] -= 1
    return ends


def test_query_against_brute_force(spark, sf):
    docs = [(d.doc_id, d.text or "") for d in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert collections.Counter(map(tuple, queries.op4_token_counts(spark, sf).collect())) == brute(docs, line_ends)


def test_awkward_rows(spark):
    rows = [*awkward(), (9, "a\n\n\n\n  \nb"), (10, "☃\n\n☃☃\n"), (11, "<|endoftext|>\nx")]
    df = frame(spark, rows).withColumnRenamed("lang", "section").withColumnRenamed("source", "_ends")
    path = queries.vocabulary("byte_bpe_50k.tiktoken")
    assert collections.Counter(map(tuple, token_counts.by_line(df, path, public_tokenizers.PATTERN).collect())) == brute([(d, t or "") for d, t in rows], line_ends)
    assert token_counts.by_line(df.limit(0), path, public_tokenizers.PATTERN).collect() == []


def test_fields(spark):
    df = spark.createDataFrame([(1, "title", None, "body text"), (2, "", "", ""), (None, "é", "ü", "☃")], "doc_id long, a string, b string, c string")
    out = sorted(map(tuple, token_counts.by_field(df, ["a", "b", "c"], queries.vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()), key=str)
    parts = {1: ["title", "", "body text"], 2: ["", "", ""], None: ["é", "ü", "☃"]}
    ends = lambda f: [len(f[0]) + 1, len(f[0]) + len(f[1]) + 2, sum(map(len, f)) + 2]
    want = sum((brute([(d, "\n".join(f))], lambda _, f=f: ends(f)) for d, f in parts.items()), collections.Counter())
    assert out == sorted(want.elements(), key=str)


def test_the_rule_for_crossing_tokens():
    starts = np.array([0, 4, 6])
    assert token_counts.allot(np.array([0, 2, 3, 3, 2, 1]), np.array([4, 6, 5, 6, 7, 9]), starts).tolist() == [0, 0, 0, 1, 0, 0]
    assert token_counts.allot(np.array([3]), np.array([9]), starts).tolist() == [2]
