import collections
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from wayhex.llm import packing, queries
from wayhex.llm.tokenizing import word_encoder

from .common import awkward, frame


def plain_bfd(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits)[1]] -= n
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(40))
def test_plan_is_best_fit_decreasing(seed):
    r = random.Random(seed)
    capacity = r.choice([7, 20, 64])
    lengths = [r.randint(1, capacity) for _ in range(r.randint(0, 200))]
    plan = packing.best_fit_decreasing(dict(collections.Counter(lengths)), capacity)
    bins = collections.defaultdict(list)
    for n, _, pieces, first, at in zip(*(plan[k].tolist() for k in ("length", "first_rank", "pieces", "first_bin", "offset"))):
        for k in range(pieces):
            bins[first + k].append((at, n))
    for own in bins.values():
        place = 0
        for at, n in sorted(own):
            assert at == place
            place += n
    assert sorted(capacity - sum(n for _, n in own) for own in bins.values()) == plain_bfd(lengths, capacity)
    assert set(bins) == set(range(len(bins)))


def test_ids_are_the_librarys():
    e = word_encoder(queries.vocabulary("word_bpe_49k.json"))
    texts = ["don't 'S  ΣΑΣ İ x", "a\x1fb", "''s it's 'LL ''", "ª²½ 12³ ÀÉ", "a\xa0b", "x <|endoftext|> y", "9's", "x,'s 'sam 're've", "'", "£5 «a» ¿que? ÀŸ", "", None, "é", "ж", "a­b", "\r\n\tx"]
    ids, at = e.encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == e.whole.encode(t or "", add_special_tokens=False).ids, t


def check(rows, docs, capacity=4096):
    e = word_encoder(queries.vocabulary("word_bpe_49k.json")).whole
    want = collections.Counter()
    for doc, text in docs:
        ids = [*e.encode(text or "", add_special_tokens=False).ids, 1]
        for p, at in enumerate(range(0, len(ids), capacity)):
            own = ids[at : at + capacity]
            want[doc, p, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= capacity
    assert sorted(capacity - sum(n for _, n in b) for b in bins.values()) == plain_bfd([r.length for r in rows], capacity)


def test_query_on_whole_table(spark, sf):
    rows = queries.op9_best_fit_packing(spark, sf).collect()
    check(rows, [(d.doc_id, d.text) for d in spark.read.parquet(f"{sf}/documents.parquet").collect()])


def test_awkward_rows(spark):
    df = frame(spark, awkward())
    path = queries.vocabulary("word_bpe_49k.json")
    check(packing.pack_documents(df, path, keep_ids=False).collect(), [r[:2] for r in awkward()])
    out = packing.pack_documents(df, path, capacity=64).collect()
    assert all(len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 for r in out)
    check(out, [r[:2] for r in awkward()], 64)
    assert packing.pack_documents(df.limit(0), path).collect() == []


def test_clashing_columns(spark):
    df = spark.createDataFrame([(3, "a", 9), (4096, "b", 9), (3, "a", 9)], "length long, _n string, offset long")
    rows = packing.pack(df).collect()
    assert sorted((r.length, r["_n"]) for r in rows) == [(3, "a"), (3, "a"), (4096, "b")]
    assert sorted(r.offset for r in rows) == [0, 0, 3]
    with pytest.raises(Exception, match="no length"):
        packing.pack(spark.createDataFrame([(None,)], "length long")).collect()
