import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from wayhex.llm import language, queries

from .common import awkward, frame


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in queries.op5_language_filters(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(rows) == len(docs)
    assert all(rows[d.doc_id].held_out == (zlib.crc32(str(d.doc_id).encode()) % 5 == 0) for d in docs)
    held = [d for d in docs if d.lang and d.text and rows[d.doc_id].held_out]
    right = sum(rows[d.doc_id].lang_pred == d.lang for d in held)
    assert len(held) > 100 and right >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_filter_finds_all_languages_of_a_gram():
    r = np.random.default_rng(1)
    own = [r.integers(0, 1 << 32, 500, dtype=np.uint32) for _ in range(9)]
    table = np.zeros(1 << 13, np.uint16)
    for i, g in enumerate(own):
        for p in language.probes(g, len(table)):
            table[p] |= np.uint16(1 << i)
    f = language.Filter(tuple("abcdefghi"), 0, table, np.zeros(9))
    for i, g in enumerate(own):
        assert ((f.lookup(g) >> i) & 1).all()
    strange = f.lookup(r.integers(0, 1 << 32, 20_000, dtype=np.uint32))
    fill = np.array([((table >> i) & 1).mean() for i in range(9)]) ** language.PROBES
    assert np.allclose([((strange >> i) & 1).mean() for i in range(9)], fill, atol=0.01)


def test_grams_stay_in_their_row():
    code, at = language.grams(pa.array(["ab", None, "", "a", "é x", "abc def"]))
    text = [[int(c).to_bytes(4, "big").decode(errors="replace") for c in code[i:j]] for i, j in zip(at, at[1:])]
    assert text[0] == [] and text[1] == text[2] == text[3] == []
    assert text[5] == [" abc", "abc ", "bc d", "c de", " def", "def "]


def test_awkward_rows(spark):
    rows = [*awkward(), (8, "123 !?"), *[(100 + i, "the quick brown fox jumps over the lazy dog", "en") for i in range(20)], *[(200 + i, "der schnelle braune fuchs springt über den hund", "de") for i in range(20)]]
    df = frame(spark, rows).withColumnRenamed("source", "score")
    out = [tuple(r) for r in language.identify(df).collect()]
    assert len(out) == len(rows)
    got = {r[0]: r for r in out}
    for doc in (1, 2, 6, 8):
        assert got[doc][1:4] == ("und", 0, 0)
    assert got[None][1] in ("en", "de") and got[None][4] is False
    assert all(got[d][1] == lang for d, _, lang in rows[10:])
    assert {r[1] for r in language.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.identify(df.limit(0)).collect() == []


def test_prediction_uses_text_only(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    base = {r.doc_id: r.lang_pred for r in language.identify(docs).collect()}
    other = docs.withColumn("lang", F.when(language.fold() == 0, "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("z"))
    assert {r.doc_id: r.lang_pred for r in language.identify(other).collect()} == base


def test_sample_counts_different_texts(spark):
    texts = {f"text number {i} of {name}": name for name, n in (("en", 60), ("de", 25), ("fr", 1)) for i in range(n)}
    docs = frame(spark, [(i, t, name) for i, (t, name) in enumerate(texts.items())])
    hashes = {r["text"]: r["h"] for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    want = {t for name in ("en", "de", "fr") for t in sorted((t for t in texts if texts[t] == name), key=hashes.get)[:40]}
    for copies in (1, 300):
        rows = docs.crossJoin(spark.range(copies)).select(F.col("text").alias("_text"), F.col("lang").alias("_lang"))
        got = language.sampled(rows, 40).collect()
        assert len(got) == 66 and {r["_text"] for r in got} == want
        assert all(r["_h"] == hashes[r["_text"]] and r["_c"] == min(copies, language.LEAST_SEEN) for r in got)


def test_copies_do_not_keep_a_language_from_being_learned(spark):
    rows = [(i, f"{text} {i}", lang) for lang, text in (("en", "the quick brown fox jumps over the lazy dog"), ("de", "der schnelle braune fuchs springt über den hund")) for i in range(10)]
    docs = frame(spark, rows).crossJoin(spark.range(1000).select(F.lit(1).alias("x"))).drop("x")
    model = language.train(docs, F.col("text"), F.col("lang"), sample=10)
    assert model is not None and model.languages == ("de", "en")


def test_any_number_of_languages(spark):
    word = lambda i, k: "".join("abcdefghij"[int(d)] for d in f"{(i * 7919 + k * 104729) % 10**8:08d}")
    rows = [(1000 * i + k, " ".join(word(i, w) for w in range(6)) + f" {'x' * k}", f"l{i:03d}") for i in range(150) for k in range(4)]
    model = language.train(frame(spark, rows), F.col("text"), F.col("lang"))
    assert len(model.languages) == 150 and model.rows.shape[1:] == (3,)
    got = language.predict(frame(spark, rows), model).collect()
    assert {r.doc_id: r.lang_pred for r in got} == {d: lang for d, _, lang in rows}


def test_a_text_without_grams_is_not_unknown(spark):
    rows = [(i, "the quick brown fox jumps over the lazy dog", "en") for i in range(20)]
    model = language.train(frame(spark, rows), F.col("text"), F.col("lang"))
    got = {r.doc_id: (r.lang_pred, r.score, r.known) for r in language.predict(frame(spark, [(1, "A."), (2, "Re."), (3, "12."), (4, "")]), model).collect()}
    assert got == {1: ("en", 0, 1), 2: ("en", 0, 1), 3: ("und", 0, 0), 4: ("und", 0, 0)}


def plain_grams(text):
    """The 4-byte grams of a text, one after another."""
    data = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in f" {(text or '').lower()} ".encode())
    return [data[i : i + 4] for i in range(len(data) - 3) if data[i : i + 4].count(32) <= 1]


def plain_probes(gram, slots):
    h = (int.from_bytes(gram, "big") + 1) % 2**64
    h = ((h ^ h >> 30) * 0xBF58476D1CE4E5B9) % 2**64
    h = ((h ^ h >> 27) * 0x94D049BB133111EB) % 2**64
    h ^= h >> 31
    return [(h >> 20 * k) % slots for k in range(3)]


def test_identify_against_brute_force(spark, sf):
    """Training, filter, hits, correction and prediction anew with dictionaries and sets, a gram at a time."""
    docs = [(d.doc_id, d.text, d.lang) for d in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    docs += [(5000, None, "en"), (5001, "", "en"), (5002, "12 34", None), (5003, "A.", None), (None, docs[0][1], docs[0][2])]
    learn = {}
    for d, text, lang in docs:
        if d is not None and zlib.crc32(str(d).encode()) % 5 and text is not None and lang is not None:
            learn.setdefault(lang, {}).setdefault(text, 0)
            learn[lang][text] = min(learn[lang][text] + 1, 3)
    assert all(len(t) < 1000 for t in learn.values())  # every text is in the sample
    seen = {lang: {} for lang in learn}
    for lang, own in learn.items():
        for text, copies in own.items():
            for g in plain_grams(text):
                seen[lang][g] = seen[lang].get(g, 0) + copies
    total = {lang: sum(s.values()) for lang, s in seen.items()}
    rate = {lang: {g: n / total[lang] for g, n in s.items() if n >= 3} for lang, s in seen.items()}
    top = {}
    for own in rate.values():
        for g, x in own.items():
            top[g] = max(top.get(g, 0), x)
    known = {lang: {g for g, x in own.items() if x >= 0.2 * top[g]} for lang, own in rate.items()}
    slots = 1 << max(10, (8 * max(map(len, known.values()))).bit_length())
    bits = {lang: {p for g in own for p in plain_probes(g, slots)} for lang, own in known.items()}
    order = sorted(known)
    wrong = {lang: (len(bits[lang]) / slots) ** 3 for lang in order}
    prior = max(order, key=lambda x: total[x])
    got = sorted(language.identify(frame(spark, docs)).collect(), key=str)
    want = []
    for d, text, _ in docs:
        held = d is not None and zlib.crc32(str(d).encode()) % 5 == 0
        if not any(c.isalpha() for c in text or ""):
            want.append((d, "und", 0.0, 0.0, held))
            continue
        g = plain_grams(text)
        places = [plain_probes(x, slots) for x in g]
        hits = [max((sum(all(p in bits[lang] for p in ps) for ps in places) - len(g) * wrong[lang]) / (1 - wrong[lang]), 0) for lang in order]
        best = max(hits)
        pick = order[hits.index(best)] if best > 0 else prior
        want.append((d, pick, best / sum(hits) if best else 0.0, min(best / len(g), 1) if g else 1.0, held))
    want.sort(key=str)
    assert [(r[0], r[1], r[4]) for r in got] == [(w[0], w[1], w[4]) for w in want]
    assert np.allclose([r[2] for r in got], [w[2] for w in want], atol=1e-9) and np.allclose([r[3] for r in got], [w[3] for w in want], atol=1e-9)
