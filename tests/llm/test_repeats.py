import collections
import hashlib
import random

import numpy as np
import pytest

from wayhex.llm import queries, repeats

from .common import awkward, frame


def brute(docs, length=400):
    """(doc, bytes, removed, spans, kept) by counting every string."""
    texts = [(t or "").encode() for _, t in docs]
    seen = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (d, _), t in zip(docs, texts):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = sum(1 for i in range(len(t)) if gone[i] and (not i or not gone[i - 1]))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((d, len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in df.collect()), key=str)


def test_query_against_brute_force(spark, sf):
    docs = [(d.doc_id, d.text) for d in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute(docs)
    assert sorted((tuple(r) for r in queries.op7_long_repeats(spark, sf).collect()), key=str) == want
    assert any(r[2] for r in want)


def planted(seed):
    r = random.Random(seed)
    word = lambda n: "".join(r.choices("abcé", k=n))
    shared = [word(n) for n in (10, 20, 33, 50, 90, 200)]
    docs = []
    for i in range(40):
        docs.append((i, "".join(r.choice([word(r.randint(0, 60)), r.choice(shared)]) for _ in range(r.randint(0, 8)))))
    return [*docs, (100, "a" * 300), (101, "ab" * 100), (102, shared[-1]), (103, shared[-1]), (103, shared[-1]), (104, word(60) + shared[4] * 3)]


@pytest.mark.parametrize("most", [20_000, 3])
@pytest.mark.parametrize("seed", [1, 2])
def test_small_lengths_against_brute_force(spark, seed, most):
    docs = [*planted(seed), (None, "x"), (200, None), (201, "")]
    df = frame(spark, docs).withColumnRenamed("lang", "rid").withColumnRenamed("source", "spans")
    assert got(repeats.remove_repeats(df, length=40, gram=8, most_contexts=most)) == brute(docs, 40)


def test_awkward_rows(spark):
    assert got(repeats.remove_repeats(frame(spark, awkward()))) == brute(awkward())
    assert got(repeats.remove_repeats(frame(spark, []))) == []


def test_groups_are_maximal_with_all_occurrences():
    texts = [b"xxHELLOWORLDaa", b"yyHELLOWORLDbb", b"xyHELLOWORLDaa", b"zzHELLOWORKcc"]
    left, right = [t[:5][::-1] for t in texts], [t[5:] for t in texts]
    found = {(a, b, tuple(sorted(m.tolist()))) for a, b, m in repeats.groups([1] * 4, left, right, 9)}
    assert found == {(3, 9, (0, 2)), (3, 7, (0, 1, 2)), (4, 7, (1, 2))}


def test_planted_passages_by_removed_bytes_and_what_is_kept(spark):
    """Passages of over 50 words that repeat across clean documents: all go that have LENGTH bytes, and nothing else does."""
    r = random.Random(9)
    word = lambda: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(4, 10)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(n) for n in (60, 70, 80, 120, 300)]
    assert all(len(p) >= repeats.LENGTH for p in passages)
    docs, want = [], {}
    for k, p in enumerate(passages):
        for copy in range(2 + k):
            # another sign for each copy keeps chance neighbours of a passage from repeating too
            before, after = f"{text(90)} {copy}", f"{copy} {text(90)}"
            want[len(docs)] = (len(p), before + after)
            docs.append((len(docs), before + p + after))
    clean = range(len(docs), len(docs) + 40)
    docs += [(i, text(200)) for i in clean]
    rows = {x.doc_id: x for x in repeats.remove_repeats(frame(spark, docs)).collect()}
    for i, (size, kept) in want.items():
        assert (rows[i].n_removed, rows[i].n_spans, rows[i].kept) == (size, 1, kept.encode()), i
    assert all((rows[i].n_removed, rows[i].kept) == (0, docs[i][1].encode()) for i in clean)


def test_groups_are_those_of_all_substrings():
    r = random.Random(3)
    some = 0
    for _ in range(60):
        texts = list(dict.fromkeys((bytes(r.choices(b"ab", k=r.randint(0, 6))), b"##" + bytes(r.choices(b"ab", k=r.randint(0, 4)))) for _ in range(12)))
        left, right = [x[0][::-1] for x in texts], [x[1] for x in texts]
        want = set()
        for b in range(7):
            for a in range(2, 7):
                for x, y in texts:
                    if b <= len(x) and a <= len(y) and a + b >= 6:
                        own = tuple(i for i, (p, q) in enumerate(texts) if len(p) >= b and len(q) >= a and p[len(p) - b :] == x[len(x) - b :] and q[:a] == y[:a])
                        lefts = {texts[i][0][: len(texts[i][0]) - b][-1:] for i in own}
                        rights = {texts[i][1][a : a + 1] for i in own}
                        if len(own) > 1 and (len(lefts) > 1 or b"" in lefts) and (len(rights) > 1 or b"" in rights):
                            want.add((b, a, own))
        found = [(b, a, tuple(sorted(m.tolist()))) for b, a, m in repeats.groups([1] * len(texts), left, right, 6)]
        assert set(found) == want and len(found) == len(want)
        some += len(want)
    assert some > 100


def test_merged_spans():
    got = repeats.merged(np.array([5, 0, 9, 20, 21]), np.array([9, 3, 12, 30, 25]))
    assert got == [(0, 3), (5, 12), (20, 30)]
