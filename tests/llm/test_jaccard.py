import random

import numpy as np
import pytest

from wayhex.llm import graph, jaccard, queries

from .common import awkward, frame
from .test_containment import shingles


def brute(docs):
    """(doc, class, links, set) by comparing all pairs."""
    sets = [shingles(t) for _, t in docs]
    near = [[j for j, b in enumerate(sets) if j != i and a and b and len(a & b) >= 0.8 * len(a | b)] for i, a in enumerate(sets)]
    root = list(range(len(docs)))
    for _ in docs:
        root = [min([root[i], *(root[j] for j in near[i])]) for i in range(len(docs))]
    low = lambda ids: min((d for d in ids if d is not None), default=None)
    return sorted(((d, low(docs[j][0] for j in range(len(docs)) if root[j] == root[i]), len(near[i]), low([d, *(docs[j][0] for j in near[i] if sets[j] == sets[i])])) for i, (d, _) in enumerate(docs)), key=str)


def got(df):
    return sorted(((r.doc_id, r.class_id, r.n_links, r.set_id) for r in df.collect()), key=str)


def test_query_against_brute_force(spark, sf):
    docs = [(d.doc_id, d.text) for d in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute(docs)
    assert got(queries.op1_ngram_jaccard_join(spark, sf)) == want
    assert any(r[2] for r in want)


def varied(seed, n=60):
    """Chains and groups of texts around the threshold."""
    r = random.Random(seed)
    docs = []
    for _ in range(6):
        w = [f"w{r.randint(0, 500)}" for _ in range(r.choice([3, 8, 60, 200]))]
        for _ in range(n // 6):
            docs.append((len(docs), " ".join(w)))
            if r.random() < 0.8:
                w = list(w)
                w[r.randrange(len(w))] = f"x{r.randint(0, 10**6)}"
    return docs


@pytest.mark.parametrize("block", [512, 7])
def test_groups_against_brute_force(spark, block):
    docs = [*varied(1), *((1000 + d, t) for d, t in varied(2)), *awkward(), (6, "another text of the same id"), (6, "another text of the same id")]
    df = frame(spark, docs).withColumnRenamed("lang", "sig").withColumnRenamed("source", "rid")
    assert got(jaccard.jaccard_join(df, block=block)) == brute(docs)


def test_empty(spark):
    assert got(jaccard.jaccard_join(frame(spark, []))) == []
    assert got(jaccard.jaccard_join(frame(spark, [(1, None), (1, "")]))) == [(1, 1, 0, 1)] * 2


def test_posterior_bound():
    need = jaccard.least_matches()
    r = np.random.default_rng(1)
    for n, m in need.items():
        s = r.random(400_000)
        k = r.binomial(n, s)
        assert (s[k == max(m - 3, 0)] < 0.8).all()
        assert m < 0.8 * n


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5)]
    root = {v: v for e in edges for v in e}
    for _ in range(400):
        for u, v in edges:
            root[u] = root[v] = min(root[u], root[v])
    out = {x.v: x.root for x in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert out == {v: k for v, k in root.items() if v != k}
    assert graph.components(spark.createDataFrame([], "u long, v long")).collect() == []


@pytest.mark.parametrize("chunk", [graph.CHUNK, 7])
def test_components_take_few_rounds(spark, monkeypatch, chunk):
    """A round writes two tables: a forest of stars takes none but the first two, a long path whose ids are in no order few."""
    made = []
    monkeypatch.setattr(graph, "written", lambda df, name, f=graph.written: made.append(name) or f(df, name))
    monkeypatch.setattr(graph, "CHUNK", chunk)
    hubs = spark.createDataFrame([(i, i % 10) for i in range(10, 500)], "u long, v long").repartition(5)
    assert {(x.v, x.root) for x in graph.components(hubs).collect()} == {(i, i % 10) for i in range(10, 500)}
    assert len(made) == 2 or chunk < 10
    made.clear()
    order = random.Random(9).sample(range(400), 400)
    path = spark.createDataFrame(list(zip(order, order[1:])), "u long, v long").repartition(3)
    assert sorted((x.v, x.root) for x in graph.components(path).collect()) == [(i, 0) for i in range(1, 400)]
    assert len(made) <= 4 or chunk < 10


def test_stars_of_a_task():
    r = random.Random(5)
    for _ in range(40):
        edges = [(r.randint(-60, 60), r.randint(-60, 60)) for _ in range(r.randint(0, 90))]
        root = {v: v for e in edges for v in e}
        for _ in range(100):
            for u, v in edges:
                root[u] = root[v] = min(root[u], root[v])
        u, v = graph.stars(*np.array(edges, np.int64).reshape(-1, 2).T)
        assert dict(zip(u.tolist(), v.tolist())) == {x: k for x, k in root.items() if x != k} and len(set(u.tolist())) == len(u)


def chain(n, size=60):
    """Texts of which each differs from the one before by one word: far ends share nothing."""
    w = [f"c{i}" for i in range(size)]
    docs = []
    for i in range(n):
        docs.append((i, " ".join(w)))
        w = [*w[1:], f"c{size + i}"]
    return docs


def test_a_long_chain_goes_by_buckets(spark):
    docs = [*chain(150), *((500 + d, t) for d, t in varied(3, 36))]
    assert got(jaccard.jaccard_join(frame(spark, docs), block=8)) == brute(docs)


def test_the_cheaper_way_is_taken(spark):
    bands = spark.createDataFrame([(c, t, 100 * t + c // 2) for c in range(40) for t in (0,)] + [(c, 1, 100 + (c + 1) // 2) for c in range(40)] + [(c, 0, 999) for c in range(50, 80)], "c long, t int, k long")
    shared = bands.groupBy("t", "k").agg({"c": "min", "*": "count"}).toDF("t", "k", "m", "n").filter("n > 1")
    group = spark.createDataFrame([(c, 0) for c in range(40)] + [(c, 50) for c in range(50, 80)] + [(90, 90), (91, 90)], "c long, g long")
    got = jaccard._entries(bands, shared.select("t", "k", "m", "n"), group, 4).collect()
    ways = {c: {r.t for r in got if r.c == c} for c in (0, 5, 60, 90)}
    assert ways == {0: {0}, 5: {0, 1}, 60: {-1}, 90: {-1}}
    assert {r.parts for r in got if r.c == 60} == {8} and {r.parts for r in got if r.c == 5} == {1}
