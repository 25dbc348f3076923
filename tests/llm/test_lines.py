import collections
import random

from wayhex.llm import lines, queries

from .common import awkward, frame
from .duck import compare


def test_query_against_sql(spark, sf):
    got = compare(queries.op8_line_spread(spark, sf), queries.ORACLE_SQL["op8_line_spread"], sf)
    assert any(r.n_removed for r in got)


def brute(docs, sites, most_lost=1):
    seen = collections.defaultdict(set)
    for _, text, _, site in docs:
        for x in (text or "").split("\n"):
            if site is not None:
                seen[x.strip(" ")].add(site)
    bad = {x for x, s in seen.items() if x and len(s) >= sites}
    out = []
    for doc, text, _, _ in docs:
        own = (text or "").split("\n")
        good = [x for x in own if x.strip(" ") not in bad]
        kept = own if sum(map(len, own)) - sum(map(len, good)) > most_lost * sum(map(len, own)) else good
        out.append((doc, None if text is None else "\n".join(kept), 0 if text is None else len(own), 0 if text is None else len(own) - len(kept)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in df.collect()), key=str)


def test_spread_around_the_threshold(spark):
    r = random.Random(2)
    pool = {f"line {k}": k for k in (1, 8, 9, 10, 11, 12, 40, 200)}
    docs = []
    for i in range(400):
        own = [f"own text {i} {r.random()}" * 3 for _ in range(4)]
        own += [f"  {x} " for x, k in pool.items() if i < 2 * k]
        docs.append((i, "\n".join(r.sample(own, len(own))), None, f"site{i // 2}" if i % 7 else None))
    docs += [*((*a, None, "s") for a in awkward()), *((900 + i, "copied line one\ncopied line two", None, f"c{i}") for i in range(30))]
    df = frame(spark, docs).withColumnRenamed("lang", "n_lines")
    for sites in (10, 30):
        want = brute(docs, sites)
        assert got(lines.remove_boilerplate(df, sites=sites)) == want
        assert any(x[3] for x in want) and all(x[1:] == ("", 2, 2) for x in want if isinstance(x[0], int) and x[0] >= 900)
        want = brute(docs, sites, 0.5)
        assert got(lines.remove_boilerplate(df, sites=sites, most_lost=0.5)) == want
        assert any(x[3] for x in want) and all(x[3] == 0 for x in want if isinstance(x[0], int) and x[0] >= 900)


def test_an_article_under_long_headers_loses_them(spark):
    head = "\n".join(f"a long header line that stands on every site, number {k}" for k in range(8))
    docs = [(i, f"{head}\nown words {i}", None, f"s{i}") for i in range(12)]
    assert got(lines.remove_boilerplate(frame(spark, docs))) == sorted(((i, f"own words {i}", 9, 8) for i in range(12)), key=str)


def test_empty(spark):
    assert got(lines.remove_boilerplate(frame(spark, []))) == []


def test_texts_go_through_the_join_once(spark):
    docs = frame(spark, [(1, "a\nb", "en", "x"), (2, None, "en", "y")])
    plan = lines.remove_boilerplate(docs)._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "Join":
        plan = plan.children().head()
    left = plan.children().head().output()
    kinds = [left.apply(i).dataType().catalogString() for i in range(left.length())]
    assert sum(k.count("string") for k in kinds) == sum(kind == "string" for _, kind in docs.dtypes), kinds
