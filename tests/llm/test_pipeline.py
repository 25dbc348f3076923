import corpus_pipeline
from wayhex.llm import language, queries
from wayhex.llm.storage import written

from . import test_containment, test_jaccard, test_lines, test_packing
from .common import frame


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    rows = lambda df: {r.doc_id: r for r in df.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "best-fit packing"]
    (_, lang), (_, line), (_, near), (_, leak), (_, pack) = corpus_pipeline.STAGES

    before = rows(docs)
    docs = written(lang(spark, docs, sf), "t")
    found = {r.doc_id: r for r in language.identify(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    kept = rows(docs)
    assert docs.columns == columns and set(kept) == {d for d in before if found[d].lang_pred != "und" and found[d].known >= corpus_pipeline.LEAST_KNOWN}
    assert len(kept) >= 0.98 * sum(any(c.isalpha() for c in r.text or "") for r in before.values())

    want = {d: (t, len(t)) for d, t, _, _ in test_lines.brute([(r.doc_id, r.text, None, r.source) for r in kept.values()], 10, 0.5)}
    docs = written(line(spark, docs, sf), "t")
    kept = rows(docs)
    assert docs.columns == columns and {d: (r.text, r.n_chars) for d, r in kept.items()} == want

    want = {c for d, c, _, _ in test_jaccard.brute([(r.doc_id, r.text) for r in kept.values()]) if d == c}
    docs = written(near(spark, docs, sf), "t")
    kept = rows(docs)
    assert docs.columns == columns and set(kept) == want

    items = [tuple(r)[:2] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaks = {r[0] for r in test_containment.brute([(r.doc_id, r.text) for r in kept.values()], items)}
    docs = written(leak(spark, docs, sf), "t")
    after = rows(docs)
    assert docs.columns == columns and set(after) == set(kept) - leaks

    out = pack(spark, docs, sf).collect()
    test_packing.check(out, [(r.doc_id, r.text) for r in after.values()])
    whole = queries_run(spark, sf)
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in whole) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in out)


def queries_run(spark, sf):
    import __spark_entry__ as entry

    assert "pipeline" in entry.queries() and "pipeline" not in entry.oracle_sql()
    assert set(queries.QUERIES) <= set(entry.queries())
    return entry.queries()["pipeline"](spark, sf).collect()


def test_awkward_rows(spark, sf):
    docs = frame(spark, [(None, "no id here, but some words"), (1, None), (2, ""), (3, "same text"), (3, "same text"), *[(10 + i, f"the words of document number {i} are these and those", "en", "s") for i in range(30)]])
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf), "t")
    assert docs.count() > 0
    empty = frame(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf)
    assert empty.collect() == []


def test_rows_without_or_with_repeated_ids_have_verdicts_of_their_own(spark, sf, tmp_path):
    (_, lang), _, (_, near), (_, leak), _ = corpus_pipeline.STAGES
    texts = lambda df: sorted(r.text for r in df.collect())
    words = [(100 + i, f"the words of document number {i} are these and those", "en") for i in range(30)]
    kept = texts(lang(spark, frame(spark, [*words, (None, "the words of document"), (None, "12 34"), (5, "these and those"), (5, "!")]), sf))
    assert kept == sorted([*(t for _, t, _ in words), "the words of document", "these and those"])

    one, two, three = ("alpha beta gamma delta epsilon zeta", "one two three four five six seven", "red green blue yellow pink brown")
    rows = [(None, one), (None, two), (None, one), (3, two), (3, two), (4, three), (2, three), (2, three)]
    assert sorted(((r.doc_id, r.text) for r in near(spark, frame(spark, rows), sf).collect()), key=str) == [(2, three), (3, two), (None, one)]

    spark.createDataFrame([(1, two)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = leak(spark, frame(spark, [(None, one), (None, two), (7, two), (7, three)]), str(tmp_path))
    assert left.columns == frame(spark, []).columns and texts(left) == sorted([one, three])


def test_language_stage_against_plain_rules(spark, sf):
    """Not by the operator: documents without letters go, those of words that no learned text has go, labelled ones stay."""
    (_, lang), *_ = corpus_pipeline.STAGES
    docs = [r for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r.lang and any(c.isalpha() for c in r.text or "")]
    strange = [(100_000 + i, " ".join(["zqxjk", "qzwvx", "xjqzk", "vwqxz"][j % 4] for j in range(60)), None, "s", 1) for i in range(5)]
    none = [(200_000, None, None, "s", 0), (200_001, "", None, "s", 0), (200_002, "12 + 34 = 46!", None, "s", 13)]
    rows = spark.createDataFrame([*[tuple(r) for r in docs], *strange, *none], spark.read.parquet(f"{sf}/documents.parquet").schema)
    kept = {r.doc_id for r in lang(spark, rows, sf).collect()}
    assert kept <= {r.doc_id for r in docs}
    assert len(kept) >= 0.99 * len(docs)


def test_what_stages_write_is_deleted(spark, sf):
    from wayhex.llm import storage

    since = storage.mark()
    out = corpus_pipeline.run(spark, sf)
    left = [path.rsplit("/", 1)[1].split("-")[0] for _, path in storage._written[since:]]
    assert left.count("stage") == 1 and "features" not in left and "rows" not in left
    assert out.count() > 0
