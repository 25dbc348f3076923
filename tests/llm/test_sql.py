import pytest

from wayhex.llm import queries

from .duck import compare


@pytest.mark.parametrize("name", ["op1_ngram_jaccard_join", "op10_minhash_containment"])
def test_query_against_sql(spark, sf, name):
    assert compare(queries.QUERIES[name](spark, sf), queries.ORACLE_SQL[name], sf)
