"""Every registered query with SQL against DuckDB on the same tables; the others run and have rows."""

import collections
from pathlib import Path

import duckdb
import pytest

from wayhex.plans.all import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def tidy(row):
    return tuple(0.0 if isinstance(x, float) and x == 0 else x for x in row)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    got = df.collect()
    if name not in ORACLE_SQL:
        assert got
        return
    cur = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in df.columns]
    assert collections.Counter(map(tidy, got)) == collections.Counter(tidy(r[i] for i in order) for r in cur.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
