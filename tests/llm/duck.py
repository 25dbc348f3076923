"""Compares a query with its SQL on the same tables."""

import collections
from pathlib import Path

import duckdb


def compare(df, sql, sf):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = df.collect()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = cur.fetchall()
    order = [names.index(c) for c in df.columns]
    assert collections.Counter(tuple(r) for r in got) == collections.Counter(tuple(r[i] for i in order) for r in want)
    return got
