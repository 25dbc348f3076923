"""DuckDB SQL of the operators on word shingles, by comparing sets outright."""

from __future__ import annotations

from .containment import THRESHOLD as CONTAINED
from .jaccard import THRESHOLD as SIMILAR


def shingles(name: str, table: str, key: str) -> str:
    """A CTE of the distinct shingles s of each key."""
    return rf"""{name} AS (SELECT DISTINCT {key}, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END) AS s
  FROM (SELECT {key}, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM {table}))"""


CONTAINMENT = f"""
WITH {shingles("d", "documents", "doc_id")}, {shingles("i", "benchmark", "item_id")}, n AS (SELECT item_id, count(*) AS n FROM i GROUP BY item_id),
k AS (SELECT doc_id, item_id, count(*) AS k FROM d JOIN i USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n AS item_shingles, k AS shared, k / n::DOUBLE AS containment FROM k JOIN n USING (item_id) WHERE k >= {CONTAINED} * n"""

JACCARD = f"""
WITH RECURSIVE {shingles("d", "documents", "doc_id")}, n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
k AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM d x JOIN d y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
p AS (SELECT a, b, k = na.n AND k = nb.n AS same FROM k JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE k >= {SIMILAR} * (na.n + nb.n - k) - 1e-9),
e AS (SELECT a, b, same FROM p UNION ALL SELECT b, a, same FROM p),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.c),
c AS (SELECT doc_id, min(c) AS class_id FROM r GROUP BY doc_id), l AS (SELECT a AS doc_id, count(*) AS n_links, min(CASE WHEN same THEN b END) AS first FROM e GROUP BY a)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links, least(doc_id, first) AS set_id FROM c LEFT JOIN l USING (doc_id)"""
