"""The shingle operators' results in DuckDB's SQL, on whole texts; shingles are compared as strings."""

from __future__ import annotations

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# What is not part of a word.
WORD = r"[^\x20\x09-\x0D]+"


def shingles(name: str, key: str, source: str) -> str:
    """``name``: key, g - the distinct five-word shingles of each text of ``source``."""
    return f"""
{name}_w AS (SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{WORD}') AS w FROM {source}),
{name} AS (SELECT DISTINCT {key}, unnest(CASE WHEN len(w) = 0 THEN cast([] AS varchar[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] END) AS g FROM {name}_w)"""


CONTAMINATION = f"""WITH {shingles("d", "doc_id", "documents")},{shingles("b", "item_id", "benchmark")},
n AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY 1),
m AS (SELECT doc_id, item_id, count(*) AS n_found FROM d JOIN b USING (g) GROUP BY ALL),
f AS (SELECT doc_id, item_id, n_found / n_item AS c FROM m JOIN n USING (item_id) WHERE 100 * n_found >= 75 * n_item),
s AS (SELECT doc_id, count(*) AS n_items, list(item_id ORDER BY item_id) AS item_ids, max(c) AS containment FROM f GROUP BY 1)
SELECT doc_id, coalesce(n_items, 0) AS n_items, coalesce(item_ids, cast([] AS bigint[])) AS item_ids, coalesce(containment, 0.0::double) AS containment, n_items IS NOT NULL AS contaminated
FROM documents LEFT JOIN s USING (doc_id)"""

COMPONENTS = f"""WITH RECURSIVE {shingles("d", "doc_id", "documents")},
n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY 1),
c AS (SELECT x.doc_id AS u, y.doc_id AS v, count(*) AS shared FROM d x JOIN d y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT u, v FROM c JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * shared >= 75 * (a.n + b.n - shared)),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, v FROM reach JOIN links ON r = u)
SELECT doc_id, cast(coalesce(any_value(n.n), 0) AS bigint) AS n_shingles, min(r) AS component_id FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id"""
