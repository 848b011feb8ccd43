"""DuckDB SQL for the queries whose whole result it can express."""

from __future__ import annotations

#: Five-word shingles, all pairs that share one, and the closure of the links.
JACCARD_JOIN = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
    SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
sized AS (SELECT doc_id, len(s) AS n, s FROM sets),
same AS (SELECT s, min(doc_id) AS rep, any_value(n) AS n FROM (SELECT doc_id, n, list_sort(s) AS s FROM sized WHERE n > 0) GROUP BY s),
tokens AS (SELECT rep, n, unnest(s) AS t FROM same),
pairs AS (SELECT a.rep AS a, b.rep AS b, a.n AS n, b.n AS m, count(*) AS c FROM tokens a JOIN tokens b ON a.t = b.t AND a.rep < b.rep GROUP BY ALL),
links AS (SELECT a, b FROM pairs WHERE 100 * c >= 80 * (n + m - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT rep AS a, rep AS b FROM same UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
roots AS (SELECT a AS rep, min(b) AS root FROM reach GROUP BY a)
SELECT d.doc_id, d.n::BIGINT AS n_shingles, coalesce(r.root, d.doc_id) AS component_id
FROM sized d LEFT JOIN same x ON d.n > 0 AND list_sort(d.s) = x.s LEFT JOIN roots r ON x.rep = r.rep
"""

#: Every query against every row.
TOPK_SEARCH = """
WITH x AS (
    SELECT vec_id, list_transform(embedding, lambda c: floor(64 * c::DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
q AS (SELECT DISTINCT vec_id AS query_id, v AS qv FROM x WHERE vec_id % 20 = 0),
s AS (SELECT query_id, qv, vec_id, list_dot_product(qv, v)::BIGINT AS score FROM q JOIN x ON query_id <> vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, qv ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""
