"""DuckDB SQL for the registered queries that SQL can express."""

_WORDS = (r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
          r"'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')")

#: Used again for the pipeline, with its own documents.
DECONTAMINATE = f"""
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
it AS (SELECT DISTINCT item_id::VARCHAR AS item_id, {_WORDS} AS ws FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS s FROM it WHERE len(ws) > 0),
win AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[s:s + least(len(ws), 10) - 1], ' ') AS w FROM iw),
lens AS (SELECT DISTINCT n FROM win),
dp AS (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM d, lens WHERE len(ws) >= n),
dw AS (SELECT r, s, n, array_to_string(ws[s:s + n - 1], ' ') AS w FROM dp),
hit AS (SELECT r, s, dw.n, item_id FROM dw JOIN win USING (n, w)),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM hit) GROUP BY r),
ids AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
        FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
"""

_BLANK_WORDS = (r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
                r"'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')")

ORACLE = {
    "op4_ngram_join": f"""
WITH RECURSIVE d AS (SELECT doc_id, {_BLANK_WORDS} AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS s FROM d WHERE len(ws) > 0),
g AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(ws[s:s + 4], ' ') AS gram FROM p),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS reach FROM d UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.reach)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.reach) AS component_id
FROM d JOIN r ON r.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id, n.n
""",
    "op8_decontaminate": f"""
WITH {DECONTAMINATE}
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN ids USING (r)
""",
    "op10_vector_search": """
WITH v AS (
  SELECT vec_id, min(embedding::DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
  GROUP BY vec_id),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         list_reduce(list_prepend(0::DOUBLE, list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])),
                     lambda a, b: a + b) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
""",
    "op11_minmax_duplicates": f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_BLANK_WORDS} AS ws FROM documents),
p AS (SELECT r, ws, unnest(range(1, greatest(len(ws) - 1, 1) + 1)) AS s FROM d WHERE len(ws) > 0),
g AS MATERIALIZED (SELECT DISTINCT r, array_to_string(ws[s:s + 1], ' ') AS gram FROM p),
n AS MATERIALIZED (SELECT r, count(*) AS n FROM g GROUP BY r),
o AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM g a JOIN g b ON a.gram = b.gram AND a.r < b.r GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM o JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * c >= 80 * (x.n + y.n - c)
                   UNION SELECT x.r, y.r FROM d x JOIN d y ON x.doc_id = y.doc_id AND x.r < y.r),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
t AS (SELECT r, r AS reach FROM d UNION SELECT t.r, e.b FROM t JOIN e ON e.a = t.reach),
m AS (SELECT t.r, min(d.doc_id) AS component_id FROM t JOIN d ON d.r = t.reach GROUP BY t.r)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id,
       coalesce(d.doc_id = m.component_id, m.component_id IS NULL) AS kept
FROM d JOIN m USING (r) LEFT JOIN n USING (r)
""",
}
