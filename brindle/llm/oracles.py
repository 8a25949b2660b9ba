"""DuckDB SQL for the queries that SQL can express: brute force over whole tables."""

_WORDS = "list_filter(string_split_regex({t}, '[ \\x09-\\x0D]+'), lambda x: x <> '')"

#: Every window of 50 words by its hash, and the least document that holds it.
OP2 = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format(t="coalesce(text, '')")} AS w FROM documents),
s AS (SELECT r, doc_id, unnest(range(1, len(w) - 48)) AS a, w FROM d WHERE len(w) >= 50),
k AS (SELECT r, doc_id, a, sha256(array_to_string(list_slice(w, a, a + 49), ' ')) AS h FROM s),
f AS (SELECT h, min(doc_id) AS low FROM k GROUP BY h HAVING count(DISTINCT doc_id) > 1),
g AS (SELECT DISTINCT r, i FROM (SELECT r, unnest(range(a, a + 50)) AS i FROM k JOIN f USING (h) WHERE doc_id > low)),
x AS (SELECT r, list(i) AS gone FROM g GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256 FROM d LEFT JOIN x USING (r)"""

#: Sets of shingles, one of each kind; pairs that share a shingle; reachability.
OP6 = f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(t="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(list_slice(w, i, i + 2), ' '))) END AS g FROM d),
n AS (SELECT doc_id, CAST(len(g) AS BIGINT) AS n, g FROM s),
c AS (SELECT g, min(doc_id) AS rep, any_value(n) AS n FROM (SELECT doc_id, n, list_sort(g) AS g FROM n) GROUP BY g),
u AS (SELECT rep, n, unnest(g) AS x FROM c),
e AS (SELECT a.rep AS a, b.rep AS b FROM u a JOIN u b ON a.x = b.x AND a.rep < b.rep GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(a, b) AS (SELECT rep, rep FROM c UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON r.b = w.a),
low AS (SELECT a AS rep, min(b) AS component_id FROM reach GROUP BY a)
SELECT n.doc_id, n.n AS n_shingles, CASE WHEN n.n = 0 THEN n.doc_id ELSE low.component_id END AS component_id, (CASE WHEN n.n = 0 THEN n.doc_id ELSE low.component_id END) = n.doc_id AS kept FROM n LEFT JOIN c ON list_sort(n.g) = c.g LEFT JOIN low ON low.rep = c.rep"""

#: All queries against all rows.
OP7 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS w FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.w, c.w) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
t AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM t WHERE rank <= 10"""
