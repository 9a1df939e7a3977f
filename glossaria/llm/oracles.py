"""DuckDB SQL that gives the same rows as the queries of this subpackage, where SQL can express them."""

_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"

_OP2 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
tok AS (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS pos FROM d),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark),
wi AS (SELECT DISTINCT item, w[s + 1 : s + 10] AS w FROM (SELECT item, w, unnest(range(greatest(1, len(w) - 9))) AS s FROM b WHERE len(w) > 0)),
win AS (SELECT row_number() OVER () AS k, w FROM (SELECT DISTINCT w FROM wi)),
place AS (SELECT k, len(w) AS n, unnest(w) AS word, unnest(range(len(w))) AS off FROM win),
seen AS (SELECT word, count(*) AS c FROM tok GROUP BY word),
ranked AS (SELECT k, n, word, off, row_number() OVER (PARTITION BY k ORDER BY coalesce(c, 0), word, off) AS rank FROM place LEFT JOIN seen USING (word)),
a AS (SELECT k, n, max(word) FILTER (rank = 1) AS w1, max(off) FILTER (rank = 1) AS o1, max(word) FILTER (rank = 2) AS w2, max(off) FILTER (rank = 2) AS o2, max(word) FILTER (rank = 3) AS w3, max(off) FILTER (rank = 3) AS o3 FROM ranked GROUP BY k, n),
c1 AS (SELECT r, k, n, pos - o1 AS start, w2, o2, w3, o3 FROM tok JOIN a ON word = w1),
c2 AS (SELECT c1.* FROM c1 JOIN tok ON tok.r = c1.r AND word = w2 AND abs(pos - start - o2) <= 2 UNION SELECT * FROM c1 WHERE w2 IS NULL),
c3 AS (SELECT c2.r, k FROM c2 JOIN tok ON tok.r = c2.r AND word = w3 AND abs(pos - start - o3) <= 2 UNION SELECT r, k FROM c2 WHERE w3 IS NULL),
ex AS (SELECT c1.r, c1.k, start, c1.n FROM c1 JOIN d ON d.r = c1.r JOIN win ON win.k = c1.k WHERE start >= 0 AND d.w[start + 1 : start + c1.n] = win.w),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(start, start + n)) AS p FROM ex) GROUP BY r),
it AS (SELECT r, list_sort(list(DISTINCT item)) AS items FROM ex JOIN win USING (k) JOIN wi ON wi.w = win.w GROUP BY r),
nr AS (SELECT r, count(DISTINCT item) AS n_near FROM c3 JOIN win USING (k) JOIN wi ON wi.w = win.w GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near_items
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r) LEFT JOIN nr USING (r)
"""

_OP6 = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 5], ' ') AS g FROM (SELECT doc_id, w, unnest(range(greatest(1, len(w) - 4))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
links AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT a AS doc_id, a AS top FROM links UNION SELECT links.b, reach.top FROM reach JOIN links ON links.a = reach.doc_id),
c AS (SELECT doc_id, min(top) AS comp FROM reach GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(comp, d.doc_id) AS component_id, coalesce(comp, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id
"""

_OP9 = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(embedding, lambda y: y <> 0)) > 0),
u AS (SELECT vec_id, x, sqrt(list_dot_product(x, x)) AS l FROM v),
e AS (SELECT p.vec_id AS a, q.vec_id AS b FROM u p JOIN u q ON p.vec_id < q.vec_id AND len(p.x) = len(q.x) WHERE list_dot_product(p.x, q.x) / (p.l * q.l) >= 0.9),
links AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a),
reach AS (SELECT a AS vec_id, a AS top FROM links UNION SELECT links.b, reach.top FROM reach JOIN links ON links.a = reach.vec_id),
c AS (SELECT vec_id, min(top) AS comp FROM reach GROUP BY vec_id)
SELECT t.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(comp, t.vec_id) AS component_id, coalesce(comp, t.vec_id) = t.vec_id AS kept
FROM embeddings t LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)
"""

_OP13 = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, part, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, min(doc_id) OVER (PARTITION BY text) AS least FROM d),
m AS (SELECT doc_id, part, CAST(len(w) < 200 AS INTEGER) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INTEGER) + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS INTEGER)
  + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INTEGER) + 16 * CAST(coalesce(least < doc_id, FALSE) AS INTEGER) AS mask FROM w),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), FALSE) AS good, coalesce(bool_or(toxic = 1), FALSE) AS bad FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (bad) AS t FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS f(x, bit)),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM f a JOIN f b ON b.x <> a.x JOIN f c ON c.x NOT IN (a.x, b.x) JOIN f d ON d.x NOT IN (a.x, b.x, c.x) JOIN f e ON e.x NOT IN (a.x, b.x, c.x, d.x)),
s AS (SELECT filter_order, CAST(k AS INTEGER) AS step, bits[k] AS bit, CAST(coalesce(list_sum(bits[1 : k - 1]), 0) AS INTEGER) AS earlier FROM (SELECT filter_order, bits, unnest(range(1, 6)) AS k FROM o)),
r AS (SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (mask & (earlier | bit) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & bit > 0 AND mask & earlier = 0), 0) AS removed,
  coalesce(sum(n) FILTER (mask & bit > 0 AND mask & earlier > 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
  coalesce(sum(g) FILTER (mask & bit > 0 AND mask & earlier = 0), 0) AS good_lost, coalesce(sum(t) FILTER (mask & bit > 0 AND mask & earlier = 0), 0) AS toxic_lost
  FROM c CROSS JOIN s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r
"""

ORACLE_SQL: dict[str, str] = {
    "op2_benchmark_decontamination": _OP2,
    "op6_minhash_near_dedup": _OP6,
    "op9_embedding_near_dedup": _OP9,
    "op13_filter_audit": _OP13,
}
