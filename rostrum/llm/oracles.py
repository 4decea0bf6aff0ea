"""DuckDB SQL of those queries that SQL can express."""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_COMPONENTS = "reach(a, b) AS (SELECT id, id FROM ids UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a), component AS (SELECT a AS id, min(b) AS c FROM reach GROUP BY 1)"

ORACLE_SQL = {
    "op2_pruned_graph_embeddings": f"""WITH RECURSIVE v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), ids AS (SELECT id FROM v),
good AS (SELECT id, v FROM v WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
both_ways AS MATERIALIZED (SELECT p.id AS a, q.id AS b FROM good p JOIN good q ON p.id <> q.id AND len(p.v) = len(q.v) AND list_cosine_similarity(p.v, q.v) >= 0.95),
{_COMPONENTS}, n AS (SELECT a, count(*) AS n FROM both_ways GROUP BY 1)
SELECT id AS vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, id = c AS kept FROM component LEFT JOIN n ON a = id""",
    "op5_odd_sketch_near_duplicates": f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents), ids AS (SELECT doc_id AS id FROM w),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[k:k + 2], ' ') AS s FROM w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) t(k) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS i FROM s p JOIN s q ON p.s = q.s AND p.doc_id < q.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * i >= 85 * (p.n + q.n - i)),
both_ways AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), {_COMPONENTS}
SELECT id AS doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c AS component_id, id = c AS kept FROM component LEFT JOIN n ON doc_id = id""",
    "op6_arc_to_warc": """WITH d AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS x FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY x) AS f FROM d)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + ((('0x' || substr(x, 1 + 5 * (i // 4), 5))::BIGINT >> (5 * (3 - i % 4))::INT) & 31))::INT, 1)), '') AS payload_digest,
 CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> f THEN f END AS refers_to FROM f""",
    "op10_positional_decontamination": f"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS l, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') AS s FROM i, unnest(range(1, greatest(len(w) - 9, 1) + 1)) t(k) WHERE len(w) > 0),
lens AS (SELECT DISTINCT l FROM win),
hit AS (SELECT o.doc_id, o.k, o.l, item_id FROM (SELECT doc_id, k, l, array_to_string(w[k:k + l - 1], ' ') AS s FROM d, lens, unnest(range(1, len(w) - l + 2)) t(k) WHERE len(w) >= l) o JOIN win USING (s, l)),
n AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(k, k + l)) AS p FROM hit) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY 1)
SELECT d.doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n.n, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)""",
}
