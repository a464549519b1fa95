"""DuckDB SQL for the queries that SQL can express over whole tables."""

#: Payload digests are compared in hex inside and shown in base32 outside; revisits name the least page of equal payload.
_WARC = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
h AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS hex FROM p),
b AS (SELECT page_id, payload_bytes, hex,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(hex, 1 + 10 * (i // 8), 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31 AS INT), 1)), '') AS payload_digest,
  min(page_id) OVER (PARTITION BY hex) AS first FROM h)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM b
"""

_TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, r.vec_id, CAST(list_dot_product(q.e, r.e) AS BIGINT) AS score FROM v q JOIN v r ON q.vec_id <> r.vec_id AND len(q.e) = len(r.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

#: Sets of shingles, counts of common ones, links, and the closure of the links.
_JACCARD = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, reach) AS (SELECT a, b FROM e UNION SELECT r.id, e.b FROM r JOIN e ON r.reach = e.a),
m AS (SELECT id, min(reach) AS least FROM r GROUP BY id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(m.least, w.doc_id)) AS component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.id = w.doc_id
"""

#: All strings of 100 bytes, those that also start earlier, the runs they cover, and what lies between the runs.
_REPEATS = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
w AS (SELECT doc_id, b, unnest(range(1, n - 98)) AS p FROM d WHERE n >= 100),
f AS (SELECT doc_id, p, row_number() OVER (PARTITION BY b[p:p + 99] ORDER BY doc_id, p) AS r FROM w),
m AS (SELECT doc_id, p, CAST(coalesce(p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100, true) AS INT) AS new FROM f WHERE r > 1),
g AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM m),
u AS (SELECT doc_id, run, min(p) AS s, max(p) + 99 AS e FROM g GROUP BY ALL),
k AS (SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) + 1 AS a, s - 1 AS z FROM u UNION ALL SELECT u.doc_id, max(u.e) + 1, max(d.n) FROM u JOIN d ON d.doc_id = u.doc_id GROUP BY u.doc_id),
t AS (SELECT k.doc_id, sha256(unhex(coalesce(string_agg(hex(d.b[k.a:k.z]), '' ORDER BY k.a) FILTER (WHERE k.z >= k.a), ''))) AS sha FROM k JOIN d ON d.doc_id = k.doc_id GROUP BY k.doc_id),
c AS (SELECT doc_id, CAST(sum(e - s + 1) AS BIGINT) AS n_removed, count(*) AS n_spans FROM u GROUP BY doc_id)
SELECT d.doc_id, d.n AS n_bytes, coalesce(c.n_removed, 0) AS n_removed, coalesce(c.n_spans, 0) AS n_spans, coalesce(t.sha, sha256(d.b)) AS kept_sha256 FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""



def _spans(order: int, kind: str, pattern: str, group: int, least: int) -> str:
    """Rows (doc_id, o, kind, a, z) of a rule's matches; a match starts after all parts between matches, and matches, before it."""
    return f"""SELECT doc_id, {order} AS o, '{kind}' AS kind, a, a + length(m) AS z FROM (SELECT doc_id, unnest(ms) AS m, unnest(gs) AS g,
unnest(list_transform(range(1, len(ms) + 1), lambda i: CAST(list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT))) AS a
FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS ms, regexp_extract_all(t, '{pattern}', {group}) AS gs, string_split_regex(t, '{pattern}') AS ps FROM d WHERE regexp_matches(t, '{pattern}'))) WHERE length(g) >= {least}"""


_SECRETS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join((
    _spans(0, "assign", r"""(?i)(password|passwd|secret|token|api_?key)["\'\']?\x20*[:=]\x20*["\'\']?([A-Za-z0-9+/_.=-]+)""".replace("\\'\\'", "''"), 2, 12),
    _spans(1, "access", "AKIA[A-Z0-9]+", 0, 18),
    _spans(2, "hex", "[0-9a-f]{16,}", 0, 16),
    _spans(3, "pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1),
    _spans(4, "jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 1),
))}),
g AS (SELECT doc_id, count(*) FILTER (WHERE o = 0) AS n_assign, count(*) FILTER (WHERE o = 1) AS n_access, count(*) FILTER (WHERE o = 2) AS n_hex,
  string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, o) FILTER (WHERE o < 3) AS base, string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, o) AS spans FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)
"""

ORACLE = {"op2_secret_scans": _SECRETS, "op1_warc": _WARC, "op6_exact_top_k": _TOP_K, "op7_ngram_jaccard": _JACCARD, "op10_suffix_dedup": _REPEATS}
