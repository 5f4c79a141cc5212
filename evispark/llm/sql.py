"""DuckDB SQL of the queries that SQL can express, over rows of distinct doc_id."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Every 100-byte string by its digest; the first of equals stays, starts of the others are put together where their bytes
#: meet, and what lies between these runs is kept. Bytes are pairs of hex digits.
OP6 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
s AS (SELECT doc_id, place, md5(substr(h, 2 * place + 1, 200)) AS name FROM (SELECT doc_id, h, unnest(range(greatest(0, n - 99))) AS place FROM d)),
f AS (SELECT doc_id, place FROM s QUALIFY row_number() OVER (PARTITION BY name ORDER BY doc_id, place) > 1),
g AS (SELECT *, CASE WHEN place > lag(place) OVER (PARTITION BY doc_id ORDER BY place) + 100 THEN 1 ELSE 0 END AS new FROM f),
r AS (SELECT doc_id, k, min(place) AS a, max(place) + 100 AS b FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY place) AS k FROM g) GROUP BY doc_id, k),
e AS (SELECT doc_id, a AS upto, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM r UNION ALL SELECT d.doc_id, n, coalesce(max(b), 0) FROM d LEFT JOIN r USING (doc_id) GROUP BY d.doc_id, n),
k AS (SELECT doc_id, string_agg(substr(h, 2 * since + 1, 2 * (upto - since)), '' ORDER BY since) AS kept FROM e JOIN d USING (doc_id) GROUP BY doc_id),
c AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM r GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM d JOIN k USING (doc_id) LEFT JOIN c USING (doc_id)
"""

#: Sets that share a shingle are compared by the number they share; links are followed from every document.
OP7 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_distinct([array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, CAST(len(ws) AS BIGINT) - 3)]) END AS set FROM w),
e AS (SELECT doc_id, len(set) AS n, unnest(set) AS shingle FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
c(doc_id, seen) AS (SELECT doc_id, doc_id FROM s UNION SELECT c.doc_id, l.b FROM c JOIN l ON c.seen = l.a)
SELECT s.doc_id, CAST(len(any_value(set)) AS BIGINT) AS n_shingles, min(seen) AS component_id FROM s JOIN c USING (doc_id) GROUP BY s.doc_id
"""

ORACLE_SQL = {"op6_suffix_dedup": OP6, "op7_jaccard_join": OP7}
