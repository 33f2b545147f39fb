"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

#: Words of a text, in the lower case of A-Z.
_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"

_PAGES = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS f FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN f <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f <> page_id THEN f END AS refers_to, 1 AS n_requests, 1 AS n_metadata FROM f
"""

_LINES = """
WITH l AS (
  SELECT doc_id, unnest(string_split(lower(coalesce(text, '')), chr(10))) AS line, generate_subscripts(string_split(lower(coalesce(text, '')), chr(10)), 1) - 1 AS line_no FROM documents),
w AS (SELECT doc_id, line_no, regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+') AS w FROM l),
k AS (SELECT doc_id, line_no, array_to_string(w, ' ') AS k, w FROM w WHERE len(w) > 0),
c AS (SELECT k, min({'d': doc_id, 'l': line_no}) AS first, any_value(w) AS w FROM k GROUP BY k),
s AS (SELECT k, CASE WHEN len(w) < 5 THEN [k] ELSE list_distinct([array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)]) END AS s FROM c),
t AS (SELECT k, len(s) AS n, unnest(s) AS t FROM s),
p AS (SELECT x.k AS a, y.k AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS m FROM t x JOIN t y ON x.t = y.t AND x.k <> y.k GROUP BY 1, 2),
q AS (SELECT a, count(*) AS n_links, min(c.first) AS earliest FROM p JOIN c ON c.k = p.b WHERE 100 * m >= 75 * (na + nb - m) GROUP BY a)
SELECT k.doc_id, CAST(k.line_no AS INTEGER) AS line_no, c.first.d AS class_doc, CAST(c.first.l AS INTEGER) AS class_line, coalesce(q.n_links, 0) AS n_links,
  coalesce(q.earliest < c.first, false) OR k.doc_id <> c.first.d OR k.line_no <> c.first.l AS removed
FROM k JOIN c USING (k) LEFT JOIN q ON q.a = k.k
"""

_NEAR = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)]) END AS s FROM d),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b FROM t x JOIN t y ON x.t = y.t AND x.doc_id <> y.doc_id GROUP BY 1, 2 HAVING 100 * count(*) >= 75 * (any_value(x.n) + any_value(y.n) - count(*))),
r AS (SELECT doc_id AS node, doc_id AS reached FROM documents UNION SELECT r.node, p.b FROM r JOIN p ON p.a = r.reached),
m AS (SELECT node, min(reached) AS component_id FROM r GROUP BY node)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.component_id, s.doc_id = m.component_id AS kept FROM s JOIN m ON m.node = s.doc_id
"""

_LEAKS = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, unnest([array_to_string(w[k:k+9], ' ') for k in range(1, greatest(2, len(w) - 8))]) AS k, least(10, len(w)) AS n FROM i WHERE len(w) > 0),
g AS (SELECT DISTINCT n FROM v),
o AS (SELECT doc_id, n, unnest([{'pos': k, 'k': array_to_string(w[k:k+n-1], ' ')} for k in range(1, len(w) - n + 2)]) AS o FROM d, g),
f AS (SELECT o.doc_id, o.o.pos AS pos, o.n, v.item_id FROM o JOIN v ON o.o.k = v.k AND o.n = v.n),
h AS (SELECT doc_id, count(DISTINCT pos + j) AS n_hit FROM (SELECT DISTINCT doc_id, pos, n FROM f), LATERAL (SELECT unnest(range(n)) AS j) GROUP BY doc_id),
e AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list_distinct(list(CAST(item_id AS VARCHAR)))), ',') AS names FROM f GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(e.n_items, 0) AS n_items, sha256(coalesce(e.names, '')) AS items_sha256, h.n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN e USING (doc_id)
"""

_NEAREST = """
WITH u AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score FROM u q JOIN u c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""

#: The checksum goes byte by byte over a table of 256 remainders of the polynomial 0xEDB88320.
_RESAMPLED = """
WITH tbl AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, n)) AS r),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
dw AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(w) AS w FROM d) GROUP BY ALL),
bw AS (SELECT w, count(*) AS n FROM (SELECT unnest(w) AS w FROM b) GROUP BY ALL),
v AS (SELECT DISTINCT w FROM (SELECT w FROM dw UNION ALL SELECT w FROM bw)),
y AS (SELECT w, list_transform(range(1, strlen(w) + 1), lambda i: 16 * (instr('0123456789ABCDEF', substr(hex(encode(w)), 2 * i - 1, 1)) - 1) + instr('0123456789ABCDEF', substr(hex(encode(w)), 2 * i, 1)) - 1) AS y FROM v),
k AS (SELECT w, xor(list_reduce(y, lambda c, x: xor(c >> 8, r[CAST(xor(c, x) & 255 AS BIGINT) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % 10000 AS k FROM y, tbl),
s AS (SELECT k, sum(n) AS s FROM dw JOIN k USING (w) GROUP BY k),
t AS (SELECT k, sum(n) AS t FROM bw JOIN k USING (w) GROUP BY k),
g AS (SELECT k, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * ((SELECT coalesce(sum(s), 0)::DOUBLE FROM s) + 10000) / ((coalesce(s, 0)::DOUBLE + 1) * ((SELECT coalesce(sum(t), 0)::DOUBLE FROM t) + 10000)))) AS gain FROM s FULL JOIN t USING (k)),
m AS (SELECT doc_id, floor(sum(n * gain) / sum(n))::BIGINT AS weight FROM dw JOIN k USING (w) JOIN g USING (k) GROUP BY doc_id),
h AS (SELECT doc_id, len(w) AS n_features, coalesce(weight, 0) AS weight, list_reduce(list_transform(range(1, 9), lambda i: (instr('0123456789abcdef', substr(sha256('2024:' || doc_id), i, 1)) - 1)::BIGINT), lambda a, x: a * 16 + x) AS h FROM d LEFT JOIN m USING (doc_id)),
z AS (SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM h),
o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM z WHERE n_features >= 20)
SELECT z.doc_id, n_features, weight, score, CASE WHEN rank <= 10 * (SELECT count(*) FROM o) // 100 THEN rank END AS rank, n_features AS n_words FROM z LEFT JOIN o USING (doc_id)
"""


def _rounds(k: int, rounds: int) -> str:
    near = """SELECT vec_id, v, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT vec_id, v, c, list_inner_product(v, v) - 2 * list_inner_product(v, z) + list_inner_product(z, z) AS d FROM k, z{i}) GROUP BY vec_id, v"""
    parts = [
        f"""k AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
z0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, v AS z FROM k ORDER BY sha256('1:' || vec_id) LIMIT {k})"""
    ]
    for i in range(rounds):
        parts.append(f"""a{i} AS MATERIALIZED ({near.format(i=i)}),
m{i} AS (SELECT c, list(m ORDER BY p) AS z FROM (SELECT c, p, floor(sum(x) / count(*)) AS m FROM (SELECT c, unnest(v) AS x, unnest(range(64)) AS p FROM a{i}) GROUP BY c, p) GROUP BY c),
z{i + 1} AS MATERIALIZED (SELECT z{i}.c, coalesce(m{i}.z, z{i}.z) AS z FROM z{i} LEFT JOIN m{i} USING (c))""")
    parts.append(f"a{rounds} AS MATERIALIZED ({near.format(i=rounds)})")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(z, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256 FROM a{rounds} JOIN z{rounds} USING (c)"""


ORACLES: dict[str, str] = {"op1_warc": _PAGES, "op4_minhash": _NEAR, "op7_line_dedup": _LINES, "op10_decontamination": _LEAKS, "op11_vp_trees": _NEAREST, "op12_resampling": _RESAMPLED, "op13_ball_trees": _rounds(16, 3)}
