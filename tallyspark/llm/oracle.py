"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

OP3 = r"""
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha256(payload) AS k, sha1(payload) AS h FROM p
), l AS (
  SELECT *, min(page_id) OVER (PARTITION BY k) AS first_id,
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567' AS letters FROM d
)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr(letters,
         ((('0x' || substr(h, (i // 4) * 5 + 1, 5))::BIGINT >> ((3 - i % 4) * 5)::BIGINT) & 31)::INTEGER + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to,
       true AS verified
FROM l
"""

OP4 = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)
"""

#: size, source_size and target of each document, and how often it is taken.
MIX = r"""
  SELECT d.*, CASE WHEN source_size > 0 THEN least(target / source_size, 2.0) ELSE 0 END AS rate,
         ('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
  FROM (SELECT s.*, t.source_size, t.target FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source) d
"""
TARGETS = r"""
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighted AS (
  SELECT *, 2.0::DOUBLE * source_size AS room,
         [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER]::DOUBLE AS weight FROM sources
), levels AS (
  SELECT *, room / weight AS ratio,
         (sum(source_size) OVER () * 1.5::DOUBLE
          - coalesce(sum(room) OVER (ORDER BY room / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
         / sum(weight) OVER (ORDER BY room / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighted
), targets AS (
  SELECT source, source_size, least(room, coalesce((SELECT arg_min(level, ratio) FROM levels WHERE level <= ratio) * weight, room)) AS target
  FROM levels
)
"""

OP5 = rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), {TARGETS}, mixed AS ({MIX})
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM mixed
"""

OP6 = r"""
WITH sound AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), normed AS (
  SELECT vec_id, v, list_reduce(list_transform(v, lambda x: x * x), lambda a, b: a + b) AS vv FROM sound
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_reduce(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]), lambda a, b: a + b) / (sqrt(q.vv) * sqrt(c.vv)) AS score
  FROM normed q JOIN normed c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 5
"""


OP8 = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingled AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN []::VARCHAR[]
                      WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                      ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM worded
), sets AS (
  SELECT min(doc_id) AS rep, list_sort(s) AS s, len(s) AS n FROM shingled WHERE len(s) > 0 GROUP BY ALL
), items AS (
  SELECT rep, n, unnest(s) AS x FROM sets
), pairs AS (
  SELECT a.rep AS a, b.rep AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS common
  FROM items a JOIN items b ON a.x = b.x AND a.rep < b.rep AND a.n * 100 >= b.n * 90 AND b.n * 100 >= a.n * 90
  GROUP BY a.rep, b.rep
), links AS (
  SELECT a, b FROM pairs WHERE 100 * common >= 90 * (na + nb - common)
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(node, other) AS (
  SELECT rep, rep FROM sets
  UNION
  SELECT r.node, e.b FROM reach r JOIN edges e ON r.other = e.a
), lowest AS (
  SELECT node, min(other) AS component_id FROM reach GROUP BY node
)
SELECT d.doc_id, len(d.s)::BIGINT AS n_shingles, CASE WHEN len(d.s) = 0 THEN d.doc_id ELSE l.component_id END AS component_id
FROM shingled d LEFT JOIN sets t ON list_sort(d.s) = t.s LEFT JOIN lowest l ON t.rep = l.node
"""


#: A round: each vector's nearest centroid, and the floored means of each non-empty cluster. DuckDB's // cuts towards zero.
ROUND = """
a{n} AS MATERIALIZED (
  SELECT vec_id, any_value(v) AS v, arg_min(number, d * 16 + number) AS number, min(d) AS d
  FROM (SELECT p.vec_id, p.v, c.number, list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM points p, c{n} c)
  GROUP BY vec_id
)"""
MEANS = """
m{n} AS (
  SELECT number, list((s - ((s % n) + n) % n) // n ORDER BY place) AS v
  FROM (SELECT number, place, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT number, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM a{n}) GROUP BY number, place)
  GROUP BY number
), c{next} AS MATERIALIZED (
  SELECT number, coalesce(m{n}.v, c{n}.v) AS v FROM c{n} LEFT JOIN m{n} USING (number)
)"""
OP11 = (
    """
WITH points AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS number, v FROM points QUALIFY number < 16
),"""
    + ",".join(ROUND.format(n=n) + "," + MEANS.format(n=n, next=n + 1) for n in range(3))
    + ","
    + ROUND.format(n=3)
    + """
SELECT vec_id, number::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY number)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(c3.v, ',')) AS centroid_sha256
FROM a3 JOIN c3 USING (number)
"""
)

OP12 = r"""
WITH digits AS (  -- what a byte does to a CRC-32
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS t FROM range(256) r(b)
), words AS (
  SELECT 0 AS side, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents
  UNION ALL
  SELECT 1, NULL, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark
), counted AS MATERIALIZED (
  SELECT side, doc_id, w, count(*) AS n FROM words GROUP BY ALL
), hashed AS MATERIALIZED (
  SELECT w, xor(list_reduce(list_transform(range(octet_length(encode(w))), lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::BIGINT),
                lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295::BIGINT) % 10000 AS bucket
  FROM (SELECT DISTINCT w FROM counted), digits
), sums AS (
  SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0)::BIGINT AS s, coalesce(sum(n) FILTER (side = 1), 0)::BIGINT AS t FROM counted JOIN hashed USING (w) GROUP BY bucket
), gained AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((sum(s) OVER ())::DOUBLE + 10000) / ((s + 1)::DOUBLE * ((sum(t) OVER ())::DOUBLE + 10000))))::BIGINT AS gain FROM sums
), weighed AS (
  SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS total FROM counted JOIN hashed USING (w) JOIN gained USING (bucket) WHERE side = 0 GROUP BY doc_id
), scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0)::BIGINT AS weight,
         ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT AS h
  FROM documents LEFT JOIN weighed USING (doc_id)
), all_rows AS (
  SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM scored
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_features >= 20) OVER () AS many FROM all_rows
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * many // 100 THEN place END AS rank FROM placed
"""

OP13 = r"""
WITH lines AS (
  SELECT doc_id, line, pos, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
), judged AS (
  SELECT *, length(key) >= 10 AND doc_id <> min(doc_id) OVER (PARTITION BY key) AS gone FROM lines
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_warc_archive": OP3, "op4_exact_dedup": OP4, "op5_source_mix": OP5, "op6_nearest_neighbours": OP6, "op8_ngram_join": OP8, "op11_sort_means": OP11, "op12_resampling": OP12, "op13_line_dedup": OP13}
