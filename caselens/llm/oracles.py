"""The same results in DuckDB SQL, for the queries whose contracts SQL can state."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op7_suffix_array_dedup"] = r"""
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n
           FROM documents),
starts AS (SELECT doc_id, n, h, unnest(range(0, n - 199)) AS s FROM h),
-- A string of 200 bytes that starts in more than one place covers its bytes.
twice AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, md5_number(substr(h, 2 * s + 1, 400)) AS g FROM starts)
  QUALIFY count(*) OVER (PARTITION BY g) > 1),
-- Starts at most 200 apart cover one run.
run AS (
  SELECT doc_id, min(s) AS s, max(s) + 200 AS e
  FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS r
        FROM (SELECT *, (coalesce(s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) > 200, true))::INT AS new
              FROM twice))
  GROUP BY doc_id, r),
runs AS (SELECT doc_id, list(s ORDER BY s) AS s, list(e ORDER BY s) AS e, sum(e - s) AS removed
         FROM run GROUP BY doc_id),
kept AS (
  SELECT doc_id, n, coalesce(removed, 0)::BIGINT AS removed, coalesce(len(s), 0) AS spans,
         CASE WHEN s IS NULL THEN h ELSE list_aggregate([
           substr(h, 2 * (list_concat([0], e))[i] + 1,
                  2 * ((list_concat(s, [n]))[i] - (list_concat([0], e))[i]))
           FOR i IN range(1, len(s) + 2)], 'string_agg', '') END AS h
  FROM h LEFT JOIN runs USING (doc_id))
SELECT doc_id, n AS n_bytes, removed AS n_removed, spans AS n_spans, sha256(unhex(h)) AS kept_sha256
FROM kept
"""

ORACLES["op8_ngram_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(
    CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)] END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k
  FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
links AS (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * k >= 90 * (x.n + y.n - k)),
reach(a, b) AS (
  SELECT a, b FROM links
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles,
       least(d.doc_id, (SELECT min(b) FROM reach WHERE a = d.doc_id)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id)
"""

ORACLES["op11_periodic_runs"] = r"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         -- The checksum of the decimal id, byte by byte and bit by bit.
         xor(4294967295, list_reduce(
           list_concat([4294967295::BIGINT], [ord(c)::BIGINT FOR c IN string_split(doc_id::VARCHAR, '')]),
           lambda s, c: list_reduce(list_concat([xor(s, c)], [0::BIGINT FOR i IN range(8)]),
                                 lambda x, y: xor(x >> 1, (x & 1) * 3988292384)))) AS h
  FROM documents),
place AS (SELECT *, len(w) AS n, h // 10 AS g,
                 CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM t),
part AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM place),
word AS (
  SELECT doc_id, n, i, w[1 + CASE WHEN a IS NULL OR i < a THEN i ELSE a + (i - a) % p END] AS word
  FROM (SELECT *, unnest(range(n)) AS i FROM part)),
same AS (
  SELECT x.doc_id, y.i - x.i AS q, x.i
  FROM word x JOIN word y ON x.doc_id = y.doc_id AND x.word = y.word AND x.i < y.i
    AND 2 * (y.i - x.i) <= x.n),
stretch AS (
  SELECT doc_id, q, min(i) AS start, count(*) + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM same)
  GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(12, 2 * q)),
-- Stretches of several periods that cover the same words are one run of the smallest.
run AS (SELECT doc_id, start, length, min(q) AS period FROM stretch GROUP BY doc_id, start, length),
runs AS (
  SELECT doc_id, count(*) AS n_runs,
         string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
  FROM run GROUP BY doc_id),
best AS (
  SELECT * FROM run
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, period) = 1),
dropped AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM run),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS words
  FROM word ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period,
       1000 * length // period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
       sha256(coalesce(words, '')) AS collapsed_sha256
FROM documents d LEFT JOIN runs USING (doc_id) LEFT JOIN best USING (doc_id)
  LEFT JOIN kept USING (doc_id)
"""

ORACLES["op12_content_sort"] = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t
  FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM n WINDOW same AS (PARTITION BY t)
"""

ORACLES["op13_hard_negatives"] = r"""
WITH v AS (
  SELECT vec_id AS id,
         CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * x::DOUBLE) for x in embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR isnan(x) OR isinf(x)]) = 0),
scored AS (
  SELECT a.id AS a, b.id AS b, a.label = b.label AS same,
         list_dot_product(a.v, b.v)::BIGINT AS s
  FROM v a JOIN v b ON a.id % 100 = 0 AND a.id <> b.id),
positive AS (
  SELECT * FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id,
       row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.b)::INT AS rank,
       n.b AS negative_id, p.s AS positive_score, n.s AS negative_score
FROM positive p JOIN scored n
  ON n.a = p.a AND NOT n.same AND 80 * p.s <= 100 * n.s AND 100 * n.s <= 100 * p.s
QUALIFY rank <= 5
"""
