"""DuckDB SQL for the queries that SQL can express."""

MIXING = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]+')) AS runs,
         (CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM documents),
k AS (SELECT *, -ln(u) / greatest(1.0::DOUBLE - runs / greatest(size, 1)::DOUBLE, 0.05::DOUBLE) AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM s),
w AS (SELECT *, [5.0, 2.0, 1.0][((rk - 1) % 3 + 1)::INT]::DOUBLE AS w, source_size * 3.0::DOUBLE AS cap FROM r),
l AS (SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lev FROM w),
f AS (SELECT *, cap <= lev * w AS is_full FROM l),
g AS (SELECT arg_min(lev, rk_fill) AS lev FROM (SELECT *, row_number() OVER (ORDER BY cap / w, rk) AS rk_fill FROM f) WHERE NOT is_full),
t AS (SELECT source, source_size, CASE WHEN is_full THEN cap ELSE g.lev * w END AS target FROM f LEFT JOIN g ON true),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
b AS (SELECT k.doc_id, k.size, k.key, e.source, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
             sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key) AS cum
      FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source),
o AS (SELECT source, min(cum) FILTER (cum > rest) AS over_end, coalesce(max(cum) FILTER (cum <= rest), 0) AS under_end FROM b GROUP BY source)
SELECT b.doc_id, b.size, b.source_size, b.target,
       (b.size * (b.epochs + CASE WHEN b.rest > 0 AND (b.cum <= b.rest OR (b.cum = o.over_end AND o.over_end - b.rest < b.rest - o.under_end))
                                  THEN 1 ELSE 0 END))::BIGINT AS taken
FROM b JOIN o ON b.source IS NOT DISTINCT FROM o.source
"""

QUALITY = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS k FROM documents),
w AS (SELECT k, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (SELECT k, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
g2 AS (SELECT k, i, count(*) OVER (PARTITION BY k, ws[i], ws[i + 1], ws[i + 2]) AS c FROM g),
r AS (SELECT k, count(DISTINCT i + j) AS n_repeat FROM g2, (SELECT unnest([0, 1, 2]) AS j) WHERE c > 1 GROUP BY k),
l0 AS (SELECT k, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d),
l1 AS (SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lw FROM l0),
l AS (SELECT *, len(lw) AS n, row_number() OVER (PARTITION BY k, line ORDER BY i) AS nth FROM l1 WHERE len(lw) > 0),
j AS (SELECT k, n, nth,
  CASE WHEN nth > 1 THEN true
  WHEN n <= 25 AND regexp_matches(line, '(?i)\b(all rights reserved|licen[sc]ed under|under the mit licen[sc]e|cookie policy|accept cookies|use of cookies|privacy policy|terms of (use|service)|sign (up|in)|log in|subscribe|newsletter|click here|read more|share this|follow us|skip to content|enable javascript|lorem ipsum|powered by)\b|© ?(19|20)[0-9][0-9]') THEN true
  WHEN n <= 2 THEN false
  WHEN 4 * len(list_filter(lw, lambda x: x IN ('|', '>', '»', '›', '•', '·'))) > n THEN true
  WHEN 3 * len(regexp_extract_all(line, '[#*$%&|<>]')) > n THEN true
  WHEN n >= 4 AND upper(line) = line AND lower(line) <> line THEN true
  WHEN n >= 8 AND (3 * len(list_filter(range(2, n + 1), lambda x: lw[x] = lw[x - 1])) > n OR (4 * len(list_distinct(lw)) < n AND n < 400)) THEN true
  WHEN n >= 8 AND NOT regexp_matches(line, '[.!?;:…。]') THEN true
  ELSE false END AS fails FROM l),
s AS (SELECT k, sum(CASE WHEN nth > 1 THEN 1 ELSE 0 END) AS n_dup, sum(CASE WHEN fails THEN n ELSE 0 END) AS lost FROM j GROUP BY k),
b AS (SELECT w.doc_id, len(ws) AS n, len(array_to_string(ws, '')) AS chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS sy,
        coalesce(s.n_dup, 0) AS du, coalesce(r.n_repeat, 0) AS re, coalesce(s.lost, 0) AS lost
      FROM w LEFT JOIN r USING (k) LEFT JOIN s USING (k))
SELECT doc_id, n::BIGINT AS n_words, chars::BIGINT AS word_chars, sy::BIGINT AS n_symbols, du::BIGINT AS n_dup_lines,
       re::BIGINT AS n_repeat_words, (n < 50 OR 100 * re > 50 * n) AS base_failed,
       NOT (n < 50 OR 100 * re > 50 * n) AND 2 * lost <= n AS kept
FROM b
"""

SUBSTRINGS = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i, ws FROM w WHERE len(ws) >= 13),
h AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS win FROM g),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS first FROM h),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM f, (SELECT unnest(range(13)) AS j) WHERE first < doc_id),
p AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
k AS (SELECT p.doc_id, p.word, p.i, gone.i IS NOT NULL AS out FROM p LEFT JOIN gone ON p.doc_id = gone.doc_id AND p.i = gone.i),
a AS (SELECT doc_id, count(*) AS n, sum(CASE WHEN out THEN 1 ELSE 0 END) AS r, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT out), '') AS kept
      FROM k GROUP BY doc_id)
SELECT w.doc_id, coalesce(a.n, 0)::BIGINT AS n_words, coalesce(a.r, 0)::BIGINT AS n_removed, sha256(coalesce(a.kept, '')) AS kept_sha256
FROM w LEFT JOIN a USING (doc_id)
"""

NGRAMS = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (
        SELECT doc_id, array_to_string(ws[i:i + 2], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM w WHERE len(ws) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= 90 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a) m USING (doc_id)
"""

EMBEDDINGS = r"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
                     WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                       AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
          WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT m.vec_id, coalesce(l.n, 0)::BIGINT AS n_links, m.c AS component_id, m.vec_id = m.c AS kept
FROM (SELECT a AS vec_id, min(b) AS c FROM reach GROUP BY a) m LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a) l USING (vec_id)
"""

RANKED = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
s AS (SELECT count(*)::HUGEINT AS n_docs, sum(len(ts))::HUGEINT AS n_terms FROM d WHERE len(ts) > 0),
t AS (SELECT row_id, doc_id, len(ts) AS n, unnest(ts) AS term FROM d WHERE len(ts) > 0),
f AS (SELECT row_id, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf FROM t GROUP BY row_id, term),
w AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs)::DOUBLE + 2) / (2 * count(*)::DOUBLE + 1)))::BIGINT AS w FROM f, s GROUP BY term),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
r AS (SELECT i.item_id, f.row_id, any_value(f.doc_id) AS doc_id,
             sum(w.w * ((1000000000 * f.tf::HUGEINT) // (1000 * f.tf + 8 * (10 + (90 * f.n * s.n_docs) // s.n_terms))))::BIGINT AS score
      FROM i JOIN f ON i.term = f.term JOIN w ON w.term = f.term, s GROUP BY i.item_id, f.row_id)
SELECT item_id, rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM r WHERE score > 0)
WHERE rank <= 10
"""
