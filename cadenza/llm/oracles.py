"""DuckDB SQL of the training-data queries that SQL can express whole."""

_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: All pairs of texts that share a shingle, counted; components by reachability.
OP2_SQL = f"""
WITH RECURSIVE texts AS (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS.format(text=_LOWER)} AS w FROM documents
), grams AS (
  SELECT DISTINCT r, array_to_string(w[p : p + 3], ' ') AS s
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS p FROM texts WHERE len(w) > 0)
), sizes AS (
  SELECT r, count(*) AS n FROM grams GROUP BY r
), common AS (
  SELECT a.r AS x, b.r AS y, count(*) AS c FROM grams a JOIN grams b ON a.s = b.s AND a.r < b.r GROUP BY a.r, b.r
), links AS (
  SELECT x, y FROM common JOIN sizes m ON m.r = x JOIN sizes n ON n.r = y WHERE 100 * c >= 85 * (m.n + n.n - c)
), ways AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach(r, other) AS (
  SELECT r, r FROM texts UNION SELECT reach.r, ways.y FROM reach JOIN ways ON ways.x = reach.other
), least AS (
  SELECT reach.r, min(t.doc_id) AS component_id FROM reach JOIN texts t ON t.r = reach.other GROUP BY reach.r
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM texts JOIN least USING (r) LEFT JOIN sizes USING (r)
"""

#: Every window of 50 words with the smallest document it starts in.
OP6_SQL = f"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents
), windows AS (
  SELECT r, doc_id, p, array_to_string(w[p : p + 49], ' ') AS s
  FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM texts WHERE len(w) >= 50)
), firsts AS (
  SELECT s, min(doc_id) AS first FROM windows GROUP BY s HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT r, unnest(range(p, p + 50)) AS p FROM windows JOIN firsts USING (s) WHERE first < doc_id
), spread AS (
  SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM texts
), kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM spread ANTI JOIN gone USING (r, p) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (r)
"""
