"""SQL of the queries that read texts: what each way of writing must give, told by hand."""

_ORDERS = "o AS (SELECT o_orderkey, o_orderkey % 10 AS way, cast(year(o_orderdate) AS INT) AS y, cast(month(o_orderdate) AS INT) AS m, cast(day(o_orderdate) AS INT) AS d FROM orders)"
#: Whether day + 1 exists in the month of a leap year.
_NEXT = "CASE WHEN d + 1 <= day(last_day(make_date(2000, m, 1))) THEN d + 1 END"
#: Month-first reading of day.month, and of month/day where another mention writes a month by itself.
_SWAP = "d <= 12 AND d <> m"

_MENTIONS = f"""{_ORDERS}, n AS (
 SELECT o_orderkey, way, 0 AS i, y, m, d, NULL::INT AS e, NULL::INT AS om, false AS a, 'event' AS r FROM o WHERE way = 0
 UNION ALL SELECT o_orderkey, way, 0, 2019, 4, 5, NULL, NULL, false, 'handling' FROM o WHERE way = 1
 UNION ALL SELECT o_orderkey, way, 1, y, CASE WHEN d = 4 THEN 4 ELSE m END, CASE WHEN d = 4 THEN m ELSE d END, NULL, CASE WHEN d = 4 AND m <> 4 THEN m WHEN {_SWAP} THEN d END, false, NULL FROM o WHERE way = 1
 UNION ALL SELECT o_orderkey, way, 0, y, NULL, NULL, NULL, NULL, false, NULL FROM o WHERE way = 2
 UNION ALL SELECT o_orderkey, way, 1, NULL, m, d, {_NEXT}, NULL, false, NULL FROM o WHERE way = 2
 UNION ALL SELECT o_orderkey, way, 0, y, CASE WHEN {_SWAP} THEN d ELSE m END, CASE WHEN {_SWAP} THEN m ELSE d END, NULL, CASE WHEN {_SWAP} THEN m END, false, NULL FROM o WHERE way = 3
 UNION ALL SELECT o_orderkey, way, 0, y, m, d, NULL, CASE WHEN {_SWAP} THEN d END, false, NULL FROM o WHERE way = 4
 UNION ALL SELECT o_orderkey, way, 1, y, m, NULL, NULL, NULL, false, NULL FROM o WHERE way = 4
 UNION ALL SELECT o_orderkey, way, 0, NULL, m, d, NULL, NULL, false, NULL FROM o WHERE way = 5
 UNION ALL SELECT o_orderkey, way, 1, y, NULL, NULL, NULL, NULL, false, NULL FROM o WHERE way = 5
 UNION ALL SELECT o_orderkey, way, 0, y, m, NULL, NULL, NULL, false, NULL FROM o WHERE way = 6
 UNION ALL SELECT o_orderkey, way, 0, y, m, NULL, NULL, NULL, true, NULL FROM o WHERE way = 7
 UNION ALL SELECT o_orderkey, way, 0, y, m, d, NULL, NULL, false, NULL FROM o WHERE way = 8
 UNION ALL SELECT o_orderkey, way, 0, y, CASE WHEN d = 2 THEN 2 ELSE m END, CASE WHEN d = 2 THEN m ELSE d END, NULL, CASE WHEN d = 2 AND m <> 2 THEN m WHEN {_SWAP} THEN d END, false, NULL FROM o WHERE way = 9
 UNION ALL SELECT o_orderkey, way, 1, 1999, 2, 23, NULL, NULL, false, 'handling' FROM o WHERE way = 9)"""

_SHOWS = """t AS (
 SELECT o_orderkey AS id, regexp_replace(a.c_name, '[^A-Za-z0-9]', ' ', 'g') AS act, CASE WHEN o_orderkey % 4 = 0 THEN regexp_replace(g.c_name, '[^A-Za-z0-9]', ' ', 'g') END AS guest,
 regexp_replace(s_name, '[^A-Za-z0-9]', ' ', 'g') AS hall, 'City ' || (s_suppkey % 17) AS city, n_name AS state, strftime(o_orderdate, '%B %-d, %Y') AS day
 FROM orders JOIN customer a ON a.c_custkey = o_custkey LEFT JOIN customer g ON g.c_custkey = o_custkey % 7 + 1
 JOIN supplier ON s_suppkey = o_orderkey % 7 + 1 JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey)"""
#: The units of each show's text, in order, with their roles told by hand.
_UNITS = f"""{_SHOWS}, u AS (
 SELECT id, 0 AS line, 0 AS pos, act AS text, 'ARTIST' AS role, 'seg' AS kind, 0 AS block, guest IS NOT NULL AS before_connector FROM t
 UNION ALL SELECT id, 0, 1, 'with', 'CONNECTOR', 'seg', 0, false FROM t WHERE guest IS NOT NULL
 UNION ALL SELECT id, 0, 2, guest, 'MEMBER', 'seg', 0, false FROM t WHERE guest IS NOT NULL
 UNION ALL SELECT id, 1, 0, hall, 'VENUE', 'seg', 0, false FROM t
 UNION ALL SELECT id, 1, 1, city, 'PLACE', 'seg', 0, false FROM t
 UNION ALL SELECT id, 1, 2, state, 'PLACE', 'seg', 0, false FROM t
 UNION ALL SELECT id, 2, 0, 'seeded', 'OTHER', 'seg', 0, false FROM t WHERE id % 3 = 0
 UNION ALL SELECT id, 2, (id % 3 = 0)::INT, day, 'DATE', 'date', 0, false FROM t
 UNION ALL SELECT id, 3, 0, 'SBD > DAT > FLAC', 'SOURCE', 'seg', 1, false FROM t
 UNION ALL SELECT id, 4, 0, '01 opening song', 'TRACK', 'track', 2, false FROM t
 UNION ALL SELECT id, 5, 0, '02. Second song', 'TRACK', 'track', 2, false FROM t
 UNION ALL SELECT id, 6, 0, 'Thanks to the taper who kept all of these for so long', 'OTHER', 'seg', 3, false FROM t WHERE id % 5 = 0)"""
_WORDS = "len(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '))"
_CAPS = "kind = 'seg' AND regexp_matches(text, '[A-Za-z]') AND text = upper(text)"
_FEATURES = {
    "line0": "line = 0", "line1": "line = 1", "line2_3": "line IN (2, 3)", "line4_8": "line BETWEEN 4 AND 8", "block_later": "block > 0",
    "first_in_line": "pos = 0", "after_first": "pos > 0", "date_nonshow": "kind = 'date' AND id % 3 = 0", "date_show": "kind = 'date' AND id % 3 <> 0",
    "numbered_track": "kind = 'track'", "w1": f"kind = 'seg' AND {_WORDS} = 1", "w2_4": f"kind = 'seg' AND {_WORDS} BETWEEN 2 AND 4", "w8p": f"kind = 'seg' AND {_WORDS} > 7",
    "all_caps": _CAPS, "all_lower": "kind = 'seg' AND text IN ('with', 'seeded')", "starts_lower": "kind = 'seg' AND text IN ('with', 'seeded')",
    "title_case": "kind = 'seg' AND text NOT IN ('with', 'seeded') AND text NOT LIKE 'Thanks%' AND text <> upper(text)",
    "has_digit": "kind = 'seg' AND regexp_matches(text, '[0-9]')", "has_gt": "kind = 'seg' AND text LIKE '%>%'", "source_kw": "role = 'SOURCE'", "label_source": "role = 'SOURCE'",
    "connector_word": "text = 'with'", "next_is_connector": "before_connector", "prev_is_connector": "role = 'MEMBER'",
    "prev_line_date": "line = 3", "lib_artist": "role IN ('ARTIST', 'MEMBER')", "lib_venue": "role = 'VENUE'",
}

_CAP = "array_to_string(list_transform(string_split({0}, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"

ORACLES = {
    "folder_names": """WITH r AS (SELECT o_orderkey, upper(replace(lower(c_name), '#', ' ')[1]) || replace(lower(c_name), '#', ' ')[2:] AS artist, year(o_orderdate)::VARCHAR AS year,
 CASE WHEN o_orderkey % 7 > 0 THEN strftime(o_orderdate, '%m') END AS month, CASE WHEN o_orderkey % 7 > 0 AND o_orderkey % 5 > 0 THEN strftime(o_orderdate, '%d') END AS day,
 CASE WHEN o_orderkey % 3 = 0 THEN 'City ' || c_nationkey END AS city, CASE WHEN o_orderkey % 2 = 0 THEN 'sbd' END AS source FROM orders JOIN customer ON o_custkey = c_custkey)
 SELECT o_orderkey, artist || ' ' || year || coalesce('-' || month, '') || coalesce('-' || day, '') || coalesce(' (' || city || ')', '') || coalesce(' ' || source, '') AS name, artist, year, month, day, city, source FROM r""",
    "vector_signals": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: coalesce(x::DOUBLE, 0)) AS x FROM embeddings), s AS (SELECT vec_id, x, len(x) AS n,
 greatest(10 * log10(greatest(list_avg(list_transform(x, lambda a: a * a)), 1e-20)), -140) AS rms, greatest(10 * log10(greatest(list_max(list_transform(x, lambda a: a * a)), 1e-20)), -140) AS peak FROM v)
 SELECT vec_id, n, round(rms, 6) AS rms_db, round(peak, 6) AS peak_db, round(peak - rms, 6) AS crest_db, round(len(list_filter(x, lambda a: abs(a) >= 0.999)) / n, 6) AS clipped_share, round(list_avg(x), 6) AS dc_offset,
 len(list_filter(range(2, n + 1), lambda i: (x[i] < 0) <> (x[i - 1] < 0)))::DOUBLE AS zero_crossings,
 len(list_filter(range(1, n - 1), lambda i: abs(x[i]) >= 0.999 AND abs(x[i + 1]) >= 0.999 AND abs(x[i + 2]) >= 0.999 AND (i = 1 OR abs(x[i - 1]) < 0.999)))::DOUBLE AS n_clips FROM s""",
    "play_sessions": """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
 g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e)
 SELECT user_id, min(ts) AS start, max(ts) AS "end", count(*) AS n FROM g GROUP BY user_id, s""",
    "returned_offers": """WITH e AS (SELECT user_id, ts, event_type, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM events WHERE event_type IN ('view', 'purchase'))
 SELECT user_id, ts + INTERVAL 1 HOUR AS due FROM e WHERE event_type = 'view' AND (after IS NULL OR after >= ts + INTERVAL 1 HOUR)""",
    # tags and texts are alike where they are equal or differ in one letter
    "corroboration": """WITH t AS (SELECT o_orderkey, o_orderkey AS k FROM orders), s AS (SELECT o_orderkey,
 least(1, CASE WHEN k % 2 = 0 THEN 0.7 WHEN k % 3 < 2 THEN 0.55 ELSE 0 END + CASE WHEN k % 2 = 0 OR k % 3 = 0 THEN 0.2 ELSE 0 END + CASE WHEN k % 2 = 0 AND k % 3 = 0 THEN 0.1 ELSE 0 END)::DOUBLE AS artist,
 least(1, CASE WHEN k % 5 > 0 THEN 0.7 WHEN k % 4 = 0 THEN 0.55 ELSE 0 END + CASE WHEN k % 5 > 0 OR k % 4 = 0 THEN 0.2 ELSE 0 END + CASE WHEN k % 5 > 0 AND k % 4 = 0 THEN 0.1 ELSE 0 END)::DOUBLE AS venue,
 CASE WHEN k % 5 > 1 THEN 0.7 ELSE 0.55 END + CASE WHEN (k % 5 > 0 OR k % 4 = 0) AND (k % 5 > 1 OR k % 2 = 0) THEN 0.2 ELSE 0 END + CASE WHEN k % 5 > 1 AND k % 2 = 0 THEN 0.1 ELSE 0 END AS city,
 CASE WHEN k % 5 > 0 OR k % 4 = 0 THEN 0.75 ELSE 0.55 END AS state,
 CASE WHEN k % 6 = 0 THEN CASE WHEN k % 5 > 0 OR k % 4 = 0 THEN 0.9 ELSE 0.7 END ELSE 0 END AS country,
 least(1, round(CASE WHEN k % 4 = 0 THEN 0.7 / 3 WHEN k % 4 = 1 THEN 1.4 / 3 ELSE 0.7 END + CASE WHEN k % 4 > 1 AND k % 3 = 0 THEN 0.3 ELSE 0 END, 2))::DOUBLE AS date FROM t)
 SELECT o_orderkey, round(artist, 2) AS artist, round(venue, 2) AS venue, round(city::DOUBLE, 2) AS city, state::DOUBLE AS state, country::DOUBLE AS country, date,
 cast(round_even(round(28 * artist + 20 * venue + 12 * city + 8 * state + 5 * country + 27 * date, 6), 0) AS INT) AS score FROM s""",
    "track_corroboration": """WITH r AS (SELECT l_orderkey, l_partkey % 5 AS n FROM lineitem JOIN part ON p_partkey = l_partkey)
 SELECT l_orderkey, count(*) FILTER (n = 0) AS confirmed, count(*) FILTER (n > 2) AS tag_only, count(*) FILTER (n = 2) AS text_only, count(*) FILTER (n = 1) AS conflict, 0::BIGINT AS missing,
 cast(round_even(round(100 * sum([1.0, 0.55, 0.6, 0.75, 0.75][n + 1]) / count(*), 6), 0) AS INT) AS score FROM r GROUP BY l_orderkey""",
    "catalogue_shows": """SELECT o_custkey, 'Act ' || o_custkey AS act, CASE WHEN o_custkey % 3 = 0 THEN '/AppData/x' || o_custkey || '/' END AS act_link,
 CASE WHEN o_orderkey % 5 = 0 THEN strftime(o_orderdate, '%m-??-%y') ELSE strftime(o_orderdate, '%m-%d-%Y') END AS date, cast(month(o_orderdate) AS INT) AS month,
 CASE WHEN o_orderkey % 5 <> 0 THEN cast(day(o_orderdate) AS INT) END AS day, cast(CASE WHEN o_orderkey % 5 = 0 THEN year(o_orderdate) % 100 ELSE year(o_orderdate) END AS INT) AS year,
 CASE WHEN o_orderkey % 4 <> 0 THEN '/shows/' || o_orderkey || CASE WHEN o_orderkey % 4 = 1 THEN '.htm' ELSE '/' END END AS link,
 'Hall & Barn ' || o_orderkey AS venue, o_orderpriority AS source, ['unlinked', 'page', 'folder', 'folder'][o_orderkey % 4 + 1] AS kind FROM orders""",
    "linked_text": """SELECT page_id, len(regexp_extract_all(coalesce(html, ''), '(?i)<a href=')) AS n_links, len(regexp_extract_all(coalesce(html, ''), '(?i)<tr[ >]')) AS n_rows FROM pages""",
    "peeled_places": f"""WITH t AS (SELECT o_orderkey, o_orderkey % 7 AS way, {_CAP.format("array_to_string(string_split(p_name, ' ')[1:2], ' ')")} AS town, {_CAP.format("n_name")} AS land
 FROM orders JOIN supplier ON s_suppkey = o_orderkey % 7 + 1 JOIN part ON p_partkey = s_suppkey JOIN nation ON n_nationkey = s_nationkey)
 SELECT o_orderkey, CASE way WHEN 3 THEN 'Nowhere' ELSE town END AS city, NULL::VARCHAR AS region, CASE WHEN way <> 5 THEN land END AS country,
 ['Old Hall', '', '', 'Blue Room', 'Long Wharf', 'Royal Hall'][way + 1] AS left, ['Old Hall', 'The Barn', 'Stars', 'Blue Room', 'Long Wharf', 'Royal Hall'][way + 1] AS venue,
 CASE way WHEN 3 THEN 'medium' WHEN 5 THEN 'low' ELSE 'high' END AS confidence FROM t WHERE way <> 6""",
    "feature_counts": f"WITH {_UNITS} SELECT * FROM ("
    + " UNION ALL ".join(f"SELECT '{f}' AS feature, count(*) AS n_units, count(DISTINCT id) AS n_texts FROM u WHERE {c}" for f, c in _FEATURES.items())
    + ") WHERE n_units > 0",
    "decoded_roles": f"WITH {_UNITS} SELECT id, line, pos, text, role FROM u",
    "mentioned_dates": f"WITH {_MENTIONS} SELECT o_orderkey, i, y AS year, m AS month, d AS day, e AS end_day, om AS other_month, a AS ambiguous, r AS role FROM n",
    # of two mentions in ways 2, 4 and 5 the more precise leads, and the other gives its year
    "event_dates": f"""WITH {_MENTIONS}, u AS (SELECT * FROM n WHERE r IS DISTINCT FROM 'handling')
 SELECT o_orderkey, max(y) AS year, max(m) AS month, max(d) AS day, max(e) AS end_day, bool_or(a) AS ambiguous FROM u GROUP BY o_orderkey""",
}
