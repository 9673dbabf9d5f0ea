"""DuckDB SQL of the resolution and upkeep queries."""

from __future__ import annotations

from cadenza.plans.views import with_views as v

_DATES = """SELECT * FROM (SELECT o_orderkey AS item, unnest([0, 1, 2]) AS source,
 unnest([CASE WHEN o_orderkey % 5 <> 0 THEN yy END, yy, CASE WHEN o_orderkey % 6 <> 0 THEN CASE WHEN o_orderkey % 10 = 0 THEN yy + 1 ELSE yy END END]) AS y,
 unnest([CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 3 <> 0 THEN mm END, CASE WHEN o_orderkey % 4 <> 0 THEN mm END, NULL]) AS m,
 unnest([CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 3 <> 0 AND o_orderkey % 2 = 0 THEN dd END, CASE WHEN o_orderkey % 4 <> 0 THEN CASE WHEN o_orderkey % 9 = 0 THEN dd % 28 + 1 ELSE dd END END, NULL]) AS d
 FROM (SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS yy, CAST(month(o_orderdate) AS INT) AS mm, CAST(day(o_orderdate) AS INT) AS dd FROM orders)) WHERE y IS NOT NULL"""
_DIFFER = "(coalesce(a.y <> b.y, false) OR coalesce(a.m <> b.m, false) OR coalesce(a.d <> b.d, false))"
_TRACKS = """SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber, l_suppkey, l_shipdate) AS "at", l_linenumber AS printed,
 CASE WHEN l_linenumber % 3 <> 0 THEN p_name END AS tag FROM lineitem JOIN part ON l_partkey = p_partkey"""

ORACLES = {
    "resolved_dates": f"""WITH r AS ({_DATES}), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY CASE WHEN d IS NOT NULL THEN 3 WHEN m IS NOT NULL THEN 2 ELSE 1 END DESC, source) AS place FROM r) WHERE place = 1),
 s AS (SELECT a.item, round(sum(CASE WHEN {_DIFFER} THEN 0.0 WHEN (a.y, a.m, a.d) IS NOT DISTINCT FROM (b.y, b.m, b.d) THEN 1.0 ELSE 0.3 END::DOUBLE), 6) AS score, CAST(sum(CAST({_DIFFER} AS INT)) AS BIGINT) AS rivals FROM b a JOIN r b ON a.item = b.item GROUP BY 1),
 c AS (SELECT a.item, bool_or({_DIFFER}) AS conflict FROM r a JOIN r b ON a.item = b.item AND a.source < b.source GROUP BY 1)
 SELECT b.item, source, y, m, d, score, rivals, coalesce(conflict, false) AS conflict FROM b JOIN s ON b.item = s.item LEFT JOIN c ON b.item = c.item""",
    "resolved_places": v(
        """SELECT p.id, CASE WHEN p.id % 4 = 0 AND venue_id IS NOT NULL THEN 'venue' WHEN p.id % 3 = 0 THEN 'tags' ELSE 'info' END AS source,
 CASE WHEN p.id % 4 = 0 AND venue_id IS NOT NULL OR p.id % 3 = 0 THEN v.city ELSE coalesce(p.city, 'Town ' || CAST(p.id % 7 AS VARCHAR)) END AS city,
 CASE WHEN p.id % 4 = 0 AND venue_id IS NOT NULL OR p.id % 3 = 0 THEN v.country END AS country FROM performance p LEFT JOIN venue v ON v.id = p.venue_id""",
        "performance", "venue",
    ),
    "show_kinds": v(
        f"""WITH r AS ({_DATES}), n AS (SELECT item, count(m) AS months, count(y) AS years FROM r GROUP BY 1)
 SELECT p.id, CASE WHEN p.id % 8 = 0 AND coalesce(months, 0) = 0 AND venue_id IS NULL THEN 'studio' WHEN coalesce(years, 0) > 0 THEN 'live' ELSE 'unknown' END AS kind FROM performance p LEFT JOIN n ON n.item = p.id""",
        "performance",
    ),
    "aligned_tracks": f"""WITH t AS ({_TRACKS}), n AS (SELECT l_orderkey, count(*) AS n FROM t GROUP BY 1),
 i AS (SELECT t.l_orderkey, "at" AS number, CASE WHEN "at" % 4 <> 0 THEN 'Song ' || "at" END AS title FROM t JOIN n ON t.l_orderkey = n.l_orderkey WHERE t.l_orderkey % 2 = 1 OR "at" < n),
 k AS (SELECT l_orderkey, count(*) AS listed FROM i GROUP BY 1)
 SELECT t.l_orderkey, CAST("at" AS INT) AS "at", coalesce(tag, title, 'Track ' || "at") AS title FROM t JOIN n ON t.l_orderkey = n.l_orderkey LEFT JOIN k ON k.l_orderkey = t.l_orderkey
 LEFT JOIN i ON i.l_orderkey = t.l_orderkey AND i.number = CASE WHEN n = listed THEN "at" ELSE coalesce(printed, "at") END""",
    "incomplete_releases": """WITH o AS (SELECT DISTINCT l_orderkey, p_brand, p_name FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey % 50 = 0),
 u AS (SELECT l_orderkey, p_brand, list(p_name) AS ours FROM o GROUP BY 1, 2),
 e AS (SELECT p_brand, CAST(p_size % 3 AS INT) AS edition, list(DISTINCT p_name) AS titles FROM part GROUP BY 1, 2),
 s AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY len(titles), edition) AS place FROM e)
 SELECT l_orderkey, u.p_brand, edition, CAST(len(titles) - len(ours) AS INT) AS missing FROM u JOIN s ON u.p_brand = s.p_brand AND place = 1 WHERE list_has_all(titles, ours) AND len(titles) > len(ours)""",
    "duplicate_shows": v(
        """WITH f AS (SELECT source, n_chars, min(doc_id) AS o FROM documents GROUP BY 1, 2), t AS (SELECT text, min(doc_id) AS o FROM documents WHERE doc_id % 3 <> 0 GROUP BY 1),
 s AS (SELECT artist_id, y, m, d, min(id) AS o FROM performance WHERE d IS NOT NULL GROUP BY ALL)
 SELECT 'folder' AS kind, doc_id AS id, o AS of FROM documents JOIN f ON documents.source = f.source AND documents.n_chars = f.n_chars WHERE doc_id <> o
 UNION ALL SELECT 'content', doc_id, o FROM documents JOIN t ON documents.text = t.text WHERE doc_id % 3 <> 0 AND doc_id <> o
 UNION ALL SELECT 'unpublished', doc_id, o FROM documents JOIN t ON documents.text = t.text WHERE doc_id % 3 = 0
 UNION ALL SELECT 'same show', p.id, o FROM performance p JOIN s ON p.artist_id = s.artist_id AND p.y = s.y AND p.m = s.m AND p.d = s.d WHERE p.id <> o""",
        "performance",
    ),
    "performance_members": v(
        """WITH s AS (SELECT * FROM performance WHERE id % 20 = 0),
 r AS (SELECT s.id, musician_id, 0 AS how FROM s JOIN membership mb ON mb.artist_id = s.artist_id WHERE s.id % 60 <> 0 AND musician_id % 3 = 0
   AND start_day <= y * 10000 + coalesce(m, 12) * 100 + coalesce(d, 31) AND end_day >= y * 10000 + coalesce(m, 1) * 100 + coalesce(d, 1)
  UNION ALL SELECT l_orderkey, l_suppkey, CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE 2 END FROM lineitem JOIN s ON s.id = l_orderkey)
 SELECT id, musician_id, (['inherited', 'added', 'guest'])[min(how) + 1] AS how FROM r GROUP BY 1, 2""",
        "performance", "membership",
    ),
    "cross_validated": """WITH r AS (SELECT CAST(event_id % 5 AS INT) AS fold, CAST(least(floor(value / 5), 20) AS INT) AS bin, event_type = 'purchase' AS pos FROM events WHERE event_type IN ('purchase', 'view')),
 g AS (SELECT f.fold, CAST(c.range AS INT) AS cut, count(*) FILTER (r.fold <> f.fold AND (r.bin >= c.range) = pos) AS inside, count(*) FILTER (r.fold = f.fold AND (r.bin >= c.range) = pos) AS held, count(*) FILTER (r.fold = f.fold) AS n
  FROM (SELECT DISTINCT fold FROM r) f, range(0, 21) c, r GROUP BY 1, 2)
 SELECT fold, cut, round(held / CAST(n AS DOUBLE), 9) AS accuracy FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY inside DESC, cut) AS place FROM g) WHERE place = 1""",
    "learned_aliases": """WITH s AS (SELECT p_brand AS brand, p_name || ' ' || p_type AS alias, count(*) AS times, bool_or(p_partkey % 10 = 0) AS known FROM part GROUP BY 1, 2)
 SELECT brand, alias, times FROM s WHERE NOT known AND alias IN (SELECT alias FROM s GROUP BY 1 HAVING count(*) <= 3)""",
    "technical_gates": """SELECT * FROM (SELECT l_orderkey, l_linenumber, round(CASE WHEN t > 0.01 THEN least(25.0::DOUBLE, 5 + 20 * least(1.0::DOUBLE, (t - 0.01) / 0.5)) ELSE 0 END + CASE WHEN -q * 2 < -60 THEN 30 ELSE 0 END
  + CASE WHEN s * 10 - 0.6 < -0.3 THEN 20 ELSE 0 END + CASE WHEN q % 7 >= 3 THEN 10 ELSE 0 END, 6) AS penalty
 FROM (SELECT l_orderkey, l_linenumber, max(l_tax) AS t, max(l_discount) AS s, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2)) WHERE penalty > 0""",
    "rescored": """SELECT * FROM (SELECT l_orderkey, l_linenumber, floor(p / 100) / 10 AS old, round(p / 1000 + s, 6) AS new FROM (SELECT l_orderkey, l_linenumber, max(l_extendedprice) AS p, max(l_discount) AS s, max(l_suppkey) % 5 AS version
 FROM lineitem GROUP BY 1, 2) WHERE version = 3) WHERE abs(new - old) >= 0.05 - 1e-9""",
    "owed_work": v(
        f"""SELECT 'quality' AS kind, doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)
 UNION ALL SELECT 'tracks', id FROM recording r WHERE location = 'library' AND id % 9 = 0 AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey * 10 + l_linenumber = r.id AND l_partkey % 5 <> 0)
 UNION ALL SELECT 'image', id FROM artist WHERE id NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')
 UNION ALL SELECT 'members', id FROM artist WHERE id NOT IN (SELECT artist_id FROM membership)
 UNION ALL SELECT 'genres', event_id FROM events WHERE event_type = 'error' AND json_extract(coalesce(props, '{{}}'), '$.genres_checked') IS NULL
 UNION ALL SELECT 'geography', id FROM performance WHERE venue_id IS NULL AND city IS NULL""",
        "recording", "artist", "membership", "performance",
    ),
    "orphans": v(
        """SELECT 'act' AS kind, id FROM artist WHERE id NOT IN (SELECT artist_id FROM performance WHERE id % 2 = 0)
 UNION ALL SELECT 'venue', id FROM venue WHERE id NOT IN (SELECT venue_id FROM performance WHERE id % 2 = 0 AND venue_id IS NOT NULL)
 UNION ALL SELECT 'show', id FROM performance WHERE id NOT IN (SELECT performance_id FROM recording WHERE location = 'library')
 UNION ALL SELECT 'musician', s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT musician_id FROM membership)
 UNION ALL SELECT 'genre', CAST(id AS BIGINT) FROM genre WHERE id NOT IN (SELECT genre_id FROM artist)""",
        "artist", "venue", "performance", "recording", "membership", "genre",
    ),
    "orphan_places": v(
        "SELECT id, name FROM venue v WHERE (SELECT count(*) FROM performance p WHERE p.venue_id = v.id AND y >= 1998) = 0 AND (SELECT count(*) FROM events WHERE user_id % 50 = v.id AND event_type = 'purchase') = 0", "venue", "performance"
    ),
    "dangling_memberships": v("SELECT artist_id, musician_id FROM membership WHERE musician_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 4 <> 0)", "membership"),
    "stale_staging": """WITH h AS (SELECT page_id, string_split(url, '/')[3] AS host FROM pages) SELECT page_id, host FROM h WHERE host NOT IN (SELECT host FROM h WHERE page_id % 3 = 0)""",
    "placeholder_venues": """SELECT s_suppkey, (['Unknown Venue', 'T.B.A.', 'N/A', NULL, 'The Venue'])[s_suppkey % 5 + 1] AS name FROM supplier WHERE s_suppkey % 5 <> 3""",
    "filled_roles": v("SELECT id, 'F' || CAST(id % 13 AS VARCHAR) AS engineer FROM recording WHERE id % 3 <> 0 AND id % 2 = 0", "recording"),
    "outdated_analyses": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id % 3 = 2)",
    "tag_inventory": "SELECT is_error, tag, count(*) AS n FROM (SELECT event_type = 'error' AS is_error, unnest(list_append(json_keys(props), event_type)) AS tag FROM events) GROUP BY 1, 2",
    "group_spread": "SELECT l_orderkey, count(*) AS n, round(stddev_samp(l_extendedprice), 4) AS spread, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY 1 HAVING count(*) >= 4",
    "roster_stints": """WITH r AS (SELECT l_suppkey AS musician_id, CAST(year(l_shipdate) AS INT) AS y, CASE WHEN l_orderkey % 3 <> 0 THEN CAST(month(l_shipdate) AS INT) END AS m, unnest(CASE WHEN l_orderkey % 2 = 0 THEN ['guitar'] ELSE ['bass', 'voice'] END) AS instrument FROM lineitem)
 SELECT musician_id, instrument, CAST(min(y * 100 + coalesce(m, 0)) // 100 AS INT) AS first_year, nullif(CAST(min(y * 100 + coalesce(m, 0)) % 100 AS INT), 0) AS first_month, count(*) AS n FROM r GROUP BY 1, 2""",
    "migrated_counts": v("SELECT kind, count(*) AS before, count(*) AS after, true AS agrees FROM recording GROUP BY 1", "recording"),
    "derived_sets": v(
        """WITH s AS (SELECT * FROM performance WHERE id IN (SELECT performance_id FROM recording WHERE location = 'library' AND kind = 'live' AND NOT is_official AND is_favorite))
 SELECT DISTINCT 'act' AS kind, artist_id AS id FROM s UNION ALL SELECT DISTINCT 'venue', venue_id FROM s WHERE venue_id IS NOT NULL
 UNION ALL SELECT DISTINCT 'musician', musician_id FROM membership WHERE artist_id IN (SELECT artist_id FROM s) UNION ALL SELECT DISTINCT 'genre', CAST(genre_id AS BIGINT) FROM artist WHERE id IN (SELECT artist_id FROM s)""",
        "performance", "recording", "membership", "artist",
    ),
    "demotable": "SELECT DISTINCT user_id FROM events WHERE event_id % 10 = 1 AND user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND event_id % 10 = 0)",
}
