"""DuckDB SQL for the queries of ranking and matching."""

from __future__ import annotations

from cadenza.operators.ranking import MARGINS, MOST_WRONG, STATUSES, TAUS
from cadenza.plans.views import with_views as v

_GRID = ", ".join(f"({t}, {m})" for t in TAUS for m in MARGINS)

ORACLES = {
    "round_robin": v(
        """SELECT r.id, artist_id, CAST(row_number() OVER (PARTITION BY artist_id ORDER BY sha1('2024-01-01:0|' || CAST(r.id AS VARCHAR)), r.id) AS INT) AS round
 FROM recording r JOIN performance p ON r.performance_id = p.id WHERE location = 'library'""",
        "recording", "performance",
    ),
    "lead_first": v(
        """SELECT p.id, CASE WHEN p.id = lead THEN 0 ELSE 1 END AS lane FROM performance p LEFT JOIN
 (SELECT artist_id, min(id) AS lead FROM performance WHERE artist_id NOT IN (SELECT artist_id FROM membership) GROUP BY 1) l ON p.artist_id = l.artist_id""",
        "performance", "membership",
    ),
    "queue_order": "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS queue, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INT) AS place FROM orders",
    "collision_names": """SELECT p_partkey, CASE WHEN place = 1 THEN p_name ELSE p_name || ' (' || place || ')' END AS name
 FROM (SELECT *, row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey) AS place FROM part)""",
    "natural_keys": """SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' ' || p_size), '([0-9]+)', '00000000\\1', 'g'), '[0-9]*([0-9]{8})', '\\1', 'g') AS sort_key FROM part""",
    "release_choice": """WITH g AS (SELECT o_custkey, o_orderpriority, max(o_totalprice) AS score FROM orders GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, o_orderpriority) AS place FROM g),
 e AS (SELECT o_custkey, o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS place FROM orders)
 SELECT a.o_custkey, a.o_orderpriority AS grp, e.o_orderkey AS edition, a.score >= 200000 AND a.score - coalesce(b.score, 0) >= 10000 AS accepted
 FROM r a JOIN e ON a.o_custkey = e.o_custkey AND a.o_orderpriority = e.o_orderpriority AND e.place = 1 AND a.place = 1 LEFT JOIN r b ON a.o_custkey = b.o_custkey AND b.place = 2""",
    "date_spans": v(
        """SELECT venue_id, CAST(a // 10000 AS INT) AS first_y, CAST(a // 100 % 100 AS INT) AS first_m, CAST(a % 100 AS INT) AS first_d,
 CAST(b // 10000 AS INT) AS last_y, CAST(b // 100 % 100 AS INT) AS last_m, CAST(b % 100 AS INT) AS last_d FROM (
 SELECT venue_id, min(y * 10000 + coalesce(m, 0) * 100 + coalesce(d, 0)) AS a, max(y * 10000 + coalesce(m, 0) * 100 + coalesce(d, 0)) AS b FROM performance WHERE venue_id IS NOT NULL GROUP BY 1)""",
        "performance",
    ),
    "status_buckets": f"SELECT status, count(o_orderkey) AS n FROM (VALUES {', '.join(f'({s!r})' for s in STATUSES)}) s(status) LEFT JOIN orders ON o_orderstatus = status GROUP BY 1",
    "grid_search": f"""SELECT n, tau, margin FROM (SELECT tau, margin, count(*) AS n, count(*) FILTER (event_type = 'error') AS wrong FROM events, (VALUES {_GRID}) g(tau, margin)
 WHERE value >= tau AND event_id % 20 >= margin GROUP BY 1, 2) WHERE wrong <= {MOST_WRONG} * n ORDER BY n DESC, tau DESC, margin DESC LIMIT 1""",
    "next_places": "SELECT l_orderkey, max(l_linenumber) + 1 AS next_line FROM lineitem GROUP BY 1",
    "equal_sets": """SELECT lines, count(*) AS n_shows, min(l_orderkey) AS first_show FROM (
 SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_linenumber)), ',') AS lines FROM lineitem GROUP BY 1) GROUP BY 1""",
    "dated_names": v(
        """WITH names AS (SELECT id AS artist_id, 0 AS rank, name, 0 AS s, 9999 AS e FROM artist WHERE id % 3 <> 0
 UNION ALL SELECT id, 1, upper(name), 0, 1994 FROM artist UNION ALL SELECT id, 2, sort_name, 1995, 9999 FROM artist WHERE sort_name IS NOT NULL)
 SELECT id, arg_min(name, rank) AS name FROM performance p JOIN names n ON p.artist_id = n.artist_id AND y BETWEEN s AND e GROUP BY id""",
        "artist", "performance",
    ),
    "shows_covering": v("SELECT id, artist_id FROM performance WHERE y * 10000 + coalesce(m, 1) * 100 + coalesce(d, 1) <= 19970514 AND y * 10000 + coalesce(m, 12) * 100 + coalesce(d, 31) >= 19970514", "performance"),
    "unique_date_matches": v("SELECT venue_id, y, m, d, min(id) AS id FROM performance WHERE venue_id IS NOT NULL AND m IS NOT NULL AND d IS NOT NULL GROUP BY ALL HAVING count(*) = 1", "performance"),
    "tiered_match": """WITH a AS (SELECT s_suppkey, c_custkey, 1 AS tier FROM supplier JOIN customer ON s_suppkey = c_custkey WHERE s_suppkey % 2 = 0)
 SELECT * FROM a UNION ALL SELECT s_suppkey, min(c_custkey), 2 FROM supplier JOIN customer ON s_nationkey = c_nationkey WHERE s_suppkey NOT IN (SELECT s_suppkey FROM a) GROUP BY s_suppkey""",
    "title_overlap": """SELECT * FROM (SELECT p_partkey, len(list_intersect(a, b)) / CAST(least(len(a), len(b)) AS DOUBLE) AS overlap FROM (
 SELECT p_partkey, list_distinct(string_split(lower(p_name), ' ')) AS a, list_distinct(string_split(lower(p_type), ' ')) AS b FROM part)) WHERE overlap >= 0.5""",
    "engineer_roles": "SELECT engineer, count(*) AS n FROM (SELECT unnest(list_distinct([o_custkey % 50, o_orderkey % 50, (o_custkey + o_orderkey) % 50])) AS engineer FROM orders) GROUP BY 1",
    "only_users": v("SELECT musician_id, min(artist_id) AS artist_id FROM membership GROUP BY 1 HAVING count(DISTINCT artist_id) = 1", "membership"),
    "run_changes": "SELECT a.event_id, a.event_type AS before, b.event_type AS after FROM events a JOIN events b ON a.event_id = b.event_id - 1 WHERE a.event_type <> b.event_type",
    "field_report": """SELECT field, n, "right", "right" / CAST(nullif("right" + wrong, 0) AS DOUBLE) AS precision, "right" / CAST(n AS DOUBLE) AS recall, wrong / CAST(n AS DOUBLE) AS wrong_rate FROM (
 SELECT event_type AS field, count(*) AS n, count(*) FILTER (value < 20) AS "right", count(*) FILTER (value >= 20 AND value < 40) AS wrong FROM events GROUP BY 1)""",
    "verdict_reasons": v(
        """SELECT id, concat_ws(',', CASE WHEN source = 'AUD' THEN 'audience' END, CASE WHEN location <> 'library' THEN 'unpublished' END,
 CASE WHEN quality = 'C' THEN 'low quality' END, CASE WHEN kind = 'studio' THEN 'studio' END) AS reasons FROM recording""",
        "recording",
    ),
    "shelf_pool": v("SELECT id, performance_id FROM recording WHERE location = 'library' AND kind = 'live' AND (quality = 'A' OR upper(trim(source)) IN ('SBD') OR is_favorite OR performance_id % 4 = 0)", "recording"),
}
