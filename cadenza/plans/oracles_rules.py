"""DuckDB SQL of the predicate, order, aggregate and normaliser queries."""

from __future__ import annotations

from cadenza.operators.resolution import NOISE_WORDS
from cadenza.plans.views import with_views as v


def fold(x: str) -> str:
    return f"strip_accents(lower({x}))"


def spaced(x: str) -> str:
    return f"trim(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def name_key(x: str) -> str:
    return "regexp_replace(" + spaced(f"replace({fold(x)}, '&', ' and ')") + ", '^the ', '')"


def title_key(x: str) -> str:
    return spaced(f"regexp_replace({fold(x)}, '(\\s*[(\\[][^)\\]]*[)\\]])+\\s*$', '')")


_OPENING = "'The ' || coalesce(substr(text, 1, 60), '') || ' & Band (Live)'"
_EVENT = "CAST(p_partkey % 20 AS VARCHAR) || 'th Annual ' || p_name || CASE WHEN p_partkey % 2 = 0 THEN ' Fest ' ELSE ' Festival ' END || CAST(1980 + p_partkey % 30 AS VARCHAR)"
_EVENT_KEY = f"regexp_replace(regexp_replace(regexp_replace({fold(_EVENT)}, '\\b[0-9]+(st|nd|rd|th)\\b|\\b(19|20)[0-9][0-9]\\b', ' ', 'g'), 'fest\\b', 'festival', 'g'), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"
_TITLED = "SELECT p_partkey, p_name || (['', ' (Live)', ' [Encore]', ' (Cut) [Fades Out]', ' (Remix)'])[p_partkey % 5 + 1] AS title FROM part"
_FLAGS = "list_filter(['live', 'encore', 'cut', 'fades in', 'fades out'], lambda f: list_contains(list_transform(regexp_extract_all(lower(title), '[(\\[]([^)\\]]*)[)\\]]', 1), lambda s: trim(s)), f))"
_NOISE = ", ".join(f"'{w}'" for w in NOISE_WORDS)

ORACLES = {
    "hourly_plays": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2",
    "name_contains": "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%red%'",
    "begins_in": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS begin_date FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') LIKE '1997-%'",
    "listed_statuses": "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority NOT IN ('1-URGENT', '5-LOW')",
    "bounded_arguments": """SELECT page_id, raw, CAST(least(greatest(coalesce(CASE WHEN regexp_full_match(raw, '[+-]?[0-9]{1,9}') THEN TRY_CAST(raw AS INT) END, 1), 1), 50) AS INT) AS page
 FROM (SELECT page_id, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS raw FROM pages)""",
    "whole_word": "SELECT p_partkey, p_name FROM part WHERE list_contains(string_split(lower(p_name), ' '), 'red')",
    "archive_lookup": v(
        """SELECT p.id, lower(c_name) AS act, i.n_items FROM performance p JOIN customer ON p.artist_id = c_custkey JOIN (SELECT lower(c_name) AS act, year(l_shipdate) AS y, month(l_shipdate) AS m, day(l_shipdate) AS d, count(*) AS n_items
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL) i ON lower(c_name) = i.act AND p.y = i.y AND p.m = i.m AND p.d = i.d""",
        "performance",
    ),
    "paged_recordings": v("SELECT id, source, created_at FROM recording ORDER BY created_at DESC NULLS LAST, id DESC LIMIT 100 OFFSET 20", "recording"),
    "skipped_last": "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders ORDER BY CASE o_orderstatus WHEN 'P' THEN 1 ELSE 0 END, o_orderpriority, o_orderkey LIMIT 100",
    "quality_sorted": v(
        """SELECT r.id, r.id % 5 AS score, CASE quality WHEN 'A' THEN 2 WHEN 'B' THEN 1 END AS grade, y, m, d FROM recording r JOIN performance p ON r.performance_id = p.id
 ORDER BY score DESC, coalesce(grade, -1) DESC, coalesce(y, 0) DESC, coalesce(m, 0) DESC, coalesce(d, 0) DESC, r.id LIMIT 100""",
        "recording", "performance",
    ),
    "errors_last": "SELECT event_id, CASE WHEN event_type <> 'error' THEN value END AS score FROM events WHERE event_id % 7 = 0 ORDER BY score DESC NULLS LAST, event_id LIMIT 100",
    "article_sorted": """SELECT p_partkey, name, CASE WHEN starts_with(lower(name), 'the ') THEN substr(lower(name), 5) ELSE lower(name) END AS sort_key
 FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'The ' || p_name ELSE p_name END AS name FROM part) ORDER BY sort_key, p_partkey LIMIT 50""",
    "top_candidates": "SELECT p_brand, p_partkey, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_retailprice DESC, p_name, p_partkey) AS place FROM part) WHERE place <= 5",
    "run_rollup": """WITH r AS (SELECT user_id, CAST(ts AS DATE) AS run, count(*) AS n, count(*) FILTER (event_type = 'error') AS waiting FROM events GROUP BY 1, 2),
 l AS (SELECT user_id, max(run) AS run FROM r GROUP BY 1), t AS (SELECT user_id, CAST(sum(n) AS BIGINT) AS n_items, count(*) AS n_runs FROM r GROUP BY 1)
 SELECT t.user_id, n_items, n_runs, waiting FROM t JOIN l ON t.user_id = l.user_id JOIN r ON r.user_id = l.user_id AND r.run = l.run""",
    "waiting_paths": """SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, count(DISTINCT regexp_replace(regexp_replace(url, '[?#].*$', ''), '/[^/]*$', '')) AS n_folders FROM pages GROUP BY 1""",
    "first_run": "SELECT min(ts) AS first_ts FROM events",
    "window_features": """WITH f AS (SELECT l_orderkey, l_returnflag AS usual_flag, row_number() OVER (PARTITION BY l_orderkey ORDER BY count(*) DESC, l_returnflag) AS place FROM lineitem GROUP BY 1, 2),
 p AS (SELECT l_orderkey, l_partkey AS first_part, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS place FROM lineitem),
 q AS (SELECT l_orderkey, quantile_cont(l_quantity, 0.5) AS median, quantile_cont(l_quantity, 0.25) AS p25, max(l_tax) AS most_tax, bool_or(l_discount > 0.08) AS any_discount FROM lineitem GROUP BY 1)
 SELECT q.*, usual_flag, first_part FROM q JOIN f ON q.l_orderkey = f.l_orderkey AND f.place = 1 JOIN p ON p.l_orderkey = q.l_orderkey AND p.place = 1""",
    "weighted_means": """WITH u AS (SELECT l_orderkey, l_linenumber, row_number() OVER () AS r, unnest([l_quantity, CASE WHEN l_linenumber % 3 <> 0 THEN l_tax * 1000 END, CASE WHEN l_linenumber % 2 = 0 THEN l_discount * 1000 END]) AS x, unnest([0.5::DOUBLE, 0.3::DOUBLE, 0.2::DOUBLE]) AS w FROM lineitem),
 m AS (SELECT l_orderkey, l_linenumber, r, round(exp(sum(w * ln(greatest(x, 1.0))) / sum(w)), 6) AS g, round(sum(w * x) / sum(w), 6) AS a FROM u WHERE x IS NOT NULL GROUP BY 1, 2, 3)
 SELECT l_orderkey, l_linenumber, max(g) AS geometric, max(a) AS arithmetic FROM m GROUP BY 1, 2""",
    "balanced_folds": """WITH RECURSIVE n AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY n DESC, c_nationkey) AS i FROM n),
 s AS (SELECT 0::BIGINT AS i, 0::BIGINT AS a, 0::BIGINT AS b, 0::BIGINT AS c, NULL::BIGINT AS c_nationkey, NULL::BIGINT AS n, NULL::INT AS fold
  UNION ALL SELECT o.i, CASE WHEN f = 0 THEN a + o.n ELSE a END, CASE WHEN f = 1 THEN b + o.n ELSE b END, CASE WHEN f = 2 THEN c + o.n ELSE c END, o.c_nationkey, o.n, f
  FROM (SELECT *, CASE WHEN a <= b AND a <= c THEN 0 WHEN b <= c THEN 1 ELSE 2 END AS f FROM s) t JOIN o ON o.i = t.i + 1)
 SELECT CAST(c_nationkey AS INT) AS c_nationkey, n, fold FROM s WHERE i > 0""",
    "cooled_down": "SELECT user_id, max(ts) AS last FROM events WHERE event_type = 'error' GROUP BY 1 HAVING max(ts) <= (SELECT max(ts) FROM events) - INTERVAL 86400 SECONDS",
    "resumable_work": """SELECT * FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'begun' ELSE 'new' END AS state, CAST(o_orderkey % 4 AS INT) AS attempts,
 CASE o_orderstatus WHEN 'P' THEN 0 ELSE 1 END AS rank FROM orders) WHERE state <> 'done' AND attempts < 3""",
    "access_recency": "SELECT user_id, max(ts) AS last, max(ts) >= (SELECT max(ts) FROM events) - INTERVAL 7 DAYS AS recent FROM events GROUP BY 1",
    "run_duplicates": """SELECT d.source, d.doc_id, f.first_id FROM documents d JOIN (SELECT source, text, min(doc_id) AS first_id FROM documents GROUP BY 1, 2) f
 ON d.source = f.source AND d.text = f.text WHERE d.doc_id <> f.first_id""",
    "allowed_attempts": """WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE event_type = 'error'),
 s AS (SELECT user_id, event_id, i, [ts] AS kept, true AS ok FROM e WHERE i = 1
  UNION ALL SELECT e.user_id, e.event_id, e.i, CASE WHEN len(list_filter(kept, lambda t: t > e.ts - INTERVAL 3600 SECONDS)) < 3 THEN list_append(kept, e.ts) ELSE kept END,
   len(list_filter(kept, lambda t: t > e.ts - INTERVAL 3600 SECONDS)) < 3 FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1)
 SELECT user_id, event_id FROM s WHERE ok""",
    "normal_names": f"""SELECT doc_id, {spaced("regexp_replace(" + fold("name") + ", '[''’]', '', 'g')")} AS search_key, {name_key("name")} AS name_key, replace({name_key("name")}, ' ', '') AS person_key, {title_key("name")} AS title_key
 FROM (SELECT doc_id, {_OPENING} AS name FROM documents)""",
    "act_cores": f"""SELECT p_partkey, array_to_string(CASE WHEN len(list_filter(w, lambda x: x NOT IN ({_NOISE}))) > 0 THEN list_filter(w, lambda x: x NOT IN ({_NOISE})) ELSE w END, ' ') AS core
 FROM (SELECT p_partkey, string_split('the ' || lower(p_name) || CASE WHEN p_partkey % 2 = 0 THEN ' trio' ELSE ' band' END, ' ') AS w FROM part)""",
    "event_keys": f"SELECT {_EVENT_KEY} AS event_key, count(*) AS n, min(p_partkey) AS first_id FROM part GROUP BY 1",
    "path_keys": "SELECT page_id, lower(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '/+', '/', 'g')) AS path_key FROM pages",
    "track_flags": f"""WITH t AS ({_TITLED}) SELECT p_partkey, {title_key("title")} AS title_key, array_to_string({_FLAGS}, ',') AS flags FROM t WHERE len({_FLAGS}) > 0""",
    "retired_flags": f"""WITH t AS ({_TITLED}), f AS (SELECT p_partkey, {_FLAGS} AS flags FROM t) SELECT p_partkey, array_to_string(list_filter(flags, lambda f: f <> 'cut'), ',') AS flags FROM f WHERE list_contains(flags, 'cut')""",
    "canonical_places": """SELECT CASE WHEN raw IN ('UNITED STATES', 'UNITED STATES OF AMERICA', 'U.S.A.') THEN 'USA' WHEN raw IN ('UNITED KINGDOM', 'ENGLAND') THEN 'UK' ELSE raw END AS country, count(*) AS n_venues
 FROM (SELECT upper((['United States', 'U.S.A.', 'England', n_name])[s_suppkey % 4 + 1]) AS raw FROM supplier JOIN nation ON s_nationkey = n_nationkey) GROUP BY 1""",
    "sort_names": """SELECT p_partkey, CASE WHEN len(w) > 1 THEN w[-1] || ', ' || array_to_string(w[:-2], ' ') END AS sort_name
 FROM (SELECT p_partkey, list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])) AS w FROM part)""",
    "lucene_queries": """SELECT p_partkey, replace(p_name, ' ', ' AND ') || CASE WHEN p_partkey % 3 = 0 THEN ' AND date:[' || (1970 + p_partkey % 40) || '-01-01 TO ' || (1970 + p_partkey % 40) || '-12-31]' ELSE '' END AS query FROM part""",
    "archive_items": """SELECT 'show-' || o_orderkey AS identifier, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS title, strftime(o_orderdate, '%Y-%m-%d') AS date, o_custkey AS downloads FROM orders""",
    # the outcome of each way of writing, told by hand
    "rights_rules": """WITH o AS (SELECT o_orderkey, o_orderkey % 8 AS way, CAST(o_orderdate AS DATE) AS d FROM orders),
 found AS (SELECT o_orderkey, unnest(CASE way
 WHEN 1 THEN [strftime(d, '%Y-%m-%d')] WHEN 2 THEN [strftime(d, '%Y-%m-%d')] WHEN 6 THEN [strftime(d, '%Y-%m-%d')]
 WHEN 7 THEN list_distinct([strftime(d, '%Y-01-01'), strftime(d, '%Y-%m-01')]) ELSE [''] END) AS start FROM o WHERE way NOT IN (4, 5))
 SELECT o_orderkey, 'rule' AS kind, start, NULL AS sentence FROM found
 UNION ALL SELECT o_orderkey, 'review', '', 'No soundboards since the new label deal' FROM o WHERE way = 5
 UNION ALL SELECT o_orderkey, 'review', '', 'Please do not trade streams' FROM o WHERE way = 6""",
}
