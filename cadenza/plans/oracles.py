"""DuckDB SQL for every query that SQL can express."""

from __future__ import annotations

from cadenza.functions.curves import CREST, DUR_REL, FLAT_REL, HF_RATIO, MID_SNR, TILT, curve_sql
from cadenza.operators.resolution import NOISE_WORDS
from cadenza.plans.views import with_views as v

_PERSONNEL = """SELECT p.id AS performance_id, count(DISTINCT musician_id) AS n_members, min(musician_id) AS first_member
 FROM performance p JOIN membership m ON p.artist_id = m.artist_id
 AND m.start_day <= y * 10000 + coalesce(p.m, 12) * 100 + coalesce(p.d, 31) AND m.end_day >= y * 10000 + coalesce(p.m, 1) * 100 + coalesce(p.d, 1)
 GROUP BY p.id"""
_IMAGES = """SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey
 ORDER BY CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END, o_orderpriority, o_orderkey) AS place FROM orders) WHERE place = 1"""
_VISIBLE = """SELECT id, performance_id FROM recording WHERE location = 'library' AND kind = 'live' AND NOT is_official AND (performance_id % 4 = 0 OR is_favorite)"""
_EVIDENCE = """SELECT event_id % 500 AS item, user_id % 5 AS cand, sum(value) / 10 + 3.0 * least(count(DISTINCT event_type) - 1, 2) AS score FROM events GROUP BY 1, 2"""
_BINS = """SELECT CAST(least(floor(value / 5), 20) AS INT) AS bin, count(*) AS n, (count(*) FILTER (event_type = 'purchase') + 1) / CAST(count(*) + 2 AS DOUBLE) AS rate FROM events GROUP BY 1"""
_KEYS = """SELECT grp, id, trim(regexp_replace(regexp_replace(lower(key), '[''’]', '', 'g'), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS key FROM (
 SELECT 'artists' AS grp, id, unnest([name, sort_name]) AS key FROM artist
 UNION ALL SELECT 'venues', id, unnest([name, city, state, country]) FROM venue
 UNION ALL SELECT 'albums', p_partkey, unnest([p_name, p_brand]) FROM part) WHERE key IS NOT NULL"""
_CORE = "array_to_string(CASE WHEN len(list_filter(w, lambda x: x NOT IN ({noise}))) > 0 THEN list_filter(w, lambda x: x NOT IN ({noise})) ELSE w END, ' ')".format(
    noise=", ".join(f"'{w}'" for w in NOISE_WORDS)
)
_GRAMS = "SELECT DISTINCT name, substr(name, i, 3) AS gram FROM names, range(1, 60) r(i) WHERE i <= length(name) - 2"


def _grade(term: str) -> str:
    return f"max(CASE WHEN key = '{term}' THEN 100 WHEN starts_with(key, '{term}') THEN 80 WHEN contains(key, ' {term}') THEN 60 WHEN contains(key, '{term}') THEN 40 ELSE 0 END)"


def _search(*terms: str) -> str:
    grades = ", ".join(f"{_grade(t)} AS t{i}" for i, t in enumerate(terms))
    names = [f"t{i}" for i in range(len(terms))]
    return v(f"WITH k AS ({_KEYS}), g AS (SELECT grp, id, {grades} FROM k GROUP BY grp, id) SELECT grp, id, ({' + '.join(names)}) / CAST({len(terms)} AS DOUBLE) AS score FROM g WHERE {' AND '.join(n + ' > 0' for n in names)}", "artist", "venue")



def _search_all(terms: tuple[str, ...], date: str | None, limit: int = 20) -> str:
    """SQL of search.search_all: keys per row, every term must match, the best ``limit`` of each group."""
    key = lambda x: f"trim(regexp_replace(regexp_replace(strip_accents(lower({x})), '[''’]', '', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    rows = """SELECT 'recordings' AS grp, r.id, a.name AS first_key, [a.name, a.sort_name, v.name, coalesce(v.city, p.city), v.state, v.country] AS keys, y, m, d
 FROM recording r JOIN performance p ON r.performance_id = p.id JOIN artist a ON p.artist_id = a.id LEFT JOIN venue v ON v.id = p.venue_id WHERE r.location = 'library'"""
    if terms:
        rows += """ UNION ALL SELECT 'artists', id, name, [name, sort_name], NULL, NULL, NULL FROM artist UNION ALL SELECT 'venues', id, name, [name, city, state, country], NULL, NULL, NULL FROM venue
 UNION ALL SELECT 'albums', p_partkey, p_name, [p_name, p_brand], NULL, NULL, NULL FROM part"""
    best = [f"(SELECT max(CASE WHEN k = '{t}' THEN 100 WHEN starts_with(k, '{t}') THEN 80 WHEN contains(k, ' {t}') THEN 60 WHEN contains(k, '{t}') THEN 40 ELSE 0 END) FROM (SELECT {key('u')} AS k FROM (SELECT unnest(keys) AS u)))" for t in terms]
    cols = "".join(f", {b} AS t{i}" for i, b in enumerate(best))
    ok = " AND ".join([f"t{i} > 0" for i in range(len(terms))] + [f"(grp <> 'recordings' OR {date})"] * bool(date)) or "true"
    mean = f"({' + '.join(f't{i}' for i in range(len(terms)))}) / CAST({len(terms)} AS DOUBLE)" if terms else "CAST(0 AS DOUBLE)"
    return v(
        f"""WITH s AS ({rows}), t AS (SELECT grp, id, {key('first_key')} AS first_key, y, m, d{cols} FROM s), u AS (SELECT grp, id, {mean} AS score, row_number() OVER (PARTITION BY grp ORDER BY {mean} DESC, first_key, id) AS place FROM t WHERE {ok})
 SELECT grp, id, score, CAST(place AS INT) AS place FROM u WHERE place <= {limit}""",
        "artist", "venue", "performance", "recording",
    )


ORACLES = {
    "artist_counts": v(
        """SELECT a.id, a.name, count(r.id) FILTER (r.location = 'library') AS n_published, count(r.id) AS n_total FROM artist a
 LEFT JOIN performance p ON p.artist_id = a.id LEFT JOIN recording r ON r.performance_id = p.id GROUP BY a.id, a.name HAVING count(r.id) FILTER (r.location = 'library') > 0 OR count(r.id) = 0""",
        "artist", "performance", "recording",
    ),
    "kind_counts": v("SELECT count(*) FILTER (kind = 'live') AS live, count(*) FILTER (kind = 'studio') AS studio FROM recording WHERE location = 'library'", "recording"),
    "recent_recordings": v("SELECT id, source, created_at FROM recording WHERE location = 'library' ORDER BY created_at DESC NULLS LAST, id DESC LIMIT 50", "recording"),
    "favourites": v(
        """SELECT coalesce(a.sort_name, a.name) AS act, r.id, y, m, d, row_number() OVER (PARTITION BY coalesce(a.sort_name, a.name) ORDER BY y NULLS FIRST, m NULLS FIRST, d NULLS FIRST, r.id) AS place
 FROM recording r JOIN performance p ON r.performance_id = p.id JOIN artist a ON p.artist_id = a.id WHERE is_favorite""",
        "recording", "performance", "artist",
    ),
    "on_this_day": v("SELECT r.id AS recording_id, artist_id, y FROM performance p JOIN recording r ON r.performance_id = p.id WHERE m = 7 AND d = 14", "performance", "recording"),
    "venue_counts": v(
        """SELECT v.id, v.name, v.city, v.country, count(DISTINCT p.id) AS n_shows, count(r.id) FILTER (r.location = 'library') AS n_recordings, min(p.y) AS first_year, max(p.y) AS last_year
 FROM venue v LEFT JOIN performance p ON p.venue_id = v.id LEFT JOIN recording r ON r.performance_id = p.id GROUP BY ALL""",
        "venue", "performance", "recording",
    ),
    "genre_counts": v("SELECT g.id, g.name, count(a.id) AS n_acts FROM genre g LEFT JOIN artist a ON a.genre_id = g.id GROUP BY g.id, g.name", "genre", "artist"),
    "musician_counts": v(
        """SELECT musician_id, count(r.id) AS n_recordings, count(DISTINCT mb.artist_id) AS n_acts FROM membership mb LEFT JOIN performance p ON p.artist_id = mb.artist_id
 LEFT JOIN recording r ON r.performance_id = p.id GROUP BY musician_id""",
        "membership", "performance", "recording",
    ),
    "role_counts": "SELECT name, count(*) AS n FROM (SELECT unnest(list_distinct([l_suppkey % 50, l_partkey % 50, l_orderkey % 50])) AS name FROM lineitem) GROUP BY name",
    "top_acts_of_venue": v(
        """SELECT venue_id, place, name, shows, n_acts FROM (SELECT venue_id, a.name, shows, row_number() OVER (PARTITION BY venue_id ORDER BY shows DESC, lower(a.name), a.id) AS place, count(*) OVER (PARTITION BY venue_id) AS n_acts
 FROM (SELECT venue_id, artist_id, count(*) AS shows FROM performance WHERE venue_id IS NOT NULL GROUP BY ALL) s JOIN artist a ON a.id = s.artist_id) WHERE place <= 3""",
        "performance", "artist",
    ),
    "instruments": """WITH w AS (SELECT p_brand, p_partkey, string_split(p_name, ' ') AS l FROM part), u AS (SELECT p_brand, p_partkey, unnest(range(1, len(l) + 1)) AS pos, unnest(l) AS word FROM w),
 f AS (SELECT p_brand, word, min(p_partkey * 1000 + pos) AS spot FROM u GROUP BY ALL) SELECT p_brand, string_agg(word, ',' ORDER BY spot) AS words FROM f GROUP BY p_brand""",
    "show_places": v("SELECT p.id, CASE WHEN p.venue_id IS NOT NULL THEN v.city ELSE p.city END AS city, v.country FROM performance p LEFT JOIN venue v ON p.venue_id = v.id", "performance", "venue"),
    "track_places": v(
        "SELECT recording_id, set_number, track_number, row_number() OVER (PARTITION BY recording_id, set_number ORDER BY track_number) AS place FROM (SELECT DISTINCT recording_id, set_number, track_number FROM track WHERE set_number IS NOT NULL)",
        "track",
    ),
    "first_images": _IMAGES,
    "image_chain": v(
        f"""WITH i AS ({_IMAGES}), o AS (SELECT performance_id, min(id) AS own FROM recording WHERE is_favorite GROUP BY 1)
 SELECT p.id, coalesce(own, o_orderkey, CASE WHEN venue_id % 2 = 0 THEN venue_id END) AS image FROM performance p LEFT JOIN o ON o.performance_id = p.id LEFT JOIN i ON i.o_custkey = p.artist_id AND o_orderpriority = '1-URGENT'""",
        "performance", "recording",
    ),
    "personnel": v(_PERSONNEL, "performance", "membership"),
    "visible_recordings": v(_VISIBLE, "recording"),
    "visible_counts": v(
        f"""WITH vis AS ({_VISIBLE}), s AS (SELECT * FROM performance WHERE id IN (SELECT performance_id FROM vis)), a AS (SELECT * FROM artist WHERE id IN (SELECT artist_id FROM s))
 SELECT 'recordings' AS what, count(*) AS n FROM vis UNION ALL SELECT 'shows', count(*) FROM s UNION ALL SELECT 'acts', count(*) FROM a
 UNION ALL SELECT 'venues', count(DISTINCT venue_id) FROM s UNION ALL SELECT 'genres', count(DISTINCT genre_id) FROM a""",
        "recording", "performance", "artist",
    ),
    "orphan_acts": v("SELECT id, name FROM artist a WHERE NOT EXISTS (SELECT 1 FROM performance p WHERE p.artist_id = a.id) AND NOT EXISTS (SELECT 1 FROM membership m WHERE m.artist_id = a.id)", "artist", "performance", "membership"),
    "owed_recordings": v("SELECT id, performance_id FROM recording r WHERE location = 'library' AND NOT EXISTS (SELECT 1 FROM events e WHERE event_type = 'purchase' AND e.event_id % 15000 = r.performance_id)", "recording"),
    "wiped_personnel": v(
        f"""WITH per AS ({_PERSONNEL}), n AS (SELECT artist_id, count(*) AS n_members FROM membership GROUP BY 1)
 SELECT p.id, n_members FROM performance p JOIN n ON n.artist_id = p.artist_id WHERE NOT EXISTS (SELECT 1 FROM per WHERE per.performance_id = p.id)""",
        "performance", "membership",
    ),
    "replaced_slice": v("SELECT id, source FROM recording WHERE source <> 'FM' UNION ALL SELECT id, 'FM' FROM recording WHERE source = 'FM' AND location = 'library'", "recording"),
    "upserted": """SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, coalesce(old, new) AS decision FROM (SELECT c_custkey, c_mktsegment AS old FROM customer WHERE c_custkey % 3 <> 0) o
 FULL JOIN (SELECT o_custkey AS c_custkey, max(o_orderpriority) AS new FROM orders GROUP BY 1) n ON o.c_custkey = n.c_custkey""",
    "quality_composite": f"""WITH x AS (SELECT l_returnflag, 0.5 * ({curve_sql('(-l_quantity / 3)', TILT)}) + 0.5 * ({curve_sql('(-p_size - 15)', HF_RATIO)}) AS tone,
 {curve_sql('CAST(p_size AS DOUBLE)', MID_SNR)} AS noise, {curve_sql('(l_quantity / 2)', CREST)} AS dyn FROM lineitem JOIN part ON l_partkey = p_partkey),
 s AS (SELECT l_returnflag, least(greatest(exp(0.35 * ln(greatest(tone, 1.0)) + 0.15 * ln(greatest(noise, 1.0)) + 0.5 * ln(greatest(dyn, 1.0)))
 + CASE l_returnflag WHEN 'A' THEN 0.0 WHEN 'N' THEN 1.5 ELSE -3.0 END, 0.0), 100.0) AS score FROM x)
 SELECT l_returnflag, count(*) AS n, round(avg(score), 6) AS mean, count(*) FILTER (score >= 85) AS high, count(*) FILTER (score >= 70 AND score < 85) AS medium, count(*) FILTER (score < 70) AS low FROM s GROUP BY 1""",
    "non_music": v(
        f"""WITH t AS (SELECT recording_id // 10 AS recording, track_number, max(flatness) AS flatness, max(duration) AS duration FROM track GROUP BY ALL),
 b AS (SELECT recording, count(*) AS n, quantile_cont(flatness, 0.25) AS low, quantile_cont(duration, 0.5) AS mid FROM t GROUP BY 1)
 SELECT t.recording, track_number, round(0.5 * ({curve_sql('(flatness / low)', FLAT_REL)}) + 0.5 * ({curve_sql('(duration / mid)', DUR_REL)}), 9) AS score FROM t JOIN b ON t.recording = b.recording WHERE n >= 4""",
        "track",
    ),
    "completeness": v(
        """WITH s AS (SELECT id, round(100.0 * (((y IS NOT NULL)::INT + (m IS NOT NULL)::INT + (d IS NOT NULL)::INT) / 3::DOUBLE + (venue_id IS NOT NULL)::INT + (artist_id IS NOT NULL)::INT) / 3, 6) AS score FROM performance)
 SELECT id, CAST(score AS DOUBLE) AS score, CASE WHEN score >= 85 THEN 'green' WHEN score >= 60 THEN 'yellow' ELSE 'red' END AS band FROM s""",
        "performance",
    ),
    "fit_statistics": """SELECT l_returnflag, count(*) AS n, round(corr(x, y), 8) AS r, round(avg(abs(x - y)), 6) AS mae, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept
 FROM (SELECT l_returnflag, l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem) GROUP BY 1""",
    "confusion": 'SELECT quality, count(*) FILTER (n_chars >= 2000) AS "long", count(*) FILTER (n_chars < 2000) AS "short" FROM labels JOIN documents USING (doc_id) GROUP BY 1',
    "smoothed_bins": _BINS,
    "isotonic_bins": f"""WITH b AS (SELECT bin, rate, n + 2 AS n FROM ({_BINS})), e AS (SELECT i.bin, j.bin AS lo, k.bin AS hi, sum(m.rate * m.n) / sum(m.n) AS mean FROM b i JOIN b j ON j.bin <= i.bin JOIN b k ON k.bin >= i.bin JOIN b m ON m.bin BETWEEN j.bin AND k.bin GROUP BY ALL),
 l AS (SELECT bin, lo, min(mean) AS least FROM e GROUP BY ALL), f AS (SELECT bin, max(least) AS fitted FROM l GROUP BY bin) SELECT b.bin, b.rate, b.n, round(fitted, 9) AS fitted FROM b JOIN f ON b.bin = f.bin""",
    "waveform": """WITH u AS (SELECT vec_id, len(embedding) AS n, unnest(range(0, len(embedding))) AS pos, unnest(embedding) AS x FROM embeddings)
 SELECT vec_id, CAST(floor(pos * 8 / CAST(n AS DOUBLE)) AS INT) AS bucket, CAST(max(abs(x)) AS DOUBLE) AS peak FROM u GROUP BY 1, 2""",
    "evidence": f"SELECT item, cand, round(score, 6) AS score FROM ({_EVIDENCE})",
    "confidence": f"""WITH e AS ({_EVIDENCE}), r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, cand) AS place FROM e),
 b AS (SELECT item, max(cand) FILTER (place = 1) AS cand, max(score) FILTER (place = 1) AS score, coalesce(max(score) FILTER (place = 2), 0.0) AS second FROM r GROUP BY item),
 l AS (SELECT r.item, sum(exp(r.score - greatest(second, 0.0))) FILTER (place > 1) AS s FROM r JOIN b ON r.item = b.item GROUP BY r.item)
 SELECT b.item, b.cand, round(b.score - second, 6) AS margin, round(b.score - (greatest(second, 0.0) + ln(exp(-greatest(second, 0.0)) + coalesce(s, 0.0))), 6) AS logit FROM b JOIN l ON b.item = l.item""",
    "tiered_lookup": f"""WITH p AS (SELECT p_partkey AS id, lower(p_name) AS name, lower(p_name || ' ' || p_type) AS alias FROM part),
 k AS (SELECT *, CASE id % 3 WHEN 0 THEN name WHEN 1 THEN alias ELSE 'the ' || name || ' band' END AS typed FROM p),
 c AS (SELECT id, {_CORE.replace("w ", "string_split(name, ' ') ").replace("(w,", "(string_split(name, ' '),")} AS core FROM p), t AS (SELECT id, typed, {_CORE.replace("w ", "string_split(typed, ' ') ").replace("(w,", "(string_split(typed, ' '),")} AS core FROM k),
 h AS (SELECT t.id, (SELECT min(p.id) FROM p WHERE p.name = t.typed) AS e, (SELECT min(p.id) FROM p WHERE p.alias = t.typed) AS a, (SELECT min(c.id) FROM c WHERE c.core = t.core) AS o FROM t)
 SELECT id AS p_partkey, coalesce(e, a, o) AS match, CASE WHEN e IS NOT NULL THEN 'exact' WHEN a IS NOT NULL THEN 'alias' WHEN o IS NOT NULL THEN 'core' END AS tier FROM h""",
    "gram_frequency": f"WITH names AS (SELECT DISTINCT lower(n) AS name FROM (SELECT p_name AS n FROM part UNION SELECT n_name FROM nation)), g AS ({_GRAMS}) SELECT gram, count(*) AS df FROM g GROUP BY gram",
    "fuzzy_candidates": f"""WITH names AS (SELECT DISTINCT lower(p_name || ' ' || p_type) AS name FROM part), g AS ({_GRAMS}), f AS (SELECT gram, count(*) AS df, ln(1 + (SELECT count(*) FROM names) / count(*)) AS idf FROM g GROUP BY 1),
 q AS (SELECT DISTINCT substr(name, 1, 2) || substr(name, 4) AS typed FROM names), qg AS (SELECT DISTINCT typed, substr(typed, i, 3) AS gram FROM q, range(1, 60) r(i) WHERE i <= length(typed) - 2),
 r AS (SELECT typed, qg.gram, idf, row_number() OVER (PARTITION BY typed ORDER BY df, qg.gram) AS place FROM qg JOIN f ON qg.gram = f.gram),
 m AS (SELECT typed, name, round(sum(idf), 9) AS weight FROM r JOIN g ON r.gram = g.gram WHERE place <= 6 GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (PARTITION BY typed ORDER BY weight DESC, name) AS place FROM m),
 o AS (SELECT p.typed, p.name, count(*) AS both_n FROM p JOIN qg ON qg.typed = p.typed JOIN g ON g.name = p.name AND g.gram = qg.gram WHERE place <= 150 GROUP BY 1, 2),
 s AS (SELECT typed, name, round(both_n / CAST((SELECT count(*) FROM qg WHERE qg.typed = o.typed) + (SELECT count(*) FROM g WHERE g.name = o.name) - both_n AS DOUBLE), 9) AS jaccard, least(length(typed), length(name)) AS a, greatest(length(typed), length(name)) AS b FROM o)
 SELECT * FROM (SELECT typed, name, jaccard, round(CASE WHEN typed = name THEN 0.97 WHEN a >= 5 AND (contains(name, typed) OR contains(typed, name)) THEN least(0.95::DOUBLE, 0.6 + 0.4 * a / CAST(b AS DOUBLE)) ELSE least(0.96::DOUBLE, 1 - levenshtein(typed, name) / CAST(b AS DOUBLE)) END, 9) AS score FROM s) WHERE jaccard >= 0.3 AND score >= 0.85""",
    "similar_names": """WITH n AS (SELECT DISTINCT lower(p_name || ' ' || p_type) AS name FROM part), r AS (SELECT a.name AS x, b.name AS y, levenshtein(a.name, b.name) AS e, greatest(length(a.name), length(b.name)) AS l FROM n a JOIN n b ON a.name < b.name)
 SELECT x, y, round(1 - e / CAST(l AS DOUBLE), 9) AS ratio FROM r WHERE 100 * e <= 15 * l""",
    "content_duplicates": """WITH f AS (SELECT text, min(doc_id) AS owner, count(*) AS copies FROM documents GROUP BY text HAVING count(*) > 1)
 SELECT doc_id, owner, copies FROM documents d JOIN f ON d.text = f.text WHERE doc_id <> owner""",
    "sole_owner": "SELECT l_orderkey, count(*) AS n, min(l_suppkey) AS owner FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 1 AND count(*) >= 2",
    "dominant_place": """WITH r AS (SELECT c_nationkey, c_mktsegment, count(*) AS n, row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, c_mktsegment) AS place FROM customer GROUP BY 1, 2),
 b AS (SELECT c_nationkey, max(c_mktsegment) FILTER (place = 1) AS top, max(n) FILTER (place = 1) AS n1, coalesce(max(n) FILTER (place = 2), 0) AS n2 FROM r GROUP BY 1)
 SELECT c_nationkey, CASE WHEN n1 >= CAST(1.2 AS DOUBLE) * n2 THEN top END AS place FROM b""",
    "capped_aliases": f"""WITH k AS (SELECT p_brand, p_partkey, string_split(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM part),
 g AS (SELECT p_brand, {_CORE} AS key, min(p_partkey) AS "first" FROM k GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY "first") AS place FROM g) SELECT * FROM r WHERE place <= 3""",
    "popularity": v(
        """SELECT coalesce(s.artist_id, m.artist_id) AS artist_id, 3 * coalesce(shows, 0) + coalesce(members, 0) AS popularity FROM (SELECT artist_id, count(*) AS shows FROM performance GROUP BY 1) s
 FULL JOIN (SELECT artist_id, count(*) AS members FROM membership GROUP BY 1) m ON s.artist_id = m.artist_id""",
        "performance", "membership",
    ),
    "area_chain": """WITH RECURSIVE a AS (SELECT p_partkey AS id, CASE WHEN p_partkey > 1 THEN p_partkey // 2 END AS parent FROM part), chain AS (SELECT id, parent AS up, 1 AS step FROM a WHERE parent IS NOT NULL
 UNION ALL SELECT chain.id, a.parent, chain.step + 1 FROM chain JOIN a ON chain.up = a.id WHERE a.parent IS NOT NULL AND chain.step < 10) SELECT id, count(*) AS n_above, min(up) AS top FROM chain GROUP BY id""",
    "parsed_dates": "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, CAST(day(o_orderdate) AS INT) AS d FROM orders",
    "links": """WITH l AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS h, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages)
 SELECT page_id, CAST(len(h) AS INT) AS n_links, CAST(len(list_distinct(h)) AS INT) AS n_distinct, title FROM l""",
    "excerpts": "SELECT doc_id, CASE WHEN length(text) <= 100 THEN text ELSE regexp_replace(substr(text, 1, 100), '\\s+\\S*\\z', '') || '...' END AS excerpt FROM documents",
    "turn_statistics": "SELECT conv_id, count(*) AS n_turns, count(*) FILTER (role = 'user') AS n_user, CAST(sum(length(text)) AS BIGINT) AS n_chars, arg_min(role, turn) AS first_role FROM conversations GROUP BY 1",
    "json_counts": "SELECT event_type, CAST(sum(coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0)) AS BIGINT) AS k, count(*) FILTER (json_extract_string(props, '$.k') IS NULL) AS missing FROM events GROUP BY 1",
    "infix": "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%widget%' ORDER BY p_name, p_partkey LIMIT 12",
    "recently_played": "SELECT user_id, count(*) AS plays, max(event_id) AS last_event FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAYS GROUP BY 1",
    "stable_sample": "SELECT c_custkey, sha1(c_name) AS h FROM customer ORDER BY h, c_custkey LIMIT 25",
    "search_one_term": _search("widget"),
    "search_two_terms": _search("red", "widget"),
    "search_month": v("SELECT r.id, y, m, quality FROM performance p JOIN recording r ON r.performance_id = p.id WHERE y = 1997 AND m = 5", "performance", "recording"),
}
ORACLES["confidence_gates"] = f"""SELECT item, cand, round(1 / (1 + exp(-logit)), 6) AS chance, round(1 / (1 + exp(-logit)), 6) >= 0.6 AND margin >= 0.5 AND logit >= 0 AS confident FROM ({ORACLES["confidence"]})"""
ORACLES |= {
    "search_groups": _search_all(("customer", "nation"), None),
    "search_mixed": _search_all(("customer",), "y = 1997 AND m = 5"),
    "search_date_only": _search_all((), "y = 1996 AND m = 3 AND d = 9"),
    "search_albums": _search_all(("red", "widget"), None),
}
