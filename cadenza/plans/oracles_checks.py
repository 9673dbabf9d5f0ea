"""SQL of the checks of shows: verdicts, missing tracks, checksums, owners, quantiles."""

from __future__ import annotations

from cadenza.plans.oracles_resolve import _DATES, _TRACKS
from cadenza.plans.views import with_views as v

_PLACE = "(list(value ORDER BY value))[least(count(*) - 1, cast(floor(count(*) * {}) AS BIGINT)) + 1]"

_WORDS = "array_to_string(list_transform(string_split({0}, ' '), lambda w: upper(w[1]) || w[2:]), ' ')"

ORACLES = {
    "engineer_credits": """WITH o AS (SELECT o_orderkey AS k, translate(substr(md5(o_orderkey::VARCHAR), 1, 6), '0123456789', 'ghijklmnop') AS n FROM orders), w AS (SELECT k, 'Pat ' || upper(n[1]) || n[2:] AS who FROM o)
 SELECT k AS o_orderkey, unnest([['recording', 'mastering'], ['recording', 'transfer'], ['recording'], ['transfer', 'mastering'], [], ['recording', 'mastering']][k % 6 + 1]) AS role,
 unnest([[who, who], [who, 'Ann Other'], [who], [who, who], [], [who, who]][k % 6 + 1]) AS name FROM w""",
    "weighed_candidates": f"""WITH c AS (SELECT item, ['tags', 'info', 'folder'][source + 1] AS src, source, y, m, d, [10.0, 3.0, 4.0][source + 1] AS w,
  CASE WHEN source = 1 THEN least(1, 0.5 * (item % 4)) - CASE WHEN item % 5 = 1 THEN 1.5 ELSE 0 END ELSE 0 END AS extra,
  (y IS NOT NULL)::INT + (m IS NOT NULL)::INT + (d IS NOT NULL)::INT AS k FROM ({_DATES}) WHERE y IS NOT NULL),
 s AS (SELECT t.item, t.src, t.source, t.y, t.m, t.d, t.k, sum(CASE WHEN (v.y, v.m, v.d) IS NOT DISTINCT FROM (t.y, t.m, t.d) THEN v.w + v.extra
  WHEN v.k < t.k AND coalesce(v.y = t.y, true) AND coalesce(v.m = t.m, true) AND coalesce(v.d = t.d, true) THEN v.w * 0.3 ELSE 0 END)::DOUBLE AS score
  FROM c t JOIN c v ON v.item = t.item GROUP BY ALL),
 b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY item ORDER BY k DESC, source) = 1),
 r AS (SELECT DISTINCT b.item, s.y, s.m, s.d, s.score FROM b JOIN s ON s.item = b.item AND (s.y <> b.y OR s.m <> b.m OR s.d <> b.d)),
 q AS (SELECT item, score FROM r UNION ALL SELECT item, 1.0 FROM b), m AS (SELECT item, max(score) AS most FROM q GROUP BY 1),
 l AS (SELECT q.item, any_value(most) AS most, any_value(most) + ln(sum(exp(score - most))) AS mass FROM q JOIN m USING (item) GROUP BY 1),
 x AS (SELECT DISTINCT a.item FROM c a JOIN c b ON a.item = b.item AND (a.y <> b.y OR a.m <> b.m OR a.d <> b.d)),
 p AS (SELECT b.*, score - mass AS logit, score - most AS margin, x.item IS NOT NULL AS conflict FROM b JOIN l USING (item) LEFT JOIN x ON x.item = b.item),
 g AS (SELECT *, CASE WHEN score <= 1 THEN 0 WHEN logit < 0 THEN 0.2 WHEN logit < 3 THEN 0.6 WHEN logit >= 8 THEN 0.99 ELSE 1 / (1 + exp(-logit)) END AS pp FROM p)
 SELECT item, src AS source, y, m, d, conflict, CASE WHEN score <= 1 THEN 'empty' WHEN pp >= 0.9 AND margin >= 2 AND logit >= 1 THEN 'confident' ELSE 'tentative' END AS label,
 round(score, 6) AS score, round(logit, 6) AS logit, round(margin, 6) AS margin, round(pp::DOUBLE, 6) AS p FROM g""",
    "shareable_recordings": v(
        """SELECT location = 'library' AND kind = 'live' AND NOT is_official AND (performance_id % 3 > 0 OR performance_id % 9 = 0) AS shareable, cast(performance_id % 9 AS INT) AS release, count(*) AS n
 FROM recording GROUP BY 1, 2""",
        "recording",
    ),
    "credited_titles": f"""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN {_WORDS.format("p_name")} WHEN 1 THEN {_WORDS.format("p_name")} WHEN 2 THEN 'Song of the ' || {_WORDS.format("p_name")} || ' (Alt Take)'
 ELSE 'Song of the ' || {_WORDS.format("p_name")} END AS title, CASE WHEN p_partkey % 4 = 1 THEN 'Maria Berg' END AS writer FROM part""",
    "folder_marks": """SELECT o_orderkey, ['AUD', 'SBD', 'FM', NULL][o_orderkey % 4 + 1] AS source, ['schoeps,nak700,AKG451', 'at853,SCHOEPS', NULL, NULL][o_orderkey % 4 + 1] AS gear,
 CASE WHEN o_orderkey + 2100 < 10000000 THEN cast(o_orderkey + 2100 AS INT) END AS number FROM orders""",
    # room is what folder, ending and spare leave of 34 characters
    "safe_names": """WITH s AS (SELECT DISTINCT l_partkey, p_name, CASE l_partkey % 3 WHEN 0 THEN 'A - ' || p_name || ' - ''x''' WHEN 1 THEN '01 - Long Act - ' || p_name ELSE 'nul_' END AS stem FROM lineitem JOIN part ON p_partkey = l_partkey),
 c AS (SELECT *, greatest(34 - 14 - 5 - 4, 12) AS room, CASE WHEN l_partkey % 3 = 1 THEN '01 - ' || p_name ELSE stem END AS short FROM s),
 d AS (SELECT *, substr(short, 1, room) AS start FROM c), e AS (SELECT *, length(start) - length(string_split(start, ' ')[-1]) - 1 AS space FROM d)
 SELECT l_partkey, stem || '.flac' AS safe, CASE WHEN length(stem) <= room THEN stem WHEN length(short) <= room THEN short
 ELSE regexp_replace(CASE WHEN space >= room * 0.6 THEN substr(start, 1, space) ELSE start END, '[ \\-.,;(]+$', '') END || '.flac' AS fitted FROM e""",
    "whole_years": """WITH o AS (SELECT o_orderkey AS k, year(o_orderdate) AS y, CASE WHEN o_orderkey % 5 > 0 THEN strftime(o_orderdate, '-%m') END AS m, CASE WHEN o_orderkey % 4 > 0 THEN strftime(o_orderdate, '-%d') END AS d FROM orders)
 SELECT k AS o_orderkey, CASE WHEN k % 3 = 0 THEN 'text 1' WHEN (k % 2 = 0) = (y < 2000) THEN 'text 2' ELSE 'inferred' END AS how,
 (CASE WHEN k % 3 = 0 THEN y WHEN k % 2 = 0 AND y < 2000 THEN y + 100 WHEN k % 2 = 1 AND y >= 2000 THEN y WHEN y % 100 <= 26 THEN 2000 + y % 100 ELSE 1900 + y % 100 END)::VARCHAR || coalesce(m || coalesce(d, ''), '') AS date FROM o""",
    "graded_events": """SELECT event_id, round(least(100, greatest(0, value * 0.5956 + 40.592)), 6) AS grade,
 round(CASE WHEN value < 10 THEN 0.1 WHEN value < 50 THEN 0.5 WHEN value >= 90 THEN 0.95 ELSE 1 / (1 + exp(-value / 100)) END, 6) AS p FROM events""",
    "judgements": v(
        f"""WITH r AS ({_DATES}) SELECT CASE WHEN r.y IS NULL THEN 'empty' WHEN (r.y, r.m, r.d) IS NOT DISTINCT FROM (p.y, p.m, p.d) THEN 'right'
  WHEN r.y <> p.y OR r.m IS NOT NULL AND r.m IS DISTINCT FROM p.m OR r.d IS NOT NULL AND r.d IS DISTINCT FROM p.d THEN 'wrong' ELSE 'partial' END AS verdict, count(*) AS n
 FROM performance p LEFT JOIN (SELECT * FROM r WHERE source = 0) r ON r.item = p.id GROUP BY 1""",
        "performance",
    ),
    "named_acts": "SELECT ['right', 'right', 'variant', 'partial', 'wrong', 'empty'][c_custkey % 6 + 1] AS verdict, count(*) AS n FROM customer GROUP BY 1",
    "disc_shortfall": """WITH r AS (SELECT l_orderkey AS k, l_suppkey % 2 + 1 AS disc, CASE WHEN l_partkey % 11 > 0 THEN l_linenumber END AS num, CASE WHEN l_partkey % 10 = 0 THEN l_linenumber + 1 END AS total,
  CASE WHEN l_partkey % 90 = 0 THEN 3 END AS discs FROM lineitem),
 d AS (SELECT k, disc, count(*) AS n, coalesce(max(total), 0) AS total, min(num) AS lo, coalesce(max(num), 0) AS hi FROM r GROUP BY 1, 2),
 x AS (SELECT b.k, sum(greatest(b.total, b.n, CASE WHEN b.lo = a.n + 1 THEN b.hi - b.lo + 1 ELSE b.hi END)) AS by_disc FROM d b LEFT JOIN d a ON a.k = b.k AND a.disc < b.disc GROUP BY 1),
 s AS (SELECT k, count(DISTINCT disc) AS present, greatest(coalesce(max(discs), 0), max(disc)) AS said, count(*) AS n, greatest(coalesce(max(total), 0), coalesce(max(num), 0), count(*)) AS as_one,
  count(DISTINCT (disc, num)) FILTER (num IS NOT NULL) AS numbers, count(DISTINCT num) AS different FROM r GROUP BY 1),
 f AS (SELECT k, said > present AS lacks, present, said, n, CASE WHEN present > 1 AND numbers > 0 AND numbers = different THEN as_one ELSE by_disc END AS expected FROM s JOIN x USING (k))
 SELECT k AS l_orderkey, CASE WHEN lacks THEN present ELSE n END AS have, cast(CASE WHEN lacks THEN said ELSE expected END AS BIGINT) AS expected, CASE WHEN lacks THEN 'discs' ELSE 'tracks' END AS unit
 FROM f WHERE lacks OR expected > n""",
    "owned_wholly": """WITH o AS (SELECT l_partkey AS c, 1::BIGINT AS o FROM lineitem WHERE year(l_shipdate) < 1998 AND l_partkey % 3 > 0 OR l_suppkey % 7 = 0 UNION SELECT l_partkey, l_suppkey FROM lineitem WHERE l_suppkey % 50 = 1),
 h AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_orderkey % 10 = 0), n AS (SELECT l_orderkey, count(DISTINCT (l_partkey, l_suppkey)) AS a FROM lineitem WHERE l_orderkey % 10 = 0 GROUP BY 1)
 SELECT h.l_orderkey, min(o.o) AS owner, count(DISTINCT h.l_partkey) AS n_hash FROM h JOIN n USING (l_orderkey) LEFT JOIN o ON o.c = h.l_partkey
 GROUP BY h.l_orderkey, n.a HAVING bool_and(o.o IS NOT NULL) AND count(DISTINCT o.o) = 1 AND count(DISTINCT h.l_partkey) >= n.a""",
    "checksum_matches": f"""WITH b AS (SELECT l_orderkey AS k, "at" AS track, coalesce(tag, 't' || printed) AS stem FROM ({_TRACKS}) WHERE l_orderkey % 4 = 0),
 t AS (SELECT k, track, stem, lower('d' || (track % 2) || '/' || stem || '.flac') AS path, lower(stem) AS low FROM b),
 e AS (SELECT k, track - 1 AS entry, CASE WHEN k % 12 = 0 THEN 'none' WHEN track % 4 = 1 THEN 'path' WHEN track % 4 = 2 THEN 'name' ELSE 'stem' END AS way, path, low FROM t WHERE NOT (k % 24 = 0 AND track = 1)),
 p AS (SELECT k, path, max(track) AS track FROM t GROUP BY 1, 2), u AS (SELECT k, low, max(track) AS track FROM t GROUP BY 1, 2 HAVING count(*) = 1), c AS (SELECT k, count(*) AS n FROM t GROUP BY 1), z AS (SELECT k, count(*) AS n FROM e GROUP BY 1),
 -- names differ from stems by their ending alone, so that both are unique together
 m AS (SELECT e.k, e.entry, CASE way WHEN 'path' THEN p.track WHEN 'none' THEN CASE WHEN c.n = z.n THEN e.entry + 1 END ELSE u.track END AS track, CASE way WHEN 'none' THEN 'position' ELSE way END AS tier
  FROM e JOIN c USING (k) JOIN z USING (k) LEFT JOIN p ON p.k = e.k AND p.path = e.path LEFT JOIN u ON u.k = e.k AND u.low = e.low)
 SELECT k AS l_orderkey, track, 'sum ' || (min(entry) + 1) AS checksum, arg_min(tier, entry) AS tier FROM m WHERE track IS NOT NULL GROUP BY 1, 2""",
    "checksum_files": """SELECT DISTINCT l_orderkey, l_linenumber AS track, md5(l_orderkey || '-' || l_linenumber) AS checksum, ['path', 'stem', 'position', 'name'][l_orderkey % 4 + 1] AS tier FROM lineitem WHERE l_orderkey % 20 <> 2""",
    "latency_quantiles": f"""SELECT event_type, round(median(value), 6) AS p50, {_PLACE.format(0.9)} AS p90, {_PLACE.format(0.95)} AS p95, {_PLACE.format(0.99)} AS p99, max(value) AS most, round(avg(value), 6) AS mean
 FROM events WHERE value IS NOT NULL GROUP BY 1""",
    "source_hints": "SELECT o_orderkey, ['SBD', 'MTX', 'MTX', 'SBD', 'FM', 'MTX', NULL, 'AUD'][o_orderkey % 8 + 1] AS source FROM orders",
}
