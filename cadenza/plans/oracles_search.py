"""SQL of the whole search."""

from __future__ import annotations

from cadenza.plans.views import with_views as v

_NORM = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"


def _grade(term: str) -> str:
    return f"max(CASE WHEN k = '{term}' THEN 100 WHEN starts_with(k, '{term}') THEN 80 WHEN contains(k, ' {term}') THEN 60 WHEN contains(k, '{term}') THEN 40 ELSE 0 END)"


def people(terms: tuple[str, ...], n_dates: int, when: str) -> str:
    """Every key of every recording written out, and graded."""
    grades = ", ".join(f"{_grade(t)} AS t{i}" for i, t in enumerate(terms))
    every, total = " AND ".join(f"t{i} > 0" for i in range(len(terms))), " + ".join(f"t{i}" for i in range(len(terms)))
    body = f"""WITH mus AS (SELECT s_suppkey AS id, 'Player ' || translate(s_suppkey::VARCHAR, '0123456789', 'abcdefghij') AS name FROM supplier),
 ent AS (
  SELECT 'artists' AS grp, id, unnest([0, 1]) AS p, unnest([name, sort_name]) AS k FROM artist
  UNION ALL SELECT 'venues', id, unnest([0, 1, 2, 3]), unnest([name, city, state, country]) FROM venue
  UNION ALL SELECT 'musicians', id, 0, name FROM mus
  UNION ALL SELECT 'engineers', n_nationkey, unnest([0, 1]), unnest([n_name, 'Play-' || n_name]) FROM nation
  UNION ALL SELECT 'albums', r.id, unnest([0, 1, 2]), unnest(['Record ' || performance_id, a.name, a.sort_name]) FROM recording r JOIN performance s ON s.id = performance_id JOIN artist a ON a.id = artist_id WHERE kind = 'studio'),
 rec AS (SELECT r.id, CASE quality WHEN 'A' THEN 90 WHEN 'B' THEN 70 ELSE -1 END AS q, y, m, d, artist_id, venue_id FROM recording r JOIN performance s ON s.id = performance_id WHERE kind = 'live' AND {when}),
 act AS (SELECT id AS a, unnest([name, sort_name]) AS k FROM artist UNION SELECT artist_id, name FROM membership JOIN mus ON mus.id = musician_id),
 hall AS (SELECT id AS v, unnest([name, city, state, country]) AS k FROM venue),
 rk AS (SELECT rec.id, {_NORM.format("k")} AS k FROM rec JOIN act ON a = artist_id WHERE k IS NOT NULL UNION ALL SELECT rec.id, {_NORM.format("k")} FROM rec JOIN hall ON v = venue_id),
 er AS (SELECT grp, id, arg_min(k, p) AS f, {grades} FROM (SELECT grp, id, p, {_NORM.format("k")} AS k FROM ent WHERE k IS NOT NULL) GROUP BY 1, 2),
 rr AS (SELECT id, {grades} FROM rk GROUP BY 1),
 hit AS (SELECT grp, id, ({total})::DOUBLE / {len(terms)} AS score, f, 0 AS q, 0 AS y, 0 AS m, 0 AS d FROM er WHERE {every}
  UNION ALL SELECT 'recordings', rec.id, ({total} + 100 * {n_dates})::DOUBLE / {len(terms) + n_dates}, '', q, coalesce(y, 0), coalesce(m, 0), coalesce(d, 0) FROM rr JOIN rec USING (id) WHERE {every})
 SELECT grp, id, score, cast(row_number() OVER w AS INT) AS place, count(*) OVER (PARTITION BY grp) AS total FROM hit
 WINDOW w AS (PARTITION BY grp ORDER BY score DESC, f, q DESC, y DESC, m DESC, d DESC, id) QUALIFY place <= 20"""
    return v(body, "artist", "venue", "performance", "recording", "membership")


ORACLES = {"search_people": people(("play", "c"), 0, "true"), "search_members": people(("player",), 1, "y = 1997 AND m = 5")}
