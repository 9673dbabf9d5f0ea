"""The catalogue views as common table expressions."""

VIEWS = {
    "genre": "SELECT r_regionkey AS id, r_name AS name FROM region",
    "artist": "SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'X ' || c_name END AS sort_name, n_regionkey AS genre_id FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "venue": "SELECT s_suppkey AS id, s_name AS name, 'City ' || CAST(s_suppkey % 17 AS VARCHAR) AS city, n_name AS state, r_name AS country FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "performance": """SELECT o_orderkey AS id, o_custkey AS artist_id, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % (SELECT count(*) FROM supplier) END AS venue_id,
      CAST(year(o_orderdate) AS INT) AS y, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(month(o_orderdate) AS INT) END AS m,
      CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0 THEN CAST(day(o_orderdate) AS INT) END AS d,
      CASE WHEN o_orderkey % 11 = 0 THEN 'Elsewhere' END AS city FROM orders""",
    "recording": """SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS performance_id,
      CASE WHEN min(l_returnflag) = 'A' THEN 'SBD' WHEN min(l_returnflag) = 'N' THEN 'FM' ELSE 'AUD' END AS source,
      CASE WHEN min(l_linestatus) = 'F' THEN 'library' ELSE 'queue' END AS location,
      CASE WHEN l_linenumber = 7 THEN 'studio' ELSE 'live' END AS kind,
      CASE WHEN min(l_discount) < 0.03 THEN 'A' WHEN min(l_discount) < 0.07 THEN 'B' ELSE 'C' END AS quality,
      (l_linenumber = 3 AND l_orderkey % 13 = 0) AS is_favorite, l_linenumber = 5 AS is_official, min(l_shipdate) AS created_at
      FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "membership": """SELECT o_custkey AS artist_id, l_suppkey AS musician_id,
      CAST(year(min(l_shipdate)) * 10000 + month(min(l_shipdate)) * 100 + day(min(l_shipdate)) AS INT) AS start_day,
      CAST(year(max(l_shipdate)) * 10000 + month(max(l_shipdate)) * 100 + day(max(l_shipdate)) AS INT) AS end_day
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_suppkey""",
    "track": """SELECT l_orderkey * 10 + l_linenumber AS recording_id, l_partkey AS track_number,
      CASE WHEN l_linenumber % 3 <> 0 THEN l_linenumber % 3 END AS set_number, p_name AS title, l_quantity * 10 AS duration, l_extendedprice / 1e5 AS flatness
      FROM lineitem JOIN part ON l_partkey = p_partkey""",
}


def with_views(body: str, *names: str) -> str:
    """SQL with the named views before it; a body that starts with WITH goes on after them."""
    head = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names)
    body = body.strip()
    if not names:
        return body
    return f"WITH {head},\n{body[4:].lstrip()}" if body.upper().startswith("WITH ") else f"WITH {head}\n{body}"
