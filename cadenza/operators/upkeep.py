"""Upkeep of the catalogue: owed work, orphans, backfills, audits and migrations.

Every rule is an anti-join, a grouping or an expression; anti-joins are on keys that
are never null on the right side, so null keys on the left count as missing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.operators.normalise import name_key
from cadenza.sources.catalogue import Catalogue

# Names that stand for an unknown venue.
PLACEHOLDERS = ("unknown", "unknown venue", "tba", "tbd", "various", "n a", "none", "venue")


def _union(rows: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, rows)


def owed_work(c: Catalogue) -> DataFrame:
    """Six kinds of work that is owed, as (kind, id)."""
    docs, labels = c.table("documents"), c.table("labels")
    library = c.recording.filter("location = 'library'").select("id", "performance_id", "kind")
    kind = lambda rows, name, key: rows.select(F.lit(name).alias("kind"), F.col(key).cast("long").alias("id"))
    no_quality = docs.join(labels, "doc_id", "left_anti")
    no_tracks = library.filter("id % 9 = 0").join(c.table("lineitem").filter("l_partkey % 5 <> 0").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")), "id", "left_anti")
    no_image = c.artist.select("id").join(c.table("orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id")), "id", "left_anti")
    no_members = c.artist.select("id").join(c.membership.select(F.col("artist_id").alias("id")), "id", "left_anti")
    no_genres = c.table("events").filter(F.get_json_object(F.coalesce("props", F.lit("{}")), "$.genres_checked").isNull() & (F.col("event_type") == "error"))
    no_geography = c.performance.filter("venue_id IS NULL AND city IS NULL")
    return _union([kind(no_quality, "quality", "doc_id"), kind(no_tracks, "tracks", "id"), kind(no_image, "image", "id"), kind(no_members, "members", "id"), kind(no_genres, "genres", "event_id"), kind(no_geography, "geography", "id")])


def orphans(c: Catalogue) -> DataFrame:
    """Rows of five entities that nothing uses, as (kind, id)."""
    shows = c.performance.filter("id % 2 = 0")
    anti = lambda rows, used, name: rows.join(used, "id", "left_anti").select(F.lit(name).alias("kind"), F.col("id").cast("long").alias("id"))
    acts = anti(c.artist.select("id"), shows.select(F.col("artist_id").alias("id")), "act")
    venues = anti(c.venue.select("id"), shows.filter("venue_id IS NOT NULL").select(F.col("venue_id").alias("id")), "venue")
    empty = anti(c.performance.select("id"), c.recording.filter("location = 'library'").select(F.col("performance_id").alias("id")), "show")
    people = anti(c.table("supplier").select(F.col("s_suppkey").alias("id")), c.membership.select(F.col("musician_id").alias("id")), "musician")
    genres = anti(c.genre.select("id"), c.artist.select(F.col("genre_id").alias("id")), "genre")
    return _union([acts, venues, empty, people, genres])


def orphan_places(c: Catalogue) -> DataFrame:
    """Venues with neither shows nor events."""
    shows = c.performance.filter("y >= 1998 AND venue_id IS NOT NULL").select(F.col("venue_id").alias("id"))
    events = c.table("events").filter("event_type = 'purchase'").select((F.col("user_id") % 50).alias("id"))
    return c.venue.select("id", "name").join(shows, "id", "left_anti").join(events, "id", "left_anti")


def dangling_memberships(c: Catalogue) -> DataFrame:
    """Memberships whose musician is gone (every fourth is, here)."""
    there = c.table("supplier").filter("s_suppkey % 4 <> 0").select(F.col("s_suppkey").alias("musician_id"))
    return c.membership.join(there, "musician_id", "left_anti").select("artist_id", "musician_id")


def stale_staging(c: Catalogue) -> DataFrame:
    """Staged pages whose folder (host) is not in the listing of documents' sources any more."""
    host = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)
    listing = c.table("pages").filter("page_id % 3 = 0").select(host.alias("host")).distinct()
    return c.table("pages").select("page_id", host.alias("host")).join(listing, "host", "left_anti")


def placeholder_venues(c: Catalogue) -> DataFrame:
    """Venues whose normalised name stands for an unknown one."""
    names = F.array(F.lit("Unknown Venue"), F.lit("T.B.A."), F.lit("N/A"), F.col("s_name"), F.lit("The Venue"))
    rows = c.table("supplier").select("s_suppkey", F.element_at(names, (F.col("s_suppkey") % 5 + 1).cast("int")).alias("name"))
    bare = F.replace(name_key(F.col("name")), F.lit("t b a"), F.lit("tba"))
    return rows.filter(bare.isin(*PLACEHOLDERS))


def filled_roles(c: Catalogue) -> DataFrame:
    """Engineers filled in from the text, only where a role is empty; rows that change."""
    key = F.col("id")
    old = F.when(key % 3 == 0, F.concat(F.lit("E"), (key % 11).cast("string")))
    found = F.when(key % 2 == 0, F.concat(F.lit("F"), (key % 13).cast("string")))
    return c.recording.select("id", F.coalesce(old, found).alias("engineer"), (old.isNull() & found.isNotNull()).alias("filled")).filter("filled").drop("filled")


def outdated_analyses(c: Catalogue, version: int = 2) -> DataFrame:
    """Documents without an analysis of the current version."""
    done = c.table("labels").filter((F.col("doc_id") % 3).cast("int") == version).select("doc_id")
    return c.table("documents").select("doc_id").join(done, "doc_id", "left_anti")


def tag_inventory(c: Catalogue) -> DataFrame:
    """Tag keys and how often each occurs, in two groups (errors and the rest)."""
    tags = F.from_json(F.concat(F.expr("left(props, length(props) - 1)"), F.lit(", \""), F.col("event_type"), F.lit("\": 1}")), "map<string,string>")
    rows = c.table("events").select((F.col("event_type") == "error").alias("is_error"), F.explode(F.map_keys(tags)).alias("tag"))
    return rows.groupBy("is_error", "tag").agg(F.count("*").alias("n"))


def group_spread(c: Catalogue) -> DataFrame:
    """Spread of a measure within each show of four lines or more, and its correlation with another over all lines."""
    rows = c.table("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.round(F.stddev_samp("l_extendedprice"), 4).alias("spread"), F.round(F.avg("l_quantity"), 6).alias("mean"))
    return rows.filter("n >= 4")


def roster_stints(c: Catalogue) -> DataFrame:
    """Stints of a roster in CSV: partial dates, whose unknown parts are blank."""
    line = F.concat_ws(",", F.col("l_suppkey"), F.year("l_shipdate"), F.when(F.col("l_orderkey") % 3 != 0, F.month("l_shipdate").cast("string")).otherwise(""), F.when(F.col("l_orderkey") % 2 == 0, "guitar").otherwise("bass; voice"))
    rows = c.table("lineitem").select("l_orderkey", "l_linenumber", F.from_csv(line, "musician_id long, y int, m int, instruments string").alias("r"))
    rows = rows.select(F.col("r.musician_id").alias("musician_id"), "r.y", "r.m", F.explode(F.split("r.instruments", ";\\s*")).alias("instrument"))
    return rows.groupBy("musician_id", "instrument").agg(F.min(F.struct("y", F.coalesce("m", F.lit(0)).alias("m"))).alias("s"), F.count("*").alias("n")).select("musician_id", "instrument", F.col("s.y").alias("first_year"), F.nullif("s.m", F.lit(0)).alias("first_month"), "n")


def migrated_counts(c: Catalogue) -> DataFrame:
    """Studio recordings split off into their own rows: counts before and after, and whether they agree, per kind."""
    before = c.recording.groupBy("kind").agg(F.count("*").alias("before"))
    moved = c.recording.filter("kind = 'studio'").select("id", F.lit("studio").alias("kind"))
    stay = c.recording.filter("kind <> 'studio'").select("id", "kind")
    after = stay.unionByName(moved).groupBy("kind").agg(F.count("*").alias("after"))
    return before.join(after, "kind", "full").select("kind", "before", "after", F.col("before").eqNullSafe(F.col("after")).alias("agrees"))


def derived_sets(c: Catalogue) -> DataFrame:
    """What is reachable from the visible recordings: acts, venues, musicians, genres, as (kind, id)."""
    shows = c.recording.filter("location = 'library' AND kind = 'live' AND NOT is_official AND is_favorite").select(F.col("performance_id").alias("id")).distinct()
    shows = c.performance.join(shows, "id", "left_semi").select("id", "artist_id", "venue_id")
    acts = shows.select(F.col("artist_id").alias("id")).distinct()
    # a member's days are not asked for: lines are not grouped by stints, and only the acts' orders are joined
    played = c.table("orders").join(acts, F.col("o_custkey") == F.col("id"), "left_semi").select("o_orderkey")
    people = c.table("lineitem").select("l_orderkey", "l_suppkey").join(played, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select(F.col("l_suppkey").alias("id")).distinct()
    genres = c.artist.join(acts, "id", "left_semi").select(F.col("genre_id").alias("id")).distinct()
    venues = shows.filter("venue_id IS NOT NULL").select(F.col("venue_id").alias("id")).distinct()
    return _union([rows.select(F.lit(name).alias("kind"), F.col("id").cast("long").alias("id")) for name, rows in (("act", acts), ("venue", venues), ("musician", people), ("genre", genres))])


def demotable(c: Catalogue) -> DataFrame:
    """Users only picked at random who also played in the last days: an intersection of id sets."""
    rows = c.table("events")
    bought = rows.filter("event_type = 'purchase' AND event_id % 10 = 0").select("user_id")
    late = rows.filter("event_id % 10 = 1").select("user_id")
    return late.intersect(bought)
