"""Visibility, orphans and owed work: semi and anti joins, never NOT IN."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.sources.catalogue import Catalogue


def visible_recordings(c: Catalogue) -> DataFrame:
    """Recordings that a peer sees: in a granted collection, or a favourite, and shareable."""
    granted = c.recording.filter(F.col("performance_id") % 4 == 0).select("id")
    system = c.recording.filter("is_favorite").select("id")
    shareable = c.recording.filter("location = 'library' AND kind = 'live' AND NOT is_official").select("id", "performance_id")
    return shareable.join(granted.union(system).distinct(), "id", "left_semi")


def visible_counts(c: Catalogue) -> DataFrame:
    """Sizes of the derived sets: recordings, then shows, acts, venues, genres; the closure is built once, and counted in one pass."""
    shows = c.performance.select(F.col("id").alias("show"), "artist_id", "venue_id")
    acts = c.artist.select(F.col("id").alias("act"), "genre_id")
    rows = visible_recordings(c).join(shows, F.col("performance_id") == F.col("show"), "left").join(acts, F.col("artist_id") == F.col("act"), "left")
    sets = {"shows": "show", "acts": "act", "venues": "venue_id", "genres": "genre_id"}
    counts = rows.agg(F.count("*").alias("recordings"), *(F.count_distinct(column).alias(name) for name, column in sets.items()))
    return counts.unpivot([], ["recordings", *sets], "what", "n")


def orphan_acts(c: Catalogue) -> DataFrame:
    """Acts without shows and without members."""
    shows = c.performance.select(F.col("artist_id").alias("id"))
    members = c.membership.select(F.col("artist_id").alias("id"))
    return c.artist.join(shows, "id", "left_anti").join(members, "id", "left_anti").select("id", "name")


def owed_recordings(c: Catalogue) -> DataFrame:
    """Published recordings whose show has no event of the kind 'purchase' by its number."""
    done = c.table("events").filter("event_type = 'purchase'").select((F.col("event_id") % 15000).alias("performance_id"))
    return c.recording.filter("location = 'library'").join(done, "performance_id", "left_anti").select("id", "performance_id")


def wiped_personnel(c: Catalogue) -> DataFrame:
    """Shows without a covering member although their act has members (decorrelated counts)."""
    from cadenza.operators.catalogue import personnel

    members = c.membership.groupBy("artist_id").agg(F.count("*").alias("n_members"))
    rows = c.performance.select("id", "artist_id").join(members, "artist_id")
    return rows.join(personnel(c).select(F.col("performance_id").alias("id")), "id", "left_anti").select("id", "n_members")


def replaced_slice(c: Catalogue) -> DataFrame:
    """Drop the rows of one source and append its new ones."""
    old = c.recording.select("id", "source")
    new = c.recording.filter("source = 'FM' AND location = 'library'").select("id", F.lit("FM").alias("source"))
    return old.filter("source <> 'FM'").unionByName(new)


def upserted(c: Catalogue) -> DataFrame:
    """Merge by key, keeping the old decision where there is one."""
    old = c.table("customer").filter("c_custkey % 3 <> 0").select("c_custkey", F.col("c_mktsegment").alias("old"))
    new = c.table("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderpriority").alias("new"))
    return old.join(new, "c_custkey", "full").select("c_custkey", F.coalesce("old", "new").alias("decision"))
