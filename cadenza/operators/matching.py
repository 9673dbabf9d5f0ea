"""Joins by key with fallbacks, set equality, dated names and comparisons of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.sources.catalogue import Catalogue


def equal_sets(c: Catalogue) -> DataFrame:
    """Shows with the same set of lines: how many, and the first; equal sets meet by one sorted key."""
    sets = c.table("lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("l_linenumber")), ",").alias("lines"))
    return sets.groupBy("lines").agg(F.count("*").alias("n_shows"), F.min("l_orderkey").alias("first_show"))


def dated_names(c: Catalogue) -> DataFrame:
    """The name of the act in the year of each show: official before former before alias."""
    kinds = (
        (0, "name", F.col("id") % 3 != 0, 0, 9999),
        (1, "upper(name)", F.lit(True), 0, 1994),
        (2, "sort_name", F.col("sort_name").isNotNull(), 1995, 9999),
    )
    names = None
    for rank, name, has, start, end in kinds:
        one = c.artist.filter(has).select(
            F.col("id").alias("artist_id"), F.lit(rank).alias("rank"), F.expr(name).alias("name"), F.lit(start).alias("start"), F.lit(end).alias("end")
        )
        names = one if names is None else names.unionByName(one)
    rows = c.performance.select("id", "artist_id", "y").join(names, "artist_id").filter("y BETWEEN start AND end")
    return rows.groupBy("id").agg(F.min_by("name", "rank").alias("name"))


def shows_covering(c: Catalogue, day: int = 19970514) -> DataFrame:
    """Shows whose partial date covers a day: a missing month or day covers all of them."""
    low = F.col("y") * 10000 + F.coalesce("m", F.lit(1)) * 100 + F.coalesce("d", F.lit(1))
    high = F.col("y") * 10000 + F.coalesce("m", F.lit(12)) * 100 + F.coalesce("d", F.lit(31))
    return c.performance.filter((low <= day) & (high >= day)).select("id", "artist_id")


def unique_date_matches(c: Catalogue) -> DataFrame:
    """The show of a venue on a full date, where it is the only one."""
    days = c.performance.filter("venue_id IS NOT NULL AND m IS NOT NULL AND d IS NOT NULL").groupBy("venue_id", "y", "m", "d")
    return days.agg(F.count("*").alias("n"), F.min("id").alias("id")).filter("n = 1").drop("n")


def tiered_match(c: Catalogue) -> DataFrame:
    """Suppliers to customers: by number where it is even, the others by nation to its first customer."""
    left, right = c.table("supplier").select("s_suppkey", "s_nationkey"), c.table("customer").select("c_custkey", "c_nationkey")
    first = left.filter("s_suppkey % 2 = 0").join(right, F.col("s_suppkey") == F.col("c_custkey")).select("s_suppkey", "c_custkey", F.lit(1).alias("tier"))
    rest = left.join(first.select("s_suppkey"), "s_suppkey", "left_anti")
    by_nation = right.groupBy("c_nationkey").agg(F.min("c_custkey").alias("c_custkey"))
    second = rest.join(by_nation, F.col("s_nationkey") == F.col("c_nationkey")).select("s_suppkey", "c_custkey", F.lit(2).alias("tier"))
    return first.unionByName(second)


def title_overlap(c: Catalogue, least: float = 0.5) -> DataFrame:
    """Overlap coefficient of two word sets: shared words over the smaller set."""
    a, b = (F.array_distinct(F.split(F.lower(x), " ")) for x in ("p_name", "p_type"))
    rows = c.table("part").select("p_partkey", (F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b))).alias("overlap"))
    return rows.filter(F.col("overlap") >= least)


def engineer_roles(c: Catalogue) -> DataFrame:
    """Orders of each engineer in any of three roles, once an order."""
    roles = F.array_distinct(F.array(F.col("o_custkey") % 50, F.col("o_orderkey") % 50, (F.col("o_custkey") + F.col("o_orderkey")) % 50))
    return c.table("orders").select(F.explode(roles).alias("engineer")).groupBy("engineer").agg(F.count("*").alias("n"))


def only_users(c: Catalogue) -> DataFrame:
    """Members that one act alone uses: what a view without that act leaves out."""
    rows = c.membership.groupBy("musician_id").agg(F.min("artist_id").alias("artist_id"), F.max("artist_id").alias("other"))
    return rows.filter("artist_id = other").drop("other")


def run_changes(c: Catalogue) -> DataFrame:
    """Judgements that differ between two runs."""
    before = c.table("events").select("event_id", F.col("event_type").alias("before"))
    after = c.table("events").select((F.col("event_id") - 1).alias("event_id"), F.col("event_type").alias("after"))
    return before.join(after, "event_id").filter("before <> after")


def field_report(c: Catalogue) -> DataFrame:
    """Precision, recall and share of wrong answers by field."""
    right, wrong = F.col("value") < 20, (F.col("value") >= 20) & (F.col("value") < 40)
    rows = c.table("events").groupBy(F.col("event_type").alias("field")).agg(F.count("*").alias("n"), F.count_if(right).alias("right"), F.count_if(wrong).alias("wrong"))
    answered = F.col("right") + F.col("wrong")
    return rows.select("field", "n", "right", F.try_divide("right", answered).alias("precision"), (F.col("right") / F.col("n")).alias("recall"), (F.col("wrong") / F.col("n")).alias("wrong_rate"))


def verdict_reasons(c: Catalogue) -> DataFrame:
    """Why a recording needs a look: reasons in a fixed order, joined."""
    reasons = F.concat_ws(
        ",",
        F.when(F.col("source") == "AUD", "audience"),
        F.when(F.col("location") != "library", "unpublished"),
        F.when(F.col("quality") == "C", "low quality"),
        F.when(F.col("kind") == "studio", "studio"),
    )
    return c.recording.select("id", reasons.alias("reasons"))


def shelf_pool(c: Catalogue) -> DataFrame:
    """Published live recordings that have the grade, the source, a favourite's mark or a place in a collection."""
    chosen = (F.col("quality") == "A") | F.upper(F.trim("source")).isin("SBD") | F.col("is_favorite") | (F.col("performance_id") % 4 == 0)
    return c.recording.filter("location = 'library' AND kind = 'live'").filter(chosen).select("id", "performance_id")
