"""Catalogue lists and counts: outer chains, conditional counts, explicit null order, first and top of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.sources.catalogue import Catalogue


def published(col: str = "location") -> Column:
    return F.col(col) == "library"


def artist_counts(c: Catalogue) -> DataFrame:
    """Every act with its published and total recordings; listed if it has published ones or none at all.

    Recordings are counted per act before the outer join, so the join's many side is one row per act.
    """
    counts = (
        c.recording.select("performance_id", "location")
        .join(c.performance.select(F.col("id").alias("performance_id"), "artist_id"), "performance_id")
        .groupBy("artist_id")
        .agg(F.count_if(published()).alias("n_published"), F.count("*").alias("n_total"))
    )
    rows = c.artist.join(counts, F.col("id") == F.col("artist_id"), "left")
    rows = rows.select("id", "name", F.coalesce("n_published", F.lit(0)).alias("n_published"), F.coalesce("n_total", F.lit(0)).alias("n_total"))
    return rows.filter((F.col("n_published") > 0) | (F.col("n_total") == 0))


def kind_counts(c: Catalogue) -> DataFrame:
    """Published recordings by kind; both kinds always there."""
    rows = c.recording.filter(published())
    return rows.agg(F.count_if(F.col("kind") == "live").alias("live"), F.count_if(F.col("kind") == "studio").alias("studio"))


def recent_recordings(c: Catalogue, limit: int = 50) -> DataFrame:
    """Newest published first, id breaks ties (a top-k report)."""
    return c.recording.filter(published()).orderBy(F.col("created_at").desc_nulls_last(), F.col("id").desc()).limit(limit).select("id", "source", "created_at")


def favourites(c: Catalogue) -> DataFrame:
    """Favourites in order of act, then date with unknown parts first; the order as a rank."""
    rows = c.recording.filter("is_favorite").join(c.performance.withColumnRenamed("id", "pid").drop("city"), F.col("performance_id") == F.col("pid"))
    rows = rows.join(c.artist.select(F.col("id").alias("aid"), F.coalesce("sort_name", "name").alias("act")), F.col("artist_id") == F.col("aid"))
    per_act = Window.partitionBy("act").orderBy(*(F.col(x).asc_nulls_first() for x in ("y", "m", "d", "id")))
    return rows.select("act", "id", "y", "m", "d", F.row_number().over(per_act).alias("place"))


def on_this_day(c: Catalogue, month: int = 7, day: int = 14) -> DataFrame:
    rows = c.performance.filter((F.col("m") == month) & (F.col("d") == day))
    return rows.join(c.recording.select(F.col("id").alias("recording_id"), "performance_id"), F.col("id") == F.col("performance_id")).select("recording_id", "artist_id", "y")


def venue_counts(c: Catalogue) -> DataFrame:
    """Shows and published recordings per venue; venues without shows stay."""
    shows = c.performance.filter("venue_id IS NOT NULL").groupBy("venue_id").agg(F.count("*").alias("n_shows"), F.min("y").alias("first_year"), F.max("y").alias("last_year"))
    taped = c.recording.filter(published()).join(c.performance.select(F.col("id").alias("performance_id"), "venue_id"), "performance_id").groupBy("venue_id").agg(F.count("*").alias("n_recordings"))
    rows = c.venue.join(shows, F.col("id") == F.col("venue_id"), "left").drop("venue_id").join(taped, F.col("id") == F.col("venue_id"), "left")
    zero = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    return rows.select("id", "name", "city", "country", zero("n_shows"), zero("n_recordings"), "first_year", "last_year")


def genre_counts(c: Catalogue) -> DataFrame:
    acts = c.artist.groupBy("genre_id").agg(F.count("*").alias("n_acts"))
    return c.genre.join(acts, F.col("id") == F.col("genre_id"), "left").select("id", "name", F.coalesce("n_acts", F.lit(0)).alias("n_acts"))


def musician_counts(c: Catalogue) -> DataFrame:
    """Recordings of a musician's acts, once per stint, and the distinct acts."""
    per_act = c.recording.select("performance_id").join(c.performance.select(F.col("id").alias("performance_id"), "artist_id"), "performance_id").groupBy("artist_id").agg(F.count("*").alias("n"))
    # an act and a musician are one row of membership, so that acts need not be told apart again
    rows = c.membership.join(per_act, "artist_id", "left")
    return rows.groupBy("musician_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_recordings"), F.count("artist_id").alias("n_acts"))


def role_counts(c: Catalogue) -> DataFrame:
    """Orders by customer, supplier and part numbers as three roles: each name once a row, whatever the roles."""
    rows = c.table("lineitem").select(F.array_distinct(F.array(F.col("l_suppkey") % 50, F.col("l_partkey") % 50, F.col("l_orderkey") % 50)).alias("names"))
    return rows.select(F.explode("names").alias("name")).groupBy("name").agg(F.count("*").alias("n"))


def top_acts_of_venue(c: Catalogue, n: int = 3) -> DataFrame:
    """The n acts with most shows at each venue, and how many acts played there."""
    per = c.performance.filter("venue_id IS NOT NULL").groupBy("venue_id", "artist_id").agg(F.count("*").alias("shows"))
    per = per.join(c.artist.select(F.col("id").alias("artist_id"), "name"), "artist_id")
    by = Window.partitionBy("venue_id")
    per = per.withColumn("place", F.row_number().over(by.orderBy(F.desc("shows"), F.lower("name"), "artist_id"))).withColumn("n_acts", F.count("*").over(by))
    return per.filter(F.col("place") <= n).select("venue_id", "place", "name", "shows", "n_acts")


def instruments(c: Catalogue) -> DataFrame:
    """Distinct words of part names per brand, in order of first appearance."""
    words = c.table("part").select("p_brand", "p_partkey", F.posexplode(F.split("p_name", " ")).alias("pos", "word"))
    first = words.groupBy("p_brand", "word").agg(F.min(F.struct("p_partkey", "pos")).alias("at"))
    listed = first.groupBy("p_brand").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("all"))
    return listed.select("p_brand", F.array_join(F.transform("all", lambda x: x["word"]), ",").alias("words"))


def show_places(c: Catalogue) -> DataFrame:
    """Place of a show: the venue's if it has one, else its own; not a coalesce."""
    rows = c.performance.join(c.venue.select(F.col("id").alias("vid"), F.col("city").alias("venue_city"), "country"), F.col("venue_id") == F.col("vid"), "left")
    return rows.select("id", F.when(F.col("venue_id").isNotNull(), F.col("venue_city")).otherwise(F.col("city")).alias("city"), "country")


def track_places(c: Catalogue) -> DataFrame:
    """Place of a track in its set; null without a set."""
    rows = c.track.filter("set_number IS NOT NULL").groupBy("recording_id", "set_number", "track_number").agg(F.count("*").alias("copies"))
    by = Window.partitionBy("recording_id", "set_number").orderBy("track_number")
    return rows.select("recording_id", "set_number", "track_number", F.row_number().over(by).alias("place"))


def first_images(c: Catalogue) -> DataFrame:
    """One of the rows of a group: primary first, then order, then id."""
    by = Window.partitionBy("o_custkey").orderBy(F.desc(F.col("o_orderstatus") == "F"), "o_orderpriority", "o_orderkey")
    return c.table("orders").withColumn("place", F.row_number().over(by)).filter("place = 1").select("o_custkey", "o_orderkey", "o_orderpriority")


def image_chain(c: Catalogue) -> DataFrame:
    """A show's image: its own, else its act's, else its venue's."""
    own = c.recording.filter("is_favorite").groupBy("performance_id").agg(F.min("id").alias("own"))
    act = first_images(c).filter(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_custkey").alias("artist_id"), F.col("o_orderkey").alias("act"))
    rows = c.performance.select("id", "artist_id", "venue_id").join(own, F.col("id") == F.col("performance_id"), "left").join(act, "artist_id", "left")
    return rows.select("id", F.coalesce("own", "act", F.when(F.col("venue_id") % 2 == 0, F.col("venue_id"))).alias("image"))


def personnel(c: Catalogue) -> DataFrame:
    """Interval join: members whose stint covers a show; a date known in part covers as a range."""
    m, d = F.col("m"), F.col("d")
    low = F.col("y") * 10000 + F.coalesce(m, F.lit(1)) * 100 + F.coalesce(d, F.lit(1))
    high = F.col("y") * 10000 + F.coalesce(m, F.lit(12)) * 100 + F.coalesce(d, F.lit(31))
    shows = c.performance.select(F.col("id").alias("performance_id"), "artist_id", low.alias("low"), high.alias("high"))
    rows = shows.join(c.membership, "artist_id").filter("start_day <= high AND end_day >= low")
    return rows.groupBy("performance_id").agg(F.countDistinct("musician_id").alias("n_members"), F.min("musician_id").alias("first_member"))
