"""How well a show's tags and its info text bear each other out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.blocks import alike, close_pairs, closest
from cadenza.sources.catalogue import Catalogue

# Weights of the parts, what presence, a known name and agreement count, and a track's points.
WEIGHTS = {"artist": 28, "date": 27, "venue": 20, "city": 12, "state": 8, "country": 5}
TAG, TEXT, KNOWN, AGREED = 0.70, 0.55, 0.20, 0.10
DATE_TAG, DATE_TEXT, DATE_AGREED = 0.70, 0.55, 0.30
POINTS = {"confirmed": 1.0, "tag_only": 0.75, "text_only": 0.6, "conflict": 0.55, "missing": 0.0}
CUTOFF = 0.85


def _real(value: Column) -> Column:
    return F.coalesce(F.trim(value) != "", F.lit(False))


def agree(a: Column, b: Column) -> Column:
    """Both present, and alike in title case."""
    return _real(a) & _real(b) & F.coalesce(alike(F.initcap(a), F.initcap(b), CUTOFF), F.lit(False))


def name_score(tag: Column, text: Column, tag_known: Column, text_known: Column, agreed: Column) -> Column:
    """0 to 1 of one named part."""
    base = F.when(_real(tag), TAG).when(_real(text), TEXT).otherwise(0.0)
    known = (_real(tag) & F.coalesce(tag_known, F.lit(False))) | (_real(text) & F.coalesce(text_known, F.lit(False)))
    return F.round(F.least(F.lit(1.0), base + F.when(known, KNOWN).otherwise(0.0) + F.when(agreed, AGREED).otherwise(0.0)), 2)


def _precision(y: Column, m: Column, d: Column) -> Column:
    there = lambda c: F.coalesce(c, F.lit(0)) != 0
    return F.when(there(d), 3).when(there(m), 2).when(there(y), 1).otherwise(0)


def date_score(tag: list[Column], text: list[Column]) -> Column:
    """0 to 1 of a date, by its precision; both whole and equal add to it."""
    a, b = _precision(*tag), _precision(*text)
    base = F.when(a > 0, a / 3.0 * DATE_TAG).when(b > 0, b / 3.0 * DATE_TEXT).otherwise(0.0)
    same = (a == 3) & (b == 3) & (tag[0] == text[0]) & (tag[1] == text[1]) & (tag[2] == text[2])
    return F.round(F.least(F.lit(1.0), base + F.when(same, DATE_AGREED).otherwise(0.0)), 2)


def track_state(tag: Column, text: Column, agreed: Column) -> Column:
    """State of one track's title."""
    return F.when(_real(tag) & _real(text), F.when(agreed, "confirmed").otherwise("conflict")).when(_real(tag), "tag_only").when(_real(text), "text_only").otherwise("missing")


def corroborated(scans: DataFrame, key: str, acts: DataFrame, venues: DataFrame) -> DataFrame:
    """key, a score (0 to 1) for each part, and score (0 to 100): one row per scan.

    ``scans`` has, for tag and text, the columns ``tag_artist``, ``text_artist``, and so on for venue, city, state and
    country, and year, month and day.  ``acts`` has ``name``; ``venues`` name, city, state and country, one row a name.
    A place is known if it agrees with the venue that the tag names, or else the text.
    """
    rows = scans
    titled = lambda c: F.initcap(F.trim(F.col(c)))
    for part, known in (("artist", acts), ("venue", venues)):
        asked = scans.select(titled(f"tag_{part}").alias("name")).unionByName(scans.select(titled(f"text_{part}").alias("name")))
        names = known.select(F.initcap("name").alias("name"))
        found = closest(asked, names, CUTOFF).select("a", "b")
        for side in ("tag", "text"):
            match = found.select(F.col("a").alias("a_"), F.col("b").alias(f"{side}_{part}_is"))
            rows = rows.join(match, titled(f"{side}_{part}") == F.col("a_"), "left").drop("a_")
    places = venues.select(F.initcap("name").alias("venue_is"), *(F.col(c).alias(f"of_{c}") for c in ("city", "state", "country")))
    rows = rows.withColumn("venue_is", F.coalesce("tag_venue_is", "text_venue_is")).join(places, "venue_is", "left")
    scores = {}
    for part in ("artist", "venue"):
        tag, text = F.col(f"tag_{part}"), F.col(f"text_{part}")
        scores[part] = name_score(tag, text, F.col(f"tag_{part}_is").isNotNull(), F.col(f"text_{part}_is").isNotNull(), agree(tag, text))
    for part in ("city", "state", "country"):
        tag, text, of = F.col(f"tag_{part}"), F.col(f"text_{part}"), F.col(f"of_{part}")
        scores[part] = name_score(tag, text, agree(tag, of), agree(text, of), agree(tag, text))
    scores["date"] = date_score(*([F.col(f"{side}_{c}") for c in ("year", "month", "day")] for side in ("tag", "text")))
    rows = rows.select(key, *(s.alias(part) for part, s in scores.items()))
    total = sum((F.col(part) * w for part, w in WEIGHTS.items()), F.lit(0.0))
    return rows.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), F.rint(F.round(total, 6)))).cast("int"))


def track_scores(tracks: DataFrame, key: str) -> DataFrame:
    """key, a count for each state and score (0 to 100) of the tracks (key, tag_title, text_title)."""
    rows = tracks.withColumn("state", track_state(F.col("tag_title"), F.col("text_title"), agree(F.col("tag_title"), F.col("text_title"))))
    points = sum((F.when(F.col("state") == s, p).otherwise(0.0) for s, p in POINTS.items()), F.lit(0.0))
    counts = [F.count_if(F.col("state") == s).alias(s) for s in POINTS]
    return rows.groupBy(key).agg(*counts, F.rint(F.round(100 * F.sum(points) / F.count("*"), 6)).cast("int").alias("score"))


def _typo(text: Column) -> Column:
    """One letter changed near the end."""
    return F.concat(F.substring(text, F.lit(1), F.length(text) - 2), F.lit("#"), F.substring(text, F.length(text), F.lit(1)))


def _acts(c: Catalogue) -> DataFrame:
    """Names of sixteen letters that are not alike."""
    name = F.translate(F.substring(F.md5("c_name"), 1, 16), "0123456789", "ghijklmnop")
    return c.table("customer").select("c_custkey", F.initcap(name).alias("name"))


def _scans(c: Catalogue) -> DataFrame:
    key = F.col("o_orderkey")
    acts = _acts(c).withColumnsRenamed({"c_custkey": "o_custkey", "name": "c_name"})
    halls = c.venue.select((F.col("id") - 1).alias("hall"), F.col("name").alias("v"), F.col("city").alias("c"), F.col("state").alias("s"), F.col("country").alias("l"))
    rows = c.table("orders").withColumn("hall", key % 7).join(acts, "o_custkey").join(halls, "hall")
    none = F.lit(None).cast("string")
    return rows.select(
        "o_orderkey",
        F.when(key % 2 == 0, F.col("c_name")).alias("tag_artist"), F.when(key % 3 == 0, _typo(F.col("c_name"))).when(key % 3 == 1, "Quite Another Band").alias("text_artist"),
        F.when(key % 5 > 0, F.col("v")).otherwise("").alias("tag_venue"), F.when(key % 4 == 0, F.upper("v")).alias("text_venue"),
        F.when(key % 5 > 1, F.col("c")).alias("tag_city"), F.when(key % 2 == 0, F.col("c")).otherwise("Elsewhere").alias("text_city"),
        none.alias("tag_state"), F.col("s").alias("text_state"), F.when(key % 6 == 0, F.col("l")).alias("tag_country"), none.alias("text_country"),
        F.year("o_orderdate").alias("tag_year"), F.when(key % 4 > 0, F.month("o_orderdate")).alias("tag_month"), F.when(key % 4 > 1, F.dayofmonth("o_orderdate")).alias("tag_day"),
        F.year("o_orderdate").alias("text_year"), F.month("o_orderdate").alias("text_month"), F.when(key % 3 == 0, F.dayofmonth("o_orderdate")).alias("text_day"),
    )


def corroboration(c: Catalogue) -> DataFrame:
    return corroborated(_scans(c), "o_orderkey", _acts(c).select("name"), c.venue.select("name", "city", "state", "country"))


def track_corroboration(c: Catalogue) -> DataFrame:
    """Titles by part, of which the text has some other, some shortened by a letter, some none."""
    title, n = F.col("p_name"), F.col("l_partkey") % 5
    rows = c.table("lineitem").join(c.table("part"), F.col("l_partkey") == F.col("p_partkey"))
    text = F.when(n == 0, title).when(n == 1, "zzzz").when(n == 2, F.upper(title))
    return track_scores(rows.select("l_orderkey", F.when(n != 2, title).alias("tag_title"), text.alias("text_title")), "l_orderkey")


def misspelt_names(c: Catalogue) -> DataFrame:
    """The part names that each misspelt one is close to."""
    names = c.table("part").select(F.col("p_name").alias("name"))
    return close_pairs(names.select(_typo(F.col("name")).alias("name")), names, CUTOFF)
