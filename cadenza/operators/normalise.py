"""Normalised keys of names, titles, events, paths and places.

Every rule is a column expression; null stays null, blank stays blank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.operators.resolution import act_core
from cadenza.sources.catalogue import Catalogue

_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
# Countries in their short form.
COUNTRIES = {"UNITED STATES": "USA", "UNITED STATES OF AMERICA": "USA", "U.S.A.": "USA", "UNITED KINGDOM": "UK", "ENGLAND": "UK"}
# Flags that a title's bracketed segment can set.
TITLE_FLAGS = ("live", "encore", "cut", "fades in", "fades out")


def fold(x: Column) -> Column:
    """Lower case without accents (Latin letters)."""
    return F.translate(F.lower(x), _ACCENTED, _PLAIN)


def search_key(x: Column) -> Column:
    """Apostrophes are deleted, other punctuation becomes a space."""
    x = F.regexp_replace(fold(x), "['’]", "")
    return F.trim(F.regexp_replace(x, "[^\\p{L}\\p{N}]+", " "))


def name_key(x: Column) -> Column:
    """& is "and", punctuation a space, a leading article goes."""
    x = F.regexp_replace(fold(x), "&", " and ")
    return F.regexp_replace(F.trim(F.regexp_replace(x, "[^\\p{L}\\p{N}]+", " ")), "^the ", "")


def squashed(x: Column) -> Column:
    return F.replace(name_key(x), F.lit(" "), F.lit(""))


def title_key(x: Column) -> Column:
    """Bracketed ends go, then punctuation and accents."""
    x = F.regexp_replace(fold(x), "(\\s*[(\\[][^)\\]]*[)\\]])+\\s*$", "")
    return F.trim(F.regexp_replace(x, "[^\\p{L}\\p{N}]+", " "))


def event_key(x: Column) -> Column:
    """Ordinals and years go, fest is festival, and the rest is squashed."""
    x = F.regexp_replace(fold(x), "\\b[0-9]+(st|nd|rd|th)\\b|\\b(19|20)[0-9][0-9]\\b", " ")
    return F.regexp_replace(F.regexp_replace(x, "fest\\b", "festival"), "[^\\p{L}\\p{N}]+", "")


def path_key(x: Column) -> Column:
    """Relative path as a join key: forward slashes, none doubled, no leading ./, case folded."""
    return F.regexp_replace(F.regexp_replace(F.lower(x), "[\\\\/]+", "/"), "^(\\./)+", "")


def normal_names(c: Catalogue) -> DataFrame:
    """All name keys of the opening of each document."""
    opening = F.concat(F.lit("The "), F.coalesce(F.substring("text", 1, 60), F.lit("")), F.lit(" & Band (Live)"))
    rows = c.table("documents").select("doc_id", opening.alias("name"))
    name = F.col("name")
    return rows.select("doc_id", search_key(name).alias("search_key"), name_key(name).alias("name_key"), squashed(name).alias("person_key"), title_key(name).alias("title_key"))


def act_cores(c: Catalogue) -> DataFrame:
    name = F.concat(F.lit("The "), F.col("p_name"), F.when(F.col("p_partkey") % 2 == 0, " Trio").otherwise(" Band"))
    return c.table("part").select("p_partkey", act_core(name).alias("core"))


def event_keys(c: Catalogue) -> DataFrame:
    """Events whose names differ only in number, year and short form fall together."""
    name = F.concat((F.col("p_partkey") % 20).cast("string"), F.lit("th Annual "), F.col("p_name"), F.when(F.col("p_partkey") % 2 == 0, " Fest ").otherwise(" Festival "), (F.lit(1980) + F.col("p_partkey") % 30).cast("string"))
    return c.table("part").groupBy(event_key(name).alias("event_key")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_id"))


def path_keys(c: Catalogue) -> DataFrame:
    path = F.concat(F.lit(".\\"), F.regexp_replace("url", "^[a-z]+://", ""))
    return c.table("pages").select("page_id", path_key(path).alias("path_key"))


def titled(c: Catalogue) -> DataFrame:
    """Parts as titles, some with bracketed segments."""
    tail = F.element_at(F.array(*(F.lit(s) for s in ("", " (Live)", " [Encore]", " (Cut) [Fades Out]", " (Remix)"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return c.table("part").select("p_partkey", F.concat("p_name", tail).alias("title"))


def title_flags(title: Column) -> Column:
    """Flags in the bracketed segments of a title, in the order of the list."""
    inside = F.transform(F.regexp_extract_all(F.lower(title), F.lit("[(\\[]([^)\\]]*)[)\\]]"), F.lit(1)), lambda s: F.trim(s))
    return F.array_intersect(F.array(*(F.lit(x) for x in TITLE_FLAGS)), inside)


def track_flags(c: Catalogue) -> DataFrame:
    """Flags by title, with the title that is left once they are taken out."""
    rows = titled(c).select("p_partkey", "title", title_flags(F.col("title")).alias("flags"))
    return rows.filter(F.size("flags") > 0).select("p_partkey", title_key(F.col("title")).alias("title_key"), F.array_join("flags", ",").alias("flags"))


def retired_flags(c: Catalogue, retired: str = "cut") -> DataFrame:
    """Tracks that a retired flag is taken from, and what stays."""
    rows = titled(c).select("p_partkey", title_flags(F.col("title")).alias("flags")).filter(F.array_contains("flags", retired))
    return rows.select("p_partkey", F.array_join(F.array_remove("flags", retired), ",").alias("flags"))


def canonical_places(c: Catalogue) -> DataFrame:
    """Venues by canonical country: a lookup of known names, all others as they are."""
    known = F.create_map(*(F.lit(x) for pair in COUNTRIES.items() for x in pair))
    raw = F.element_at(F.array(F.lit("United States"), F.lit("U.S.A."), F.lit("England"), F.col("n_name")), (F.col("s_suppkey") % 4 + 1).cast("int"))
    rows = c.table("supplier").join(c.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.upper(F.trim(raw)).alias("raw"))
    return rows.groupBy(F.coalesce(F.try_element_at(known, F.col("raw")), F.col("raw")).alias("country")).agg(F.count("*").alias("n_venues"))


def sort_names(c: Catalogue) -> DataFrame:
    """First Last becomes Last, First; names of one word stay without a sort name."""
    name = F.initcap("p_name")
    return c.table("part").select("p_partkey", F.when(name.rlike("^\\S+(\\s+\\S+)+$"), F.regexp_replace(name, "^(.*\\S)\\s+(\\S+)$", "$2, $1")).alias("sort_name"))


def lucene_queries(c: Catalogue) -> DataFrame:
    """Typed words as an archive query: words joined by AND, a year as a range of its days."""
    typed = F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" "), (F.lit(1970) + F.col("p_partkey") % 40).cast("string"))).otherwise(F.lit("")))
    words = F.split(F.trim(typed), "\\s+")
    term = lambda w: F.when(w.rlike("^(19|20)[0-9]{2}$"), F.concat(F.lit("date:["), w, F.lit("-01-01 TO "), w, F.lit("-12-31]"))).otherwise(w)
    return c.table("part").select("p_partkey", F.array_join(F.transform(words, term), " AND ").alias("query"))


def archive_items(c: Catalogue) -> DataFrame:
    """An archive's documents (JSON) as items: typed columns, blanks as null, the date cut to a day."""
    doc = F.to_json(F.struct(F.concat(F.lit("show-"), F.col("o_orderkey")).alias("identifier"), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderpriority")).alias("title"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"), F.col("o_custkey").cast("string").alias("downloads")))
    rows = c.table("orders").select(F.from_json(doc, "identifier string, title string, date string, downloads string").alias("j"))
    return rows.select("j.identifier", F.nullif(F.trim("j.title"), F.lit("")).alias("title"), F.substring("j.date", 1, 10).alias("date"), F.col("j.downloads").cast("long").alias("downloads"))
