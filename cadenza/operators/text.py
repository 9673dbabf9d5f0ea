"""Text understanding with built-ins: dates in several notations, source hints, flags, links, turns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.sources.archives import source_type
from cadenza.sources.catalogue import Catalogue


def parsed_dates(c: Catalogue) -> DataFrame:
    """Dates written as ISO, slashed or short year (pivot 26), read back to components."""
    iso, slash, short = (F.date_format("o_orderdate", p) for p in ("yyyy-MM-dd", "MM/dd/yyyy", "MM/dd/yy"))
    key = F.col("o_orderkey")
    text = F.when(key % 3 == 0, iso).when(key % 3 == 1, slash).otherwise(short)
    rows = c.table("orders").select("o_orderkey", F.concat(F.lit("live at "), text, F.lit(" sbd")).alias("text"))
    a = lambda i: F.regexp_extract("text", "(\\d{4})-(\\d{2})-(\\d{2})", i)
    b = lambda i: F.regexp_extract("text", "(\\d{2})/(\\d{2})/(\\d{4}|\\d{2})\\b", i)
    number = lambda x: x.try_cast("int")
    year = number(b(3))
    year = F.when(F.length(b(3)) == 2, F.when(year <= 26, 2000 + year).otherwise(1900 + year)).otherwise(year)
    return rows.select("o_orderkey", F.coalesce(number(a(1)), year).alias("y"), F.coalesce(number(a(2)), number(b(1))).alias("m"), F.coalesce(number(a(3)), number(b(2))).alias("d"))


def source_hints(c: Catalogue) -> DataFrame:
    """Source types from identifiers and source lines that are written in eight ways."""
    key = F.col("o_orderkey")
    marks = ["sbd", "x.mtx", "matrix-fm", "live", "audit", "live", "", "AUD"]
    lines = ["AUD master", "", "", "board feed > dat", "FM broadcast", "sbd + aud matrix", None, "from the radio"]
    way = (key % 8 + 1).cast("int")
    identifier = F.concat(F.lit("act"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("."), F.element_at(F.array(*map(F.lit, marks)), way))
    return c.table("orders").select("o_orderkey", source_type(identifier, F.element_at(F.array(*map(F.lit, lines)), way)).alias("source"))


def links(c: Catalogue) -> DataFrame:
    """Links of each page: how many, how many distinct, and the title."""
    hrefs = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return c.table("pages").select("page_id", F.size(hrefs).alias("n_links"), F.size(F.array_distinct(hrefs)).alias("n_distinct"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


def excerpts(c: Catalogue, size: int = 100) -> DataFrame:
    """The start of a text cut at a word, with an ellipsis where something is left out."""
    head = F.substring("text", 1, size)
    cut = F.regexp_replace(head, "\\s+\\S*\\z", "")
    return c.table("documents").select("doc_id", F.when(F.length("text") <= size, F.col("text")).otherwise(F.concat(cut, F.lit("..."))).alias("excerpt"))


def turn_statistics(c: Catalogue) -> DataFrame:
    """Turns and characters of a conversation by role, and its first role."""
    rows = c.table("conversations").groupBy("conv_id")
    return rows.agg(F.count("*").alias("n_turns"), F.count_if(F.col("role") == "user").alias("n_user"), F.sum(F.length("text")).alias("n_chars"), F.min_by("role", "turn").alias("first_role"))


def json_counts(c: Catalogue) -> DataFrame:
    """A number inside a JSON column, summed per kind, missing ones as 0."""
    k = F.get_json_object(F.coalesce("props", F.lit("{}")), "$.k").try_cast("bigint")
    return c.table("events").groupBy("event_type").agg(F.sum(F.coalesce(k, F.lit(0))).alias("k"), F.count_if(k.isNull()).alias("missing"))


def infix(c: Catalogue, q: str = "widget", limit: int = 12) -> DataFrame:
    """Autocomplete: case-insensitive infix, first names in order (a top-k report)."""
    return c.table("part").filter(F.col("p_name").ilike(f"%{q}%")).orderBy("p_name", "p_partkey").limit(limit).select("p_partkey", "p_name")


def recently_played(c: Catalogue, days: int = 7) -> DataFrame:
    """Users with a play in the last days of the log, and their last play."""
    now = c.table("events").agg(F.max("ts").alias("now"))
    rows = c.table("events").join(F.broadcast(now), F.col("ts") >= F.col("now") - F.expr(f"INTERVAL {days} DAYS"))
    return rows.groupBy("user_id").agg(F.count("*").alias("plays"), F.max("event_id").alias("last_event"))
