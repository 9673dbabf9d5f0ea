"""Date mentions and voted dates of texts that are written from the orders' dates in ten ways."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions.dates import date_mentions, voted_dates
from cadenza.sources.catalogue import Catalogue

#: The last year that the texts can mean.
LATEST = 2026


def _texts(c: Catalogue) -> DataFrame:
    day = lambda form: F.date_format("o_orderdate", form)
    lit, next_day = F.lit, (F.dayofmonth("o_orderdate") + 1).cast("string")
    ways = [
        F.concat(lit("Recorded live "), day("MMMM d, yyyy"), lit(" at the hall")),
        F.concat(lit("transferred 2019-04-05\n"), day("M/d/yy")),
        F.concat(lit("Festival "), day("yyyy"), lit("\n"), day("MMM d"), lit("-"), next_day, lit("th")),
        day("dd.MM.yyyy"),
        F.concat(day("dd.MM.yyyy"), lit("\n"), day("MMMM yyyy")),
        F.concat(day("d MMMM"), lit(", hall, "), day("yyyy")),
        F.concat(day("yyyy-MM-"), lit("??")),
        F.concat(day("MMMM d"), lit(" or "), next_day, lit(", "), day("yyyy")),
        day("yyyy MMMM d"),
        F.concat(day("M/d/yyyy"), lit("\ncopied 2/23/1999")),
    ]
    way = F.element_at(F.array(*ways), (F.col("o_orderkey") % 10 + 1).cast("int"))
    return c.table("orders").select("o_orderkey", way.alias("text"))


def mentioned_dates(c: Catalogue) -> DataFrame:
    """Every mention, with the reading that was not taken and the role that the words around give it."""
    found = date_mentions(_texts(c), "o_orderkey", "text", LATEST)
    return found.select("o_orderkey", "i", "year", "month", "day", "end_day", "other_month", "ambiguous", "role")


def event_dates(c: Catalogue) -> DataFrame:
    """One date a text, from all its mentions."""
    return voted_dates(date_mentions(_texts(c), "o_orderkey", "text", LATEST), "o_orderkey")
