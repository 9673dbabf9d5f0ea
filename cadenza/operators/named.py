"""Names of titles, folders and files that are written from the catalogue in several ways, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions import names
from cadenza.sources.catalogue import Catalogue


def credited_titles(c: Catalogue) -> DataFrame:
    """Titles in title case, without the writer that some name at their end."""
    n = F.col("p_partkey") % 4
    written = F.concat(F.when(n == 0, F.upper("p_name")).when(n == 1, F.col("p_name")).otherwise(F.concat(F.lit("song of the "), F.col("p_name"))), F.when(n == 1, " (Maria Berg)").when(n == 2, " (Alt Take)").otherwise(""))
    title, writer = names.songwriter(written)
    return c.table("part").select("p_partkey", names.title_case(title).alias("title"), writer.alias("writer"))


def folder_marks(c: Catalogue) -> DataFrame:
    """Source, equipment and seeder's number that folder names hold."""
    key = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    rest = F.when(key % 4 == 0, ".aud.schoeps.nak700.AKG451").when(key % 4 == 1, ".sbd.miller.at853.SCHOEPS.schoeps").when(key % 4 == 2, "-fm at the ca94704x").otherwise(".x")
    folder = F.concat(F.lit("act"), day, rest, F.lit("."), key + 2100, F.lit(".flac16"))
    marks = F.nullif(F.array_join(names.gear(folder), ","), F.lit(""))
    return c.table("orders").select("o_orderkey", names.named_source(folder).alias("source"), marks.alias("gear"), names.seeder_number(folder).alias("number"))


def safe_names(c: Catalogue) -> DataFrame:
    """Track names that every file system takes, cut to fit beside their folder."""
    key = F.col("l_partkey")
    title = F.when(key % 3 == 0, F.concat(F.lit("A > "), F.col("p_name"), F.lit(": \"x?\" "))).when(key % 3 == 1, F.concat(F.lit("01 - Long Act - "), F.col("p_name"))).otherwise(F.lit("nul"))
    safe = F.concat(names.safe_name(title), F.lit(".flac"))
    rows = c.table("lineitem").join(c.table("part"), F.col("l_partkey") == F.col("p_partkey")).select("l_partkey", safe.alias("safe")).distinct()
    return rows.select("l_partkey", "safe", names.fitted(F.col("safe"), F.lit("Long Act/1999"), 34).alias("fitted"))


def whole_years(c: Catalogue) -> DataFrame:
    """Two-digit years with the century that a folder or a text tells, and the dates that they make."""
    key = F.col("o_orderkey")
    short = (F.year("o_orderdate") % 100).cast("int")
    folder = F.when(key % 3 == 0, F.concat(F.lit("act "), F.year("o_orderdate"), F.lit("-x")))
    text = F.when(key % 2 == 0, F.concat(F.lit("in "), F.year("o_orderdate") + 100, F.lit("."))).otherwise(F.concat(F.year("o_orderdate"), F.lit(" or "), F.year("o_orderdate") + 100))
    year, how = names.whole_year(short, folder, text)
    date = names.partial_date(year, F.when(key % 5 > 0, F.month("o_orderdate")), F.when(key % 4 > 0, F.dayofmonth("o_orderdate")))
    return c.table("orders").select("o_orderkey", how.alias("how"), date.alias("date"))


def graded_events(c: Catalogue) -> DataFrame:
    """Events' values as grades, and the share of the bin that a grade lies in, else its sigmoid."""
    grade = names.predicted_grade(F.col("value"))
    p = names.binned(F.col("value"), [(None, 10.0, 0.1), (10.0, 50.0, 0.5), (90.0, None, 0.95)], 1 / (1 + F.exp(-F.col("value") / 100)))
    return c.table("events").select("event_id", F.round(grade, 6).alias("grade"), F.round(p, 6).alias("p"))
