"""Show catalogues and folder listings on web pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.tables import page_rows
from cadenza.sources.catalogue import Catalogue

# How long a heading can be, what a folder link of an act looks like, endings of links that are no folder.
HEADING = 100
ACT_FOLDER = r"(?i)/AppData/[^/]+/?$"
PAGES = "htm html php asp flac shn mp3 wav".split()


def catalogue_date(text: Column) -> Column:
    """month, day, year of MM-DD-YY or MM-DD-YYYY, where 00 and ?? are unknown; null if it is none."""
    whole = r"^\s*([0-9]{1,2}|\?\?)-([0-9]{1,2}|\?\?)-([0-9]{2}|[0-9]{4})\s*$"
    part = lambda i: F.nullif(F.regexp_extract(text, whole, i).try_cast("int"), F.lit(0))
    month, day, year = part(1), part(2), F.regexp_extract(text, whole, 3).try_cast("int")
    possible = text.rlike(whole) & (F.coalesce(month, F.lit(1)) <= 12) & (F.coalesce(day, F.lit(1)) <= 31)
    return F.when(possible, F.struct(month.alias("month"), day.alias("day"), year.alias("year")))


def show_rows(pages: DataFrame, key: str, page: str) -> DataFrame:
    """key, n, act, act_link, date (text), month, day, year, link, venue, source, kind: every row of a table whose first cell is a date.

    The act is named by a folder link before the table, which holds until the table ends; else by the
    nearest short text or row of one cell before.  ``kind`` is folder, page (a link to no folder) or unlinked.
    """
    rows = page_rows(pages, key, page)
    rows = rows.withColumn("filled", F.filter("cells", lambda c: c["text"] != ""))
    first = F.get("cells", F.lit(0))
    rows = rows.withColumn("when", catalogue_date(first["text"]))
    is_row, dated = F.col("kind") == "row", F.col("when").isNotNull()
    only = F.get("filled", F.lit(0))["text"]
    one_cell = is_row & (F.size("filled") == 1) & ~catalogue_date(only).isNotNull()
    named = (F.col("kind") == "link") & first["href"].rlike(ACT_FOLDER) & (first["text"] != "")
    short = F.when(one_cell, only).when(F.col("kind") == "text", first["text"])
    short = F.when(F.length(short) <= HEADING, short)
    order = Window.partitionBy(key).orderBy("n")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # what is asked of a row's cells, in place of the cells
    rows = rows.select(
        key, "n", "kind", "when", named.alias("named"), short.alias("short"), one_cell.alias("one_cell"), first.alias("first"), F.get("cells", F.lit(1))["text"].alias("venue"),
        F.coalesce(F.get("cells", F.lit(2))["text"], F.lit("")).alias("source"), (is_row & dated & (F.size("cells") >= 2)).alias("listed"),
    )
    first, named, short, one_cell = F.col("first"), F.col("named"), F.col("short"), F.col("one_cell")
    rows = rows.withColumn("table", F.coalesce(F.sum((F.col("kind") == "end").cast("int")).over(before), F.lit(0)))
    # tables are numbered in page order, so that one sort serves all: the last table with a folder link before is this one
    rows = rows.withColumn("locked", F.coalesce(F.max(F.when(named, F.col("table"))).over(before) == F.col("table"), F.lit(False)))
    # loose text does not replace the name that a folder link gave, a row of one cell does
    heading = F.when(named, F.struct(first["text"].alias("act"), first["href"].alias("act_link")))
    heading = heading.otherwise(F.when(short.isNotNull() & (one_cell | ~F.col("locked")), F.struct(short.alias("act"), F.lit(None).cast("string").alias("act_link"))))
    rows = rows.withColumn("heading", heading).withColumn("heading", F.last("heading", ignorenulls=True).over(before))
    rows = rows.filter("listed")
    ending = F.lower(F.regexp_extract(F.regexp_replace(first["href"], r"[?#].*$", ""), r"\.([A-Za-z0-9]+)/?$", 1))
    kind = F.when(first["href"].isNull(), "unlinked").when(ending.isin(*PAGES), "page").otherwise("folder")
    act = F.trim(F.regexp_replace("heading.act", r"\s*[:\-]+\s*$", ""))
    return rows.select(
        key, "n", act.alias("act"), F.col("heading.act_link").alias("act_link"), first["text"].alias("date"), "when.*", first["href"].alias("link"),
        "venue", "source", kind.alias("kind"),
    )


def catalogue_shows(c: Catalogue) -> DataFrame:
    """Rows read back from one page per customer, half of them with open cells and rows, a third inside a layout table."""
    key = F.col("o_orderkey")
    date = F.when(key % 5 == 0, F.date_format("o_orderdate", "MM-'??'-yy")).otherwise(F.date_format("o_orderdate", "MM-dd-yyyy"))
    link = F.when(key % 4 == 0, date).otherwise(F.concat(F.lit('<a href="/shows/'), key.cast("string"), F.when(key % 4 == 1, ".htm").otherwise("/"), F.lit('">'), date, F.lit("</a>")))
    # a table inside the third cell, whose row has no date
    nested = F.when(key % 7 == 0, "<table><tr><td>inner<td>cell</table>").otherwise("")
    cells = [link, F.concat(F.lit("Hall &amp; Barn "), key.cast("string")), F.concat(nested, F.col("o_orderpriority"))]
    tidy = F.concat(F.lit("<TR>"), *(F.concat(F.lit("<td>"), x, F.lit("</td>")) for x in cells), F.lit("</TR>"))
    open_ = F.concat(F.lit("<tr>"), *(F.concat(F.lit("<td width='1'>"), x) for x in cells))
    row = F.when(F.col("o_custkey") % 2 == 0, tidy).otherwise(open_)
    pages = c.table("orders").groupBy("o_custkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(key, row.alias("row")))), lambda x: x["row"]), "\n").alias("rows"))
    name = F.concat(F.lit("Act "), F.col("o_custkey"))
    lead = F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit('<a href="/AppData/x'), F.col("o_custkey"), F.lit('/">'), name, F.lit("</a> more words")))
    lead = lead.when(F.col("o_custkey") % 3 == 1, F.concat(F.lit("<h2>"), name, F.lit(" :</h2>"))).otherwise(F.concat(F.lit("<table><tr><td>"), name))
    page = F.concat(F.lit("<html><title>Shows</title><script>var a = '<td>01-01-99</td>';</script>"), lead, F.lit("<table border=0><tr><th>Date<th>Venue<th>Source</tr>"), "rows", F.lit("</table>"))
    return show_rows(pages.select("o_custkey", page.alias("page")), "o_custkey", "page").drop("n")


def linked_text(c: Catalogue) -> DataFrame:
    """How many links and rows each of the given pages has."""
    rows = page_rows(c.table("pages"), "page_id", "html")
    counts = rows.groupBy("page_id").agg(F.count_if(F.col("kind") == "link").alias("n_links"), F.count_if(F.col("kind") == "row").alias("n_rows"))
    pages = c.table("pages").select("page_id").join(counts, "page_id", "left")
    return pages.select("page_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"))
