"""Rows of tables that a pattern gets wrong: open cells, tables in cells, headings of all kinds."""

from cadenza.functions.tables import _Page, page_rows
from cadenza.operators.webpages import show_rows


def rows(page):
    return [[text for text, _ in cells] for kind, _, cells in _Page().read(page) if kind == "row"]


def test_open_cells_and_rows():
    assert rows("<table><tr><td>a<td>b<tr><td>c</td><td>d</table>") == [["a", "b"], ["c", "d"]]
    assert rows("<TABLE><TR><TH>x</TH></TR><tr><td>y") == [["x"], ["y"]]


def test_tables_in_cells():
    page = "<table><tr><td>left<td><table><tr><td>1<td>2<tr><td>3</table>after<td>right</table>"
    assert rows(page) == [["1", "2"], ["3"], ["left", "after", "right"]]
    # the inner table's end closes no outer row, and an inner row no outer cell
    assert rows("<table><tr><td>a<table><tr><td>b</td></tr></table></td><td>c</td></tr></table>") == [["b"], ["", "c"]]


def test_text_and_links():
    page = """<td>loose</td><!-- <tr><td>no --><a title="a > b" href='x?a=1&amp;b=2'>go <b>on</b></a> 1 &lt; 2 <script>"<tr><td>"</script><style>td{}</style>end"""
    assert _Page().read(page) == [("text", 0, [("loose", None)]), ("link", 0, [("go on", "x?a=1&b=2")]), ("text", 0, [("1 < 2 end", None)])]
    (row,) = [cells for kind, _, cells in _Page().read("<table><tr><td>a<br>b&nbsp;c <a href=one>d</a><a href=two>e</a></table>") if kind == "row"]
    assert row == [("a b c de", "one")]


def test_broken_pages_end():
    for page in ("<", "<table", "<!-- no end", "<a href='x>y", "<tr><td>", "</table></tr></td>", "<script>x", "<<<>>>", "a" * 100_000 + "<", "<table>" * 3000 + "<tr><td>x"):
        assert isinstance(_Page().read(page), list)


def test_shows_and_their_acts(spark):
    page = """<title>01-01-01</title>
    <a href="../AppData/First%20Act/">First Act</a> since 1970
    <table><tr><td>Date<td>Venue<td>Source</tr>
      <tr><td><a href="a/">08-29-79</a><td>Hall, Town<td>SBD
      <tr><td>00-00-76<td>Unknown
      <tr><td>13-40-79<td>no date
      <tr><td><a href="b.HTM?x=1">07-??-04</a><td>Barn</tr></table>
    <h2>Second Act :</h2><table><tr><td>12-31-1999<td>Club<td>AUD</table>
    <table><tr><td colspan=3>Third Act</td></tr><tr><td>01-02-03<td>Pub</table>"""
    table = spark.createDataFrame([("p", page, 1), ("q", None, 1), ("r", "", 1)], "act string, html string, n int")
    got = show_rows(table.withColumnRenamed("act", "k"), "k", "html").orderBy("n").collect()
    assert [(r.act, r.date, (r.month, r.day, r.year), r.kind, r.venue, r.source) for r in got] == [
        ("First Act", "08-29-79", (8, 29, 79), "folder", "Hall, Town", "SBD"),
        ("First Act", "00-00-76", (None, None, 76), "unlinked", "Unknown", ""),
        ("First Act", "07-??-04", (7, None, 4), "page", "Barn", ""),
        ("Second Act", "12-31-1999", (12, 31, 1999), "unlinked", "Club", "AUD"),
        ("Third Act", "01-02-03", (1, 2, 3), "unlinked", "Pub", ""),
    ]
    assert got[0].act_link == "../AppData/First%20Act/" and got[3].act_link is None
    assert page_rows(table.limit(0), "act", "html").isEmpty()
