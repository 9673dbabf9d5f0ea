"""Queries whose work must not grow faster than their tables, on rows made by hand."""

from oracle import SF, connect, differences

from cadenza.queries import ORACLES, QUERIES


def test_chains_are_not_bounded_by_a_row_limit(spark):
    from cadenza.operators.resolution import ancestors

    spark.conf.set("spark.sql.cteRecursionRowLimit", "100")
    try:
        assert not differences(QUERIES["area_chain"](spark, SF), connect(SF), ORACLES["area_chain"])
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
    # 9 and 8 go round in a circle, 2 stands twice, 7 leads out of the table
    area = spark.createDataFrame([(1, None), (2, 1), (2, 1), (3, 2), (9, 8), (8, 9), (5, 7)], "id long, parent long")
    got = {r.id: (r.n_above, r.top) for r in ancestors(area, 4).collect()}
    assert got == {2: (2, 1), 3: (3, 1), 9: (4, 8), 8: (4, 8), 5: (1, 7)}


def test_rules_of_a_long_sentence(spark):
    import time

    from cadenza.operators.rights import rules

    texts = ["no " + "matrix " * 150 + "since 2018-05-12", "no " + "matrix " * 150 + "since 2018-05-12", "matrix " * 150]
    table = spark.createDataFrame(list(enumerate(texts)), "id long, body string")
    began = time.perf_counter()
    got = sorted((r.id, r.kind, r.start) for r in rules(table, "id", "body").collect())
    # a rule is looked for once a sentence, not for each word again
    assert time.perf_counter() - began < 30
    assert got == [(0, "rule", "2018-05-12"), (1, "rule", "2018-05-12")]


def test_close_pairs_of_many_names_that_are_not_alike(spark):
    import random
    import time

    from cadenza.functions.blocks import close_pairs

    r = random.Random(3)
    names = ["".join(r.choice("abcdefghijklmnop") for _ in range(16)) for _ in range(20_000)]
    table = spark.createDataFrame([(n, n[:14] + "#" + n[15:]) for n in names], "name string, typo string").repartition(4)
    began = time.perf_counter()
    got = {(x.a, x.b) for x in close_pairs(table.selectExpr("typo AS name"), table, 0.85).collect()}
    # names of sixteen letters that share a few runs by chance are not compared
    assert time.perf_counter() - began < 45
    assert got == {(n[:14] + "#" + n[15:], n) for n in names}


def _shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_units_of_a_text_stay_together(spark):
    from cadenza.operators.reading import units

    texts = spark.createDataFrame([(1, "Act\nHall, May 5, 1990\n\n01 one\n02 two\n\n03 lone"), (2, None), (3, "1 a\nx\n2 b")], "id long, body string")
    found = units(texts, "id", "body")
    # neighbouring lines and dates of lines are found where the text is
    assert _shuffles(found) == 0
    got = sorted((r.id, r.line, r.pos, r.kind, r.text) for r in found.collect())
    assert got == [
        (1, 0, 0, "seg", "Act"), (1, 1, 0, "seg", "Hall"), (1, 1, 1, "date", "May 5, 1990"), (1, 2, 0, "track", "01 one"), (1, 3, 0, "track", "02 two"), (1, 4, 0, "track", "03 lone"),
        (3, 0, 0, "seg", "1 a"), (3, 1, 0, "seg", "x"), (3, 2, 0, "seg", "2 b"),
    ]


def test_search_keeps_the_best_of_a_group_as_rows_are_read(spark):
    plan = QUERIES["search_groups"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    # four groups, none of them sorted whole; names are graded below the joins, so that no recording carries one
    assert plan.count("TakeOrderedAndProject") == 4
    joined = plan.split("TakeOrderedAndProject")[1]
    assert "sort_name" not in joined.split("Join")[0]


def test_votes_of_a_text_take_one_shuffle(spark):
    from cadenza.functions.dates import date_mentions, voted_dates

    texts = spark.createDataFrame([(1, "May 5, 1990\n1990\nMay 5"), (2, "no date")], "id long, body string")
    votes = voted_dates(date_mentions(texts, "id", "body", 2026), "id")
    assert _shuffles(votes) == 1
    assert [(r.id, r.year, r.month, r.day) for r in votes.collect()] == [(1, 1990, 5, 5)]


def test_checksums_of_a_show_take_one_shuffle(spark):
    from cadenza.operators.checks import matched_checksums

    entries = spark.createDataFrame([(1, 0, "c0", "a/1.flac"), (1, 1, "c1", "B.flac"), (2, 0, "c2", None), (3, 0, "c3", "x.flac"), (None, 0, "c4", None)], "k long, entry int, checksum string, path string")
    tracks = spark.createDataFrame([(1, 7, "A\\1.flac"), (1, 8, "b.flac"), (1, 9, "c/b.flac"), (2, 5, None), (4, 1, "y"), (None, 1, None)], "k long, track int, path string")
    found = matched_checksums(entries, tracks, "k")
    assert _shuffles(found) <= 2
    assert sorted(map(tuple, found.collect())) == [(1, 7, "c0", "path"), (1, 8, "c1", "path"), (2, 5, "c2", "position")]


def test_rows_of_a_page_are_sorted_once(spark):
    from cadenza.operators.webpages import show_rows

    page = '<a href="/AppData/x/">A</a><table><tr><td>01-02-90<td>H</tr></table>loose<table><tr><td>01-03-90<td>I</tr></table>'
    found = show_rows(spark.createDataFrame([(1, page)], "id long, page string"), "id", "page")
    assert found._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1
    assert sorted((r.act, r.act_link, r.date, r.venue) for r in found.collect()) == [("A", "/AppData/x/", "01-02-90", "H"), ("loose", None, "01-03-90", "I")]


def test_members_are_found_without_their_days(spark):
    assert "l_shipdate" not in QUERIES["derived_sets"](spark, SF)._jdf.queryExecution().executedPlan().toString().split("musician")[-1].split("genre")[0]
    assert "count(distinct" not in QUERIES["musician_counts"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_a_worker_holds_few_pages_at_once(spark):
    from cadenza.functions.tables import PAGES, page_rows

    rows = page_rows(spark.range(0, 100, 1, 1).selectExpr("id", "'<p>a<p>b' AS page"), "id", "page")
    assert PAGES <= 100 and rows.count() == 200
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
