"""Names of titles, folders and files on cases made by hand."""

import pytest
from pyspark.sql import functions as F

from cadenza.functions import names


def each(spark, f, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in rows.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_title_case(spark):
    cases = {
        "dark side OF the moon": "Dark Side of the Moon", "THE END": "The End", "the JGB band": "The JGB Band", "don't stop": "Don't Stop", "o'donovan": "O'Donovan",
        "i'm so glad": "I'm so Glad", "j.d. crowe": "J.D. Crowe", "MCCOURY and mcc": "McCOURY and Mcc", "mccoury": "McCoury", "mack the knife": "Mack the Knife", "3RD street": "3rd Street",
        "(the) x-ray spex": "(The) X-Ray Spex", "": "", "élan vital": "Élan Vital", "  two   words ": "Two Words", "up on up": "Up on up", "Live At the Barn": "Live at the Barn", "42": "42",
    }
    got = dict(zip(cases, each(spark, names.title_case, list(cases))))
    assert got == cases
    assert each(spark, names.title_case, [None]) == [None]


def test_songwriters(spark):
    cases = {
        "Go On (Peter Hall)": ("Go On", "Peter Hall"), "One / Two (Maria Berg) ": ("One / Two", "Maria Berg"), "Song (Alt Take)": None, "Song (Berg/Hall)": None,
        "Song (4:59)": None, "(Maria Berg)": None, "Tuning (Peter)": None, "Song (live in Paris)": None, "Song (A B C D)": None, "Song (Pt. Two)": None, "Song": None, "": None,
    }
    title, writer = (each(spark, lambda c, i=i: names.songwriter(c)[i], list(cases)) for i in (0, 1))
    assert list(zip(title, writer)) == [want or (t, None) for t, want in cases.items()]


def test_what_folders_name(spark):
    folders = ["ab1976-05-09.aud.schoeps.nak700.t01", "x (AKG451) at853 at the mk4.SCHOEPS.schoeps", "d1 sonya ca94704x ca947041", "a [Audio-Technica] b_MBHO603a", None, ""]
    assert each(spark, names.gear, folders) == [["schoeps", "nak700"], ["AKG451", "at853", "mk4", "SCHOEPS"], [], ["Audio-Technica", "MBHO603a"], None, []]
    assert each(spark, names.named_source, ["a.sbd.x.aud-1", "fmx", "Show (FM)", None]) == ["AUD", None, "FM", None]
    seeds = ["ab1988-05-02.ec7.smith.118671.flac16", "ab1969-01-26.sbd.jones.7923.ok.shnf", "x.1999.y", "x.12.y", "12345678", "a-123_4567", None]
    assert each(spark, names.seeder_number, seeds) == [118671, 7923, None, None, None, 4567, None]


def test_safe_names(spark):
    cases = {
        "One>Two": "One - Two", "Last: X": "Last - X", "> A*B*C* <": "ABC", 'a "b" c/d\\e?': "a 'b' c-d-e", "dots... ": "dots", "con": "con_", "Nul.txt": "Nul.txt_",
        "console": "console", "as it is": "as it is", "a\x07b": "ab", "": "",
    }
    assert dict(zip(cases, each(spark, names.safe_name, list(cases)))) == cases
    assert each(spark, lambda c: names.safe_name(c, whole=False), ["E.M.D.", None]) == ["E.M.D.", ""]


def test_names_that_fit(spark):
    fit = lambda name, folder, longest: spark.range(1).select(names.fitted(F.lit(name), F.lit(folder), longest).alias("o")).first().o
    assert fit("cd1/01 Short.flac", "Act/Show", 200) == "cd1/01 Short.flac"
    assert fit("01 - The Long Act Name - Winter Songs.flac", "The Long Act/1999", 60) == "01 - Winter Songs.flac"
    cut = fit("cd1/01 - A very long title that goes on and on, and on.flac", "Folder", 45)
    assert cut == "cd1/01 - A very long title.flac" and len("Folder/" + cut) + 4 <= 45
    assert fit("abcdefghijklmnopqrstuvwxyz.flac", None, 10) == "abcdefghijkl.flac"
    assert fit("x" * 30, "f" * 300, 200) == "x" * 12


def test_years_and_dates(spark):
    rows = [(77, "show 1977", None, 1977, "text 1"), (5, None, "1905 or 2005", 2005, "inferred"), (5, "x", "in 1905", 1905, "text 2"), (26, "", "", 2026, "inferred"), (27, None, None, 1927, "inferred"), (1999, "2099", "", 1999, "written"), (77, "19775", "a1977b", 1977, "text 2"), (None, "1977", "", None, None)]
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, y int, a string, b string, want int, how string")
    year, how = names.whole_year(F.col("y"), F.col("a"), F.col("b"))
    got = table.select("i", "want", "how", year.alias("y"), how.alias("h")).orderBy("i").collect()
    assert [(g.y, g.h) for g in got] == [(g.want, g.how) for g in got]
    dates = [((1977, 5, 8), "1977-05-08"), ((1977, 5, None), "1977-05"), ((1977, None, 8), "1977"), ((None, 5, 8), None), ((0, 1, 1), None), ((1977, 12, 0), "1977-12")]
    table = spark.createDataFrame([(i, *d) for i, (d, _) in enumerate(dates)], "i int, y int, m int, d int")
    got = table.select("i", names.partial_date(F.col("y"), F.col("m"), F.col("d")).alias("o")).orderBy("i").collect()
    assert [g.o for g in got] == [w for _, w in dates]


def test_grades_and_bins(spark):
    assert each(spark, names.predicted_grade, [0.0, 50.0, 100.0, -90.0, None], "double") == [pytest.approx(x) if x is not None else None for x in (40.592, 70.372, 100.0, 0.0, None)]
    bins = [(None, 0.0, 0.1), (0.0, 1.0, 0.5), (2.0, None, 0.9)]
    assert each(spark, lambda c: names.binned(c, bins, F.lit(-1.0)), [-5.0, 0.0, 0.99, 1.5, 2.0, None], "double") == [0.1, 0.5, 0.5, -1.0, 0.9, -1.0]
