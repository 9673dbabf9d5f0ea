"""Verdicts, missing tracks, checksums and owners on rows made by hand."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from cadenza.operators.checks import checksum_entries, date_verdict, indexed_quantiles, matched_checksums, name_verdict, track_shortfall, wholly_owned


def test_verdicts_on_dates(spark):
    cases = [
        ((1977, 5, 8), (1977, 5, 8), "right"), ((1977, 5, 8), (1977, 5, None), "partial"), ((1977, 5, 8), (1977, None, None), "partial"), ((1977, 5, 8), (1977, 6, 8), "wrong"),
        ((1977, None, None), (1977, 5, None), "wrong"), ((1977, 5, None), (1977, 5, 1), "wrong"), ((1977, 5, 8), (1978, 5, 8), "wrong"), ((1977, 5, 8), (None, 5, 8), "empty"),
        ((None, 5, 8), (1977, 5, 8), None), ((1977, None, None), (1977, 0, 0), "right"), ((0, 0, 0), (1977, 5, 8), None),
    ]
    table = spark.createDataFrame([(i, *g, *s) for i, (g, s, _) in enumerate(cases)], "i int, gy int, gm int, gd int, y int, m int, d int")
    got = table.select("i", date_verdict([F.col(c) for c in ("gy", "gm", "gd")], [F.col(c) for c in ("y", "m", "d")]).alias("v")).collect()
    assert {r.i: r.v for r in got} == {i: v for i, (_, _, v) in enumerate(cases)}


def test_verdicts_on_names(spark):
    cases = [
        ("Miles", "MILES!", "right"), ("Miles Davis", "Miles Davis Quintet", "variant"), ("Phil with Bob", "Phil", "variant"), ("Bob and Friends", "Bob Band", "variant"),
        ("Blue Room", "The Blue Room Cafe", "partial"), ("Room", "Mushroom", "wrong"), ("A", "", "empty"), ("A", None, "empty"), ("", "A", None), (None, None, None), ("Band", "Trio", "wrong"),
    ]
    table = spark.createDataFrame([(i, g, s) for i, (g, s, _) in enumerate(cases)], "i int, g string, s string")
    got = table.select("i", name_verdict(F.col("g"), F.col("s"), act=True).alias("v"), name_verdict(F.col("g"), F.col("s")).alias("plain")).collect()
    assert {r.i: r.v for r in got} == {i: v for i, (_, _, v) in enumerate(cases)}
    assert {r.i: r.plain for r in got}[1] == "partial"


#: disc, number, total, discs of each file; and have, expected, unit
SHOWS = [
    ([(1, 1, None, None), (1, 2, None, None)], None),
    ([(1, 7, None, None)], (1, 7, "tracks")),
    ([(1, 1, 3, None), (1, 2, 3, None)], (2, 3, "tracks")),
    ([(1, 1, None, None), (1, 3, None, None), (2, 2, None, None), (2, 4, None, None)], None),  # one sequence
    ([(1, 1, 16, None), (1, 2, 16, None), (2, 3, 16, None)], (3, 16, "tracks")),
    ([(1, 1, None, None), (1, 2, None, None), (2, 1, None, None), (2, 3, None, None)], (4, 5, "tracks")),
    ([(1, 1, None, None), (1, 2, None, None), (2, 3, None, None), (2, 5, None, None), (3, 1, None, None)], (5, 6, "tracks")),  # disc 2 goes on
    ([(1, 1, None, None), (1, 1, None, None), (2, 3, None, None), (2, 4, None, None)], None),  # goes on after two files
    ([(9, 1, None, None)], (1, 9, "discs")),
    ([(1, 1, None, 2)], (1, 2, "discs")),
    ([(4481, 1, None, 4481)], None),
    ([(None, None, None, None), (None, 0, None, None)], None),
    ([(1, 1, 1, None), (1, 2, 1, None), (1, 3, 1, None)], None),
]


def test_missing_tracks(spark):
    rows = [(i, *f) for i, (files, _) in enumerate(SHOWS) for f in files]
    table = spark.createDataFrame(rows, "show int, disc int, number int, total int, discs int").repartition(3)
    got = {r.show: (r.have, r.expected, r.unit) for r in track_shortfall(table, "show").collect()}
    assert got == {i: want for i, (_, want) in enumerate(SHOWS) if want}


A, B, C = "a" * 32, "b" * 32, "0123456789abcdefABCDEF0123456789"


def test_lines_of_checksum_files(spark):
    text = f"; comment\n\n{A} *CD1\\01 One.flac\r\n{C}  [shntool]  Track 01 [live].flac\rTwo.WAV:{B}\n{A}\n{A} readme.txt\n{A}f x.flac\n/{B}"
    rows = checksum_entries(spark.createDataFrame([("s", text), ("n", None), ("e", "")], "k string, t string"), "k", "t").orderBy("entry").collect()
    assert [(r.entry, r.checksum, r.path) for r in rows] == [
        (0, A, "CD1/01 One.flac"), (1, C.lower(), "Track 01 [live].flac"), (2, B, "Two.WAV"), (3, A, None), (4, A, None), (5, B, None),
    ]


def match(spark, entries, paths):
    e = spark.createDataFrame([("s", i, f"c{i}", p) for i, p in enumerate(entries)], "k string, entry int, checksum string, path string")
    t = spark.createDataFrame([("s", i + 1, p) for i, p in enumerate(paths)], "k string, track int, path string")
    return {r.track: (r.checksum, r.tier) for r in matched_checksums(e, t, "k").collect()}


def test_checksums_find_their_tracks(spark):
    paths = ["CD1/01.flac", "CD2/01.flac", "CD2/02.flac", "Three.flac"]
    assert match(spark, ["cd2\\01.FLAC", "02.flac", "three.shn", "01.flac"], paths) == {2: ("c0", "path"), 3: ("c1", "name"), 4: ("c2", "stem")}
    assert match(spark, ["02.flac", "CD2/02.flac"], paths) == {3: ("c0", "name")}  # a track is taken once
    assert match(spark, [None] * 4, paths) == {i + 1: (f"c{i}", "position") for i in range(4)}
    assert match(spark, [None] * 3, paths) == {} and match(spark, [None, None, None, "x.flac"], paths) == {}


def test_owners(spark):
    shows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 9), ("c", 1), ("c", 3), ("d", 1), ("e", 4)], "show string, checksum long")
    owned = spark.createDataFrame([(1, 10), (1, 10), (2, 10), (3, 20), (4, 10), (4, 20)], "checksum long, owner long")
    n = spark.createDataFrame([(s, k) for s, k in zip("abcde", [2, 2, 2, 2, 1])], "show string, n_audio long")
    assert [tuple(r) for r in wholly_owned(shows, "show", owned, n).collect()] == [("a", 10, 2)]


@pytest.mark.parametrize("kind", ["spread", "ties", "few"])
def test_quantiles_by_place(spark, kind):
    r = random.Random(1)
    make = {"spread": lambda: r.gauss(0, 100), "ties": lambda: float(r.choice([1, 1, 1, 1, 2, 3])), "few": lambda: float(r.randint(0, 9))}[kind]
    groups = {g: [make() for _ in range(n)] for g, n in (("a", 1), ("b", 2), ("c", 7), ("d", 500))}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("a", None), ("z", None)]
    got = {x.g: x for x in indexed_quantiles(spark.createDataFrame(rows, "g string, v double").repartition(3), "g", "v", {"p90": 0.9, "p99": 0.99}, splits=10).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        vs = sorted(vs)
        place = lambda f: vs[min(len(vs) - 1, int(len(vs) * f))]  # noqa: E731, B023
        assert (got[g].median, got[g].p90, got[g].p99, got[g].most) == (statistics.median(vs), place(0.9), place(0.99), vs[-1])
        assert got[g]["mean"] == pytest.approx(statistics.fmean(vs))
