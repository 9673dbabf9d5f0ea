"""Date mentions by notation, and the vote against a pairwise count."""

import random

import pytest

from cadenza.functions.dates import date_mentions, read_dates, voted_dates

LATEST = 2026


def parts(text):
    return [(m.year, m.month, m.day) for m in read_dates(text, LATEST)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("THE CELLAR,BONN. MARCH 11,1982", [(1982, 3, 11)]),
        ("April 1974", [(1974, 4, None)]),
        ("1963", [(1963, None, None)]),
        ("Date of 1972 is a guess", [(1972, None, None)]),
        ("June 09,1991", [(1991, 6, 9)]),
        ("1996-11-??\n(nov, 1996)", [(1996, 11, None), (1996, 11, None)]),
        ("02-??-1953", [(1953, 2, None)]),
        ("October 7-8, 1979", [(1979, 10, 7)]),
        ("1966-03-14 thru 1966-03-16", [(1966, 3, 14)]),
        ("March 6th or 7th, 2004", [(2004, 3, None)]),
        ("1976 October 18 [though the host says 1977 December 20]", [(1976, 10, 18), (1977, 12, 20)]),
        ("Lund, Sweden, 28.August 1979", [(1979, 8, 28)]),
        ("4.30.2002", [(2002, 4, 30)]),
        ("05-30-1970", [(1970, 5, 30)]),
        ("??/??/1964", [(1964, None, None)]),
        ("??/05/1964", [(1964, None, None)]),
        ("??/??/??", []),
        ("2017 11 14, Oslo", [(2017, 11, 14)]),
        ("1975 12 songs", [(1975, None, None)]),
        ("81-04-20", [(1981, 4, 20)]),
        ("May 5 '83", [(1983, 5, 5)]),
        ("6/18/27", [(1927, 6, 18)]),
        ("6/18/26", [(2026, 6, 18)]),
        ("31/31/1990", []),
        ("1990-02-30", []),
        ("at 19:45 and 1990:1", []),
        ("nothing", []),
        ("", []),
        (None, []),
    ],
)
def test_notations(text, want):
    assert parts(text) == want


def test_spans_ranges_and_roles():
    text = "Transferred FEB 18,2002\nSeeded 3/4/2003\nLive: August 15-17, 1983"
    found = read_dates(text, LATEST)
    assert [text[m.start : m.end] for m in found] == ["FEB 18,2002", "3/4/2003", "August 15-17, 1983"]
    assert [m.role for m in found] == ["handling", "handling", "event"]
    assert found[2].end_day == 17 and read_dates("1965-03-14 to 1965-03-16", LATEST)[0].end_day == 16


def test_numeric_dates_keep_their_other_reading():
    (one,) = read_dates("5/6/1983", LATEST)
    assert (one.month, one.day, one.other_month, one.other_day, one.ambiguous) == (5, 6, 6, 5, False)
    assert parts("5/6/1983\nJune 5, 1983")[0] == (1983, 6, 5)  # the month written elsewhere decides
    assert parts("5/6/1983\nMay 1983")[0] == (1983, 5, 6)


def _pairwise(mentions):
    """The vote by comparing all pairs."""
    usable = [m for m in mentions if m.role != "handling"]
    known = lambda m: [(m.year, m.month, m.day)[i] for i in range(3)]
    size = lambda m: sum(x is not None for x in known(m))

    def agree(a, b):
        both = [(x, y) for x, y in zip(known(a), known(b)) if x is not None and y is not None]
        return bool(both) and all(x == y for x, y in both)

    rated = []
    for i, m in enumerate(mentions):
        if m not in usable or not size(m):
            continue
        score = 10 * size(m) + 3 * sum(agree(m, o) for o in usable if o is not m)
        if m.year and any(o.year and o.year != m.year and size(o) > 1 for o in usable if o.start < m.start):
            score -= 15
        rated.append((score, -i, m))
    if not rated:
        return None
    rated.sort(key=lambda r: r[:2], reverse=True)
    lead = rated[0][2]
    y, m, d = known(lead)
    if y is None:
        y = next((o.year for _, _, o in rated if o.year and (m is None or o.month in (None, m)) and (d is None or o.day in (None, d))), None)
    elif m is None:
        m, d = next(((o.month, o.day) for _, _, o in rated if o.month and o.year is None), (None, d))
    return y, m, d


def test_vote_equals_the_pairwise_one(spark):
    r = random.Random(5)
    texts = []
    for key in range(120):
        lines = []
        for _ in range(r.randint(0, 6)):
            y, m, d = r.choice([1983, 1984, 1999]), r.choice(["June", "July"]), r.randint(1, 3)
            lines.append(r.choice([f"{y}", f"{m} {d}", f"{m} {d}, {y}", f"{m} {y}", f"{d}/{d + 1}/{y}", f"uploaded {m} {d}, {y}", "no date"]))
        texts.append((key, "\n".join(lines)))
    table = spark.createDataFrame([*texts, (900, None), (901, "")], "key long, text string")
    got = {x.key: (x.year, x.month, x.day) for x in voted_dates(date_mentions(table, "key", "text", LATEST), "key").collect()}
    want = {k: v for k, t in texts if (v := _pairwise(read_dates(t, LATEST))) is not None}
    assert got == want and len(want) > 80


def test_dates_of_an_empty_table_and_clashing_names(spark):
    table = spark.createDataFrame([], "k string, text string, i int")
    assert voted_dates(date_mentions(table, "k", "text"), "k").isEmpty()
    one = spark.createDataFrame([("a", "May 5, 1990", 7)], "k string, text string, i int")
    assert [(x.k, x.i, x.year) for x in date_mentions(one, "k", "text").collect()] == [("a", 0, 1990)]
