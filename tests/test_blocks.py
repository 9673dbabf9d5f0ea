"""Block similarity against the standard library's matcher, and the join against all pairs."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from cadenza.functions.blocks import block_ratio, close_pairs, closest, ratio
from cadenza.operators.corroboration import corroborated, date_score, name_score


def reference(a, b):
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


def test_ratio_equals_the_standard_one():
    r = random.Random(1)
    for _ in range(3000):
        a, b = ("".join(r.choice("abcde"[: r.randint(1, 5)]) for _ in range(r.randint(0, 14))) for _ in "ab")
        assert ratio(a, b) == reference(a, b)
    assert ratio("", "") == 1.0 and ratio("a", "") == 0.0
    long = "".join(r.choice("ab") for _ in range(400))
    assert ratio(long, long[::-1]) == reference(long, long[::-1])


@pytest.mark.parametrize("cutoff", [0.5, 0.85, 1.0])
def test_join_loses_no_pair(spark, cutoff):
    r = random.Random(7)
    names = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 12))) for _ in range(70)]
    for n in names[:40]:
        i = r.randrange(len(n))
        names += [n[:i] + r.choice("xyz") + n[i + 1 :], n + r.choice(["", "s", " band"]), n[1:] or "q", n[::-1]]
    left, right = names[::2], names[1::2]
    table = lambda x: spark.createDataFrame([(n, 1) for n in [*x, None, "", x[0]]], "name string, n int").repartition(3)
    got = {(x.a, x.b): x.ratio for x in close_pairs(table(left), table(right), cutoff).collect()}
    want = {(a, b): s for a in set(left) for b in set(right) if (s := reference(a, b)) >= cutoff}
    assert got == pytest.approx(want)
    best = {x.a: x.ratio for x in closest(table(left), table(right), cutoff).collect()}
    assert best == pytest.approx({a: max(s for (x, _), s in want.items() if x == a) for a, _ in want})


def test_null_texts_and_empty_tables(spark):
    rows = spark.createDataFrame([("ab", None), (None, None), ("ab", "ab")], "a string, b string")
    assert sorted((x.r is None, x.r) for x in rows.select(block_ratio("a", "b").alias("r")).collect()) == [(False, 1.0), (True, None), (True, None)]
    empty = spark.createDataFrame([], "name string")
    assert close_pairs(empty, empty, 0.8).isEmpty() and closest(empty, empty, 0.8).isEmpty()


def test_scores_of_parts(spark):
    lit, no, yes = F.lit, F.lit(False), F.lit(True)
    date = lambda *x: [F.lit(p).cast("int") for p in x]
    row = spark.range(1).select(
        name_score(lit("A"), lit(None), yes, no, no).alias("known"), name_score(lit(" "), lit("B"), yes, no, no).alias("text"), name_score(lit("A"), lit("A"), yes, yes, yes).alias("all"),
        name_score(lit(None), lit(None), yes, yes, no).alias("none"), date_score(date(1990, 5, None), date(1990, 5, 5)).alias("month"),
        date_score(date(1990, 5, 5), date(1990, 5, 5)).alias("same"), date_score(date(None, None, None), date(1990, 5, 5)).alias("texts"),
    ).first()
    assert tuple(row) == (0.9, 0.55, 1.0, 0.0, 0.47, 1.0, 0.55)


def test_nothing_known(spark):
    parts = ("artist", "venue", "city", "state", "country")
    columns = "k string, " + ", ".join(f"{s}_{p} string" for s in ("tag", "text") for p in parts) + ", " + ", ".join(f"{s}_{p} int" for s in ("tag", "text") for p in ("year", "month", "day"))
    rows = spark.createDataFrame([("a", *["X"] * 5, *[None] * 5, 1990, 1, 1, None, None, None), ("b", *[None] * 16)], columns)
    acts, venues = spark.createDataFrame([], "name string"), spark.createDataFrame([], "name string, city string, state string, country string")
    assert {x.k: x.score for x in corroborated(rows, "k", acts, venues).collect()} == {"a": 70, "b": 0}
