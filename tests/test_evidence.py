"""Dates weighed by hand, calibrated labels, and what may be shared."""

import math

import pytest
from pyspark.sql import functions as F

from cadenza.operators.evidence import Model, assessed, shareable, weighed_dates

MODEL = Model(tau=0.9, margin=2.0)
COLUMNS = "show string, source string, y int, m int, d int, support int, against int"


def weigh(spark, *rows, model=MODEL):
    table = spark.createDataFrame([("s", *r, *([None] * (6 - len(r)))) for r in rows], COLUMNS)
    (out,) = weighed_dates(table, "show", model).collect()
    return out


def test_sources_that_agree(spark):
    one = weigh(spark, ("tags", 1977, 5, 8), ("folder", 1977, None, None), ("info", 1977, 5, 8, 3, 0))
    assert (one.source, one.y, one.m, one.d, one.conflict, one.label) == ("tags", 1977, 5, 8, False, "confident")
    assert one.score == pytest.approx(10 + 4 * 0.3 + 3 + 1.0) and one.margin == pytest.approx(one.score - 1) and one.logit == pytest.approx(one.score - 1)
    # the more precise one leads, whatever its source
    assert weigh(spark, ("tags", 1977, None, None), ("info", 1977, 5, 8, 0, 0)).source == "info"


def test_sources_that_contradict(spark):
    one = weigh(spark, ("tags", 1977, 5, 8), ("info", 1978, 5, 8, 0, 1))
    assert one.conflict and one.score == 10 and one.margin == pytest.approx(10 - 2.25) and one.logit == pytest.approx(10 - (2.25 + math.log(1 + math.exp(1 - 2.25))))
    two = weigh(spark, ("info", 1977, 5, 8, 0, 9), ("folder", 1978, None, None))
    assert two.source == "info" and two.score == pytest.approx(1.5) and two.label == "tentative"
    # two sources with one other date are one rival
    three = weigh(spark, ("tags", 1977, 5, 8), ("info", 1978, 1, 1, 0, 0), ("folder", 1978, 1, 1))
    assert three.logit == pytest.approx(10 - (7 + math.log(1 + math.exp(1 - 7))))


def test_weak_and_missing_dates(spark):
    assert weigh(spark, ("info", 1977, None, None, 0, 9)).label == "tentative"
    table = spark.createDataFrame([("a", "tags", None, None, None, 0, 0)], COLUMNS)
    assert weighed_dates(table, "show", MODEL).isEmpty() and weighed_dates(table.limit(0), "show", MODEL).isEmpty()


def test_calibrated_labels(spark):
    model = Model(0.8, 1.0, ((None, 1.0, 0.3), (1.0, 4.0, 0.85)), least=2.0)
    rows = spark.createDataFrame([(0, 0.0, []), (1, 1.5, []), (2, 3.0, [2.5]), (3, 3.5, []), (4, 9.0, [1.0])], "i int, score double, rivals array<double>")
    got = {r.i: (r.label, round(r.p, 6)) for r in rows.select("i", *(c.alias(n) for n, c in assessed(F.col("score"), F.col("rivals"), 0.0, model).items())).collect()}
    logit = 9 - (1 + math.log(1 + math.exp(-1)))
    assert got == {0: ("empty", 0.0), 1: ("tentative", 0.85), 2: ("tentative", 0.3), 3: ("confident", 0.85), 4: ("confident", round(1 / (1 + math.exp(-logit)), 6))}


def test_what_may_be_shared(spark):
    cases = [
        ("library", "live", False, None, None, True), ("library", "live", False, "", "Official", True), ("library", "live", False, "r", "BOOTLEG", True), ("library", "live", False, "r", "Official", False),
        ("library", "live", False, "r", None, False), ("library", "live", True, None, None, False), ("library", "studio", False, None, None, False), ("queue", "live", False, None, None, False),
        (None, "live", False, None, None, False), ("library", None, False, None, None, False), ("library", "live", None, None, None, False),
    ]
    table = spark.createDataFrame([(i, *c[:5]) for i, c in enumerate(cases)], "i int, l string, k string, o boolean, r string, s string")
    got = table.select("i", shareable(*(F.col(c) for c in "lkors")).alias("may")).collect()
    assert {r.i: r.may for r in got} == {i: c[5] for i, c in enumerate(cases)}
