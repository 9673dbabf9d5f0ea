"""Every query against its SQL, plan shapes, and the stream's refusal rule."""

import datetime as dt

import pytest
from oracle import SF, connect, differences

from cadenza.queries import ORACLES, QUERIES
from cadenza.sources.catalogue import Catalogue


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, name):
    assert not differences(QUERIES[name](spark, SF), con, ORACLES[name])


def test_what_has_no_sql():
    # its similarity is in no database; test_blocks compares it with all pairs
    assert set(QUERIES) - set(ORACLES) == {"misspelt_names"}


def test_search_adding_a_term_only_shrinks(spark):
    one = QUERIES["search_one_term"](spark, SF).select("grp", "id")
    two = QUERIES["search_two_terms"](spark, SF).select("grp", "id")
    assert two.count() > 0 and two.subtract(one).isEmpty()


def test_visible_is_published(spark):
    c = Catalogue(spark, SF)
    hidden = c.recording.filter("location <> 'library'").select("id")
    assert QUERIES["visible_recordings"](spark, SF).join(hidden, "id").isEmpty()


def test_isotonic_is_monotone(spark):
    fitted = [r.fitted for r in QUERIES["isotonic_bins"](spark, SF).orderBy("bin").collect()]
    assert fitted == sorted(fitted)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cartesian_product(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan


def test_rights_rules_of_awkward_texts(spark):
    from cadenza.operators.rights import rules

    texts = [None, "", " \n", "NO SBDS from 5-12-18", "No sbds from 5-12-31; no sbds from 2018-13-45", "No soundboards! No soundboards.", "Stream only"]
    table = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id long, body string, kind string")
    got = sorted((r.id, r.kind, r.start) for r in rules(table, "id", "body").collect())
    # a month of 13 is no date, but its year is
    assert got == [(3, "rule", "2018-05-12"), (4, "rule", "1931-05-12"), (4, "rule", "2018-01-01"), (5, "rule", ""), (6, "review", "")]
    assert rules(table.limit(0), "id", "body").isEmpty()


def test_rate_limit_does_not_count_refusals(spark, tmp_path):
    from cadenza.streaming.play_log import EVENTS, play_stream, rate_limited

    at = dt.datetime(2024, 1, 1)
    rows = [(i, at + dt.timedelta(minutes=10 * i), 1, "view", 1.0, "{}") for i in range(14)]
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(str(tmp_path / "in"))
    query = rate_limited(play_stream(spark, str(tmp_path / "in")), most=3, seconds=3600)
    run = query.writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = {r.event_id: r.allowed for r in spark.table("limited").collect()}
    times, want = [], {}
    for i in range(14):
        times = [t for t in times if t > 10 * i - 60]
        want[i] = len(times) < 3
        times += [10 * i] * want[i]
    assert got == want
