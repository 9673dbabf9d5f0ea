"""Units of texts read by batches: lines, what neighbours tell, and rows that stand twice."""

import shutil

import pyarrow as pa
import pytest
from oracle import SF, connect, differences

from cadenza.functions import units
from cadenza.queries import ORACLES, QUERIES


def test_lines_by_blocks():
    texts = [None, "", " \n", "a\n b \r\nc", "x\n\n\n y\n \t\n\tz", "\t\n\nx", "p\n\x0b\nq\n\n\x0b\n r", "1 a\n2 b\n\n3 c\n- \n4 d"]
    found = units.Lines(pa.array(texts, pa.string()))
    got = [(t, n, b, *found.different[w]) for t, n, b, w in zip(*(x.tolist() for x in (found.text, found.number, found.block, found.which)))]
    assert got == [
        (3, 0, 0, "a", False), (3, 1, 0, "b", False), (3, 2, 0, "c", False), (4, 0, 0, "x", False), (4, 1, 1, "y", False), (4, 2, 2, "z", False), (5, 0, 0, "\t", False), (5, 1, 1, "x", False),
        (6, 0, 0, "p", False), (6, 1, 0, "\x0b", False), (6, 2, 0, "q", False), (6, 3, 1, "r", False), (7, 0, 0, "1 a", True), (7, 1, 0, "2 b", True), (7, 2, 1, "3 c", True), (7, 3, 1, "-", False), (7, 4, 1, "4 d", False),
    ]


def test_equal_lines_are_read_once(monkeypatch):
    read, plain = [], units.read_line
    monkeypatch.setattr(units, "_remembered", lambda *a: read.append(a) or plain(*a))
    found = units.Units(pa.array(["Act with Guest\nHall, May 5, 1990\n01 one\n02 two"] * 500), 2026)
    assert len(read) == 4 and len(found.form) == 500 * 7 and len(found.forms) == 7
    code, of = found.named()
    assert len(code) == 500 * 4 and [found.cores[c] for c in sorted(set(code.tolist()))] == ["act", "with", "guest", "hall"]


def test_a_batch_is_read_in_runs(monkeypatch):
    monkeypatch.setattr(units, "AT_ONCE", 10)
    batch = pa.record_batch({"k": pa.array(range(6)), "t": pa.array(["abcd", None, "efgh", "x" * 30, "yz", ""])})
    assert [part.column(0).to_pylist() for part in units.slices(batch, 1)] == [[0, 1, 2], [3], [4, 5]]


@pytest.mark.parametrize("name", ["decoded_roles", "feature_counts"])
def test_units_are_not_shuffled(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    # texts and found names are; neighbours are found on arrays, and the seven guests and halls are no keys of a join with all shows
    assert "Window" not in plan and "posexplode" not in plan and "PythonUDF" not in plan and plan.count("MapInArrow") == 2
    assert not any("guest" in row or "venue_id" in row for row in plan.split("\n") if "Exchange hashpartitioning" in row or "SortMergeJoin" in row)


@pytest.mark.parametrize("name", ["decoded_roles", "feature_counts"])
def test_rows_that_stand_twice_are_texts_of_their_own(spark, tmp_path, name):
    for table in "nation region customer supplier".split():
        shutil.copy(f"{SF}/{table}.parquet", tmp_path)
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    orders.unionAll(orders.filter("o_orderkey % 2 = 0")).write.parquet(f"{tmp_path}/orders.parquet")
    con = connect(str(tmp_path))
    con.execute(f"CREATE OR REPLACE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    assert not differences(QUERIES[name](spark, str(tmp_path)), con, ORACLES[name])


def test_features_of_a_text_count_once(spark):
    from cadenza.operators.reading import feature_rows, with_known

    texts = spark.createDataFrame([(1, "Act, act\nHall"), (2, None), (3, ""), (1, "Act"), (None, "Hall")], "id long, body string").repartition(2)
    acts, venues = spark.createDataFrame([("ACT",)], "name string"), spark.createDataFrame([("hall",), (None,), ("act",)], "name string")
    rows = feature_rows(with_known(texts, "id", "body", acts, venues), "id").collect()
    n = {f: sum(r.n for r in rows if r.feature == i) for i, f in enumerate(units.FEATURES)}
    assert (n["lib_artist"], n["lib_venue"], n["line0"], n["line1"], n["after_first"], n["w1"]) == (3, 4, 4, 1, 1, 5)
    # a name is found by its text's key, so not in a text without one; texts without units have no row
    bits = sorted((str(r.id), r.n >> units.PLACE["lib_venue"] & 1) for r in rows if r.feature is None)
    assert bits == [("1", 1), ("1", 1), ("None", 0)]
