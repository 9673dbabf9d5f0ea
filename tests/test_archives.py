"""Dumps and pages in batches and as streams, kept listings, and the connector."""

import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from cadenza.sources.archives import Archive, Listings, compiled_query, register, source_type


def dump(path, members):
    with tarfile.open(path, "w:xz") as out:
        for name, text in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(text.encode())
            out.addfile(info, io.BytesIO(text.encode()))


def test_dumps_in_batches(spark, tmp_path):
    register(spark)
    dump(tmp_path / "2024-a.tar.xz", {"mb/artist": '{"id": 1}\nno json\n  {"id": 2}\n', "mb/label": '{"id": 9}\n', "README": "{x"})
    dump(tmp_path / "2024-b.tar.xz", {"mb/artist": '{"id": 3}'})
    (tmp_path / "other.txt").write_text("x")
    rows = spark.read.format("archive_dump").option("entity", "artist").load(str(tmp_path)).collect()
    assert sorted((r.archive, r.number, json.loads(r.line)["id"]) for r in rows) == [("2024-a.tar.xz", 0, 1), ("2024-a.tar.xz", 2, 2), ("2024-b.tar.xz", 0, 3)]
    assert spark.read.format("archive_dump").load(f"file://{tmp_path}").count() == 5
    assert spark.read.format("archive_dump").load(str(tmp_path / "none")).isEmpty()


@pytest.mark.parametrize("kind", ["archive_dump", "archive_pages"])
def test_a_restart_reads_nothing_twice(spark, tmp_path, kind):
    register(spark)
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()

    def add(i):
        if kind == "archive_dump":
            dump(folder / f"d{i}.tar.xz", {"x": f'{{"n": {i}}}\n{{"n": {i}}}\n'})
        else:
            (folder / f"p{i}.json").write_text(json.dumps({"items": [{"n": i}, {"n": i}]}))

    for new in ([1, 2], [], [3]):
        for i in new:
            add(i)
        stream = spark.readStream.format(kind).load(str(folder))
        run = stream.writeStream.format("json").option("path", str(out)).option("checkpointLocation", str(tmp_path / "cp")).trigger(once=True).start()
        run.awaitTermination()
    text = "line" if kind == "archive_dump" else "item"
    got = [json.loads(r[text])["n"] for r in spark.read.json(str(out)).collect()]
    assert sorted(got) == [1, 1, 2, 2, 3, 3]


def test_pages_that_are_broken(spark, tmp_path):
    register(spark)
    for i, text in enumerate(['{"items": [{"a": 1}]}', "{", "[]", '{"items": null}', ""]):
        (tmp_path / f"p{i}.json").write_text(text)
    assert [tuple(r) for r in spark.read.format("archive_pages").load(str(tmp_path)).collect()] == [("p0.json", 0, '{"a": 1}')]


def test_listings_are_kept_for_a_while(spark):
    now, loads = [0.0], []
    kept = Listings(300, clock=lambda: now[0])

    def load():
        loads.append(1)
        return spark.range(2)

    a = kept.get(("list", 1), load)
    now[0] = 299
    assert kept.get(("list", 1), load) is a and len(loads) == 1
    now[0] = 300
    assert kept.get(("list", 1), load).count() == 2 and len(loads) == 2 and len(kept.kept) == 1


def test_queries_and_sources(spark):
    ask = {"dark star": "dark AND star", "1977": "date:[1977-01-01 TO 1977-12-31]", "x 1976-02": "x AND date:[1976-02-01 TO 1976-02-29]", "1977-05-08": "date:[1977-05-08 TO 1977-05-08]", "1977-13": "1977\\-13", "a:b (c)": "a\\:b AND \\(c\\)", " ": None}
    rows = spark.createDataFrame([(k,) for k in ask], "q string").select("q", compiled_query(F.col("q")).alias("c")).collect()
    assert {r.q: r.c for r in rows} == ask
    told = {("gd77.sbd.x", "AUD master"): "SBD", ("gd77", "SBD + AUD matrix"): "MTX", ("a.fm-b", ""): "FM", ("x", "board feed"): "SBD", ("x", "radio"): "FM", ("x", "audience tape"): "AUD", ("audit", "aboard"): None, (None, None): None}
    rows = spark.createDataFrame(list(told), "i string, t string").select("i", "t", source_type(F.col("i"), F.col("t")).alias("s")).collect()
    assert {(r.i, r.t): r.s for r in rows} == told


def test_connector(spark):
    items = spark.createDataFrame([(f"i{n}", f"Show {n}", "The Band" if n % 2 else None, f"19{70 + n}-05-08", f"2020-01-{10 + n}", n) for n in range(7)], "id string, title string, artist string, date string, added string, downloads int")
    files = spark.createDataFrame(
        [("i1", "b.flac", "F", 2, "m", True, False), ("i1", "a.FLAC", "F", 1, "m", True, False), ("i1", "a.mp3", "M", 1, "m", False, False), ("i1", "x.shn", "S", 1, "m", True, False), ("i1", "info.txt", "T", 1, "m", True, False), ("i1", "z.flac", "F", 1, "m", True, True), ("i2", "q.shn", "S", 1, "m", True, False)],
        "id string, name string, format string, size long, md5 string, original boolean, private boolean",
    )
    archive = Archive(items, files, page_rows=3)
    assert [(r.id, r.more) for r in archive.recent().collect()] == [("i6", True), ("i5", True), ("i4", True)]
    assert [(r.id, r.more) for r in archive.recent(3, "oldest").collect()] == [("i6", False)]
    assert [r.id for r in archive.search("BAND 1973-05").collect()] == ["i3"] and archive.search("band 1974").isEmpty()
    assert [f.name for f in archive.item("i1").first().files] == ["a.FLAC", "b.flac", "info.txt", "x.shn"]
    assert archive.item("i6").first().files is None and archive.item("none").isEmpty()
    assert sorted((r.id, r.name) for r in archive.download_plan().collect()) == [("i1", "a.FLAC"), ("i1", "b.flac"), ("i1", "info.txt"), ("i2", "q.shn")]
