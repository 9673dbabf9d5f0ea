"""Readers of files, on small files."""

import io
import json
import tarfile

from cadenza.sources import files


def test_text_is_decoded_by_mark_then_utf8_then_western(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("\ufeffé".encode("utf-16-le"))
    (tmp_path / "b.txt").write_bytes("é".encode())
    (tmp_path / "c.txt").write_bytes("é".encode("cp1252"))
    got = {r.path[-5:]: r.text for r in files.text_files(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "é", "b.txt": "é", "c.txt": "é"}


def test_corpus_and_lines(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps({"id": "x", "folder_name": "f"}))
    (tmp_path / "y.json").write_text(json.dumps({"id": "y", "folder_name": "g"}))
    (tmp_path / "x.txt").write_text("one\ntwo")
    got = {r.id: r.info_text for r in files.corpus(spark, str(tmp_path), "id string, folder_name string").collect()}
    assert got == {"x": "one\ntwo", "y": None}
    (tmp_path / "l.jsonl").write_text('{"id": 1}\n{"id": 2}\n')
    assert files.jsonl(spark, str(tmp_path / "l.jsonl"), "id long").count() == 2


def test_gazetteer_and_reference(spark, tmp_path):
    (tmp_path / "g.tsv").write_text('1\tA "b"\tA b\tx,y\t1.5\t-2.0\tP\tPPL\tUS\tVA\t12\n')
    row = files.gazetteer(spark, str(tmp_path / "g.tsv")).first()
    assert (row.name, row.population, row.longitude) == ('A "b"', 12, -2.0)
    (tmp_path / "r.csv").write_text("artist,policy\n  A , yes\nA,yes\nB,\n")
    assert sorted(map(tuple, files.reference_csv(spark, str(tmp_path / "r.csv")).collect())) == [("A", "yes"), ("B", None)]


def test_replaced_table_and_folders(spark, tmp_path):
    where = str(tmp_path / "t")
    for n in (3, 5, 7):
        old = files.current_table(spark, where) if n > 3 else None
        files.replace_table(spark.range(n), where)
        assert files.current_table(spark, where).count() == n
    # what a reader began on stays until the next version but one
    assert old.count() == 5 and [p.name for p in tmp_path.iterdir()] == ["t"]
    assert sum(p.name.startswith("v-") for p in (tmp_path / "t").iterdir()) == 2
    show = tmp_path / "s" / "show"
    for disc in ("disc 1", "CD2"):
        (show / disc).mkdir(parents=True)
        (show / disc / "01.flac").write_bytes(b"xx")
    (show / "info.txt").write_bytes(b"i")
    (tmp_path / "s" / "notes").mkdir()
    (tmp_path / "s" / "notes" / "n.txt").write_bytes(b"n")
    (row,) = files.show_folders(spark, str(tmp_path / "s")).collect()
    assert (row.folder.rsplit("/", 1)[-1], row.n_audio, row.n_other, row.bytes) == ("show", 2, 1, 5)


def test_tar_of_json_lines(spark, tmp_path):
    lines = "".join(json.dumps({"id": i}) + "\n" for i in range(2500)).encode()
    with tarfile.open(tmp_path / "d.tar.xz", "w:xz") as dump:
        for name, data in (("dump/artist", lines), ("dump/other", b"{}\n")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            dump.addfile(info, io.BytesIO(data))
    rows = files.tar_json(spark, str(tmp_path / "d.tar.xz"), "artist")
    assert sorted(json.loads(r.line)["id"] for r in rows.collect()) == list(range(2500))


def test_typed_queries():
    from cadenza.operators.search import parse_query

    assert parse_query("Red Widget 1997-05") == (["red", "widget"], [(1997, 5, None)])
    assert parse_query("3/9/96 2/1/26") == ([], [(1996, 3, 9), (2026, 2, 1)])
    assert parse_query("  ") == ([], []) and parse_query("o'neil's 1975") == (["oneils"], [(1975, None, None)])


def test_queries_on_empty_tables(spark, tmp_path):
    """Queries of the newer modules give no rows, or one row of an aggregate, on empty tables."""
    from oracle import SF, TABLES

    from cadenza.queries import QUERIES

    for t in TABLES:
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).coalesce(1).write.parquet(str(tmp_path / f"{t}.parquet"))
    for name in "resolved_dates checksum_matches disc_shortfall duplicate_shows similar_names fuzzy_candidates search_mixed owed_work balanced_folds isotonic_bins latency_quantiles cross_validated".split():
        assert QUERIES[name](spark, str(tmp_path)).count() == 0, name
