"""Clustering, Merkle manifest and suffix order against brute force, with nulls, ties, repeated rows, textual ids and empty tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.llm.centroids import Bounded, clusters, integer_vectors, squared
from cadenza.llm.merkle import FIELDS, fold, leaf_hash, manifest, proof
from cadenza.llm.suffix_array import repeated_spans, repeated_windows


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- suffix order


def repeats(texts, window):
    """(bytes, spans, digest of the rest) of each text, window by window."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + window] for d in data for i in range(len(d) - window + 1))
    out = []
    for d in data:
        gone = bytearray(len(d) + 1)
        for i in range(len(d) - window + 1):
            if seen[d[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        spans, start = [], None
        for i, g in enumerate(gone):
            if g and start is None:
                start = i
            if not g and start is not None:
                spans.append((start, i))
                start = None
        out.append((len(d), spans, hashlib.sha256(bytes(b for b, g in zip(d, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("seed", range(8))
def test_column_wise_construction(seed):
    r = random.Random(seed)
    window = r.choice([3, 6, 9])
    strings = [bytes(r.choice(b"abcd"[: r.randint(1, 4)]) for _ in range(r.randint(window, 120))) for _ in range(r.randint(1, 14))]
    found, classes = repeated_windows(strings, window)
    seen = Counter(s[i : i + window] for s in strings for i in range(len(s) - window + 1))
    names = {}
    for row, s in enumerate(strings):
        for i in range(found.shape[1]):
            inside = i <= len(s) - window
            assert found[row, i] == (inside and seen[s[i : i + window]] > 1)
            assert names.setdefault(classes[row, i], s[i : i + window]) == s[i : i + window] if inside else classes[row, i] == -1
    assert len(names) == len(seen)


def test_stopping_early_changes_nothing():
    """Strings aligned at a point: the same windows with and without stops."""
    r = random.Random(3)
    point, strings, tails = b"<<anchor>>", [], []
    for _ in range(40):
        left = bytes(r.choice(b"ab") for _ in range(r.randint(10, 20)))
        right = bytes(r.choice(b"ab") for _ in range(r.randint(10, 20)))
        strings.append((b"ababababab" if r.random() < 0.5 else left) + point + (b"babababababab" if r.random() < 0.5 else right))
        tails.append(len(strings[-1]) - strings[-1].index(point))
    window = 24
    # only windows that hold the whole point are equal at equal distances; others need no stop to be told apart
    plain, _ = repeated_windows(strings, window)
    quick, _ = repeated_windows(strings, window, np.array(tails))
    for row, s in enumerate(strings):
        at = s.index(point)
        inside = [i for i in range(len(s) - window + 1) if i <= at and i + window >= at + len(point)]
        assert plain[row, inside].tolist() == quick[row, inside].tolist()


def _texts():
    r = random.Random(11)
    words = ["ab", "cde", "fghi", "ü", "漢字", "x"]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage, base = prose(30), prose(60)
    edited = base[:70] + "#" + base[71:]
    return [
        base, base, edited, base[:40] + "?" + base[41:], None, "", "short", "short", prose(30) + passage + prose(20), passage,
        prose(10) + passage[5:], "a" * 300, "ab " * 90, prose(3000), None, prose(30) + passage + prose(20), "aaaa" * 5,
    ]


@pytest.mark.parametrize("cell", [900, 2])
def test_repeated_spans(spark, cell):
    texts = _texts()
    rows = [(None if i == 3 else f"id{i // 2}", t, "x", i) for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "doc_id string, text string, digest string, t int").repartition(3)
    got = repeated_spans(table, window=40, gram=12, cell=cell).collect()
    mine = Counter((r.doc_id, r.n_bytes, tuple((s.start, s.end) for s in r.spans), r.kept_sha256) for r in got)
    want = Counter((i, n, tuple(s), h) for (i, *_), (n, s, h) in zip(rows, repeats(texts, 40)))
    assert mine == want
    assert repeated_spans(table.limit(0), window=40, gram=12).isEmpty()


# --- Merkle manifest


def trees(rows, fanout):
    """doc -> (leaf, subroot, root, steps), node by node; rows are dicts."""
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"

    def climb(hashes):
        paths, level, of = [[] for _ in hashes], list(hashes), [[i] for i in range(len(hashes))]
        while len(level) > 1:
            up, members = [], []
            for a in range(0, len(level), fanout):
                run = level[a : a + fanout]
                for i in range(a, a + len(run)):
                    for leaf in of[i]:
                        paths[leaf].append(("".join(level[a:i]), "".join(level[i + 1 : a + len(run)])))
                up.append(sha("".join(run)))
                members.append([leaf for i in range(a, a + len(run)) for leaf in of[i]])
            level, of = up, members
        return (level or [None])[0], paths

    groups = defaultdict(list)
    for n, row in enumerate(rows):
        groups[row["lang"]].append((row["doc_id"] is not None, row["doc_id"] or 0, sha("".join(enc(row[f]) for f in FIELDS)), n))
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    made = {lang: (sorted(groups[lang]), *climb([x[2] for x in sorted(groups[lang])])) for lang in order}
    root, crowns = climb([made[lang][1] for lang in order])
    out = {}
    for lang, crown in zip(order, crowns):
        leaves, subroot, paths = made[lang]
        for (_, _, leaf, n), path in zip(leaves, paths):
            out[n] = (leaf, subroot, root, path + crown)
    return out


@pytest.mark.parametrize("fanout", [2, 8])
def test_manifest(spark, fanout):
    r = random.Random(2)
    rows = [dict(doc_id=i if i % 31 else None, source=r.choice(["a", None, "ü:1"]), lang=r.choice(["en", "en", "de", None, ""]), n_chars=i % 5 or None, text=r.choice([None, "", "Text É A", "b" * i])) for i in range(150)]
    rows += [dict(rows[7]), dict(rows[7]), dict(doc_id=500, source="s", lang="solo", n_chars=1, text="one leaf")]
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    table = spark.createDataFrame([tuple(x.values()) + ("t", 9) for x in rows], schema + ", tree string, idx int").repartition(4)
    found = manifest(table, fanout=fanout).withColumn("ok", fold(F.col("leaf"), F.col("path")) == F.col("root")).withColumn("proof", proof(F.col("path")))
    got = found.collect()
    want = trees(rows, fanout)
    line = lambda leaf, sub, root, path: (leaf, sub, root, tuple(path))
    assert Counter(line(g.leaf, g.subroot, g.root, [(s.left, s.right) for s in g.path]) for g in got) == Counter(line(*w) for w in want.values())
    assert all(g.ok and g.proof == "".join(s.left + s.right for s in g.path) for g in got)
    assert manifest(table.limit(0)).isEmpty()
    one = manifest(table.filter("lang = 'solo'")).first()
    assert one.leaf == one.subroot == one.root and one.path == []


def test_tampering_is_seen(spark):
    rows = [(i, "s", "en", 3, "Abc" if i % 2 else "abc") for i in range(40)]
    table = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    changed = leaf_hash(*(F.lower("text") if f == "text" else F.col(f) for f in FIELDS))
    got = manifest(table, carried={"forged": changed}).select("doc_id", (fold(F.col("forged"), F.col("path")) == F.col("root")).alias("same"))
    assert {r.doc_id: r.same for r in got.collect()} == {i: i % 2 == 0 for i in range(40)}
    assert zlib.crc32(b"3") == spark.sql("SELECT crc32(cast('3' AS binary)) AS c").first().c


# --- clustering


def lloyd(x, centers, rounds):
    for _ in range(rounds):
        nearest = squared(x, centers).argmin(1)
        centers = np.array([x[nearest == j].sum(0) // (nearest == j).sum() if (nearest == j).any() else c for j, c in enumerate(centers)])
    return squared(x, centers).argmin(1), centers


@pytest.mark.parametrize("scale", [3, 1000, 1 << 22])
def test_bounds_never_decide_wrongly(scale):
    r = np.random.default_rng(scale)
    x = r.integers(-scale, scale, (400, 6)).astype(np.int32)
    x[:50] = x[0]
    centers = x[r.choice(400, 9, replace=False)].astype(np.int64)
    centers[4] = centers[3]
    rows = Bounded(x).first(centers, 3)
    for _ in range(8):
        d = squared(x, centers)
        assert (rows.cluster == d.argmin(1)).all()
        new = centers + r.integers(-scale // 3, scale // 3 + 1, centers.shape) // 4
        rows.move(new, np.sqrt(((new - centers) ** 2).sum(1).astype(float)))
        centers = new
    assert (rows.cluster == squared(x, centers).argmin(1)).all()


def test_distances_are_exact():
    x = np.array([[1 << 26, -(1 << 26)], [3, 4]], np.int64)
    assert squared(x, np.array([[-(1 << 26), 1 << 26], [0, 0]])).tolist() == [[1 << 55, 1 << 53], [(3 + (1 << 26)) ** 2 + ((1 << 26) - 4) ** 2, 25]]


def test_clusters_are_those_of_a_full_comparison(spark):
    r = np.random.default_rng(1)
    v = r.normal(size=(300, 64)).astype(np.float32)
    v[100:200] = v[0]
    rows = [(i, [float(a) for a in v[i]], i) for i in range(300)] + [(5, [float(a) for a in v[5]], 1), (None, [0.5] * 64, 1)]
    bad = [(900, None, 0), (901, [1.0] * 63, 0), (902, [None] + [1.0] * 63, 0), (903, [float("nan")] * 64, 0), (904, [float("inf")] * 64, 0), (905, [3e38] * 64, 0)]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, cluster int").repartition(3)
    found, centers = clusters(table)
    whole = integer_vectors(table, "vec_id", "embedding", 64, 1024).collect()
    assert len(whole) == len(rows)
    x = np.array([np.frombuffer(w.x, "<i4") for w in whole], np.int64)
    order = sorted(range(len(whole)), key=lambda i: (whole[i].vec_id is None, sha(f"3:{whole[i].vec_id}"), whole[i].x))[:8]
    cluster, want = lloyd(x, x[order], 10)
    assert (centers == want).all()
    d = squared(x, want)
    assert Counter((w.vec_id, int(c), int(d[i, c])) for i, (w, c) in enumerate(zip(whole, cluster))) == Counter(map(tuple, found.collect()))


def test_few_vectors_textual_ids_and_none(spark):
    schema = "vec_id string, embedding array<double>"
    three = spark.createDataFrame([(n, [float(i)] * 64) for i, n in enumerate("abc")], schema)
    found, centers = clusters(three)
    assert len(centers) == 3 and sorted(r.distance for r in found.collect()) == [0, 0, 0]
    found, centers = clusters(spark.createDataFrame([], schema))
    assert found.isEmpty() and len(centers) == 0


# --- what an operator leaves in the shared folder


def _left(spark):
    import os

    from cadenza.llm.common import shared_dir

    folder = f"{shared_dir(spark)}/cadenza".removeprefix("file:")
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def test_superseded_tables_are_deleted(spark, docs):
    from cadenza.llm.jaccard_join import jaccard_components
    from cadenza.llm.substring_index import deduplicate

    before = _left(spark)
    out = jaccard_components(docs, cell=2)
    kinds = Counter(name.rsplit("-", 1)[0] for name in _left(spark) - before)
    assert kinds == {"components": 1} and out.count() == docs.count()
    before = _left(spark)
    deduplicate(docs).count()
    assert {name.rsplit("-", 1)[0] for name in _left(spark) - before} == {"deduplicated", "index"}
    before = _left(spark)
    assert repeated_spans(docs, window=60, gram=20).count() == docs.count()
    assert {name.rsplit("-", 1)[0] for name in _left(spark) - before} == {"segments", "changed"}


def test_archive_of_pages_with_textual_ids(spark, tmp_path):
    from cadenza.llm.warc import read_archive, write_archive

    rows = [("b", "u", "x" * 200), ("a", "u", "x" * 200), (None, "u", "x" * 200), ("c", None, None)]
    folder = write_archive(spark.createDataFrame(rows, "page_id string, url string, html string"), str(tmp_path / "archive"))
    got = {r.page_id: r.record_type for r in read_archive(spark, folder).collect()}
    assert got == {"a": "response", "b": "revisit", None: "revisit", "c": "response"}
