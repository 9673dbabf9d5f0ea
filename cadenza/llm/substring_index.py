"""Incremental substring deduplication over a log-structured fingerprint index.

A window is ``window`` consecutive words.  Its anchor is the smallest hash of the
``gram``-word runs in it, so equal windows have equal anchors.  A segment is a
maximal run of windows with one anchor, about 20 windows; it is known by its anchor
and two independent 64-bit hashes of all words under it.  The index is a list of
immutable runs sorted by anchor: (anchor, s1, s2, smallest document).

Ingesting a batch:
1. The batch's segments are pre-aggregated and merge-joined with the runs: a segment
   that a smaller document has too is removed whole.
2. Where one anchor has different segments, single windows can still be equal.  The
   smallest document of each such segment gives its windows (two hashes), and the
   smallest document of each window is found: this verifies window by window.
3. Words under a window that also starts in a smaller document are removed.
4. The batch's new segments become a run; more than ``fanout`` runs are compacted.

Documents are never paired with each other, so a passage that a third of all of
them share costs a row per document at most, mostly pre-aggregated.

Windows are judged on the input texts.  Edge cases: null text is empty; texts
shorter than a window lose nothing; rows with a null id keep all words; rows that
repeat an id do not remove words from each other; an empty table gives no rows; ids that
are not numbers are ingested as one batch; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.llm.common import discard, read, shared_dir, written
from cadenza.llm.textarrays import chunks, span_hash, window_hash

WINDOW = 50
GRAM = 8
FANOUT = 4


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of x[i:i+w] for every i (two running minima over blocks of w)."""
    n = len(x)
    if n < w:
        return x[:0]
    blocks = np.full(-(-n // w) * w, np.iinfo(x.dtype).max, x.dtype)
    blocks[:n] = x
    blocks = blocks.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def _anchors(chunk, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, first words of all windows, and the windows' anchors."""
    words = chunk.word_hash()
    at = chunk.windows(window)
    if not len(at):
        return words, at, np.empty(0, np.uint64)
    grams = window_hash(words, np.arange(len(words) - gram + 1), gram)
    return words, at, sliding_min(grams, window - gram + 1)[at]


def _word_bytes(chunk, i: int, keep: np.ndarray | None = None) -> bytes:
    """The (kept) words of document i joined by one space."""
    a, b = chunk.woff[i], chunk.woff[i + 1]
    at = np.arange(a, b) if keep is None else a + np.flatnonzero(keep)
    if not len(at):
        return b""
    lo, hi = chunk.starts[at[0]], chunk.ends[at[-1]]
    n = np.zeros(hi - lo + 1, np.int32)
    np.add.at(n, chunk.starts[at] - lo, 1)
    np.add.at(n, chunk.ends[at] - lo, -1)
    inside = np.cumsum(n[:-1]) > 0
    # the byte after a word, always outside, becomes its space
    space = chunk.ends[at[:-1]] - lo
    data = chunk.data[lo:hi].copy()
    data[space] = 32
    inside[space] = True
    return data[inside].tobytes()


class _Segments:
    """Maximal runs of windows with one anchor: first window, number of windows, anchor, two hashes of the words under it."""

    def __init__(self, chunk, window: int, gram: int):
        self.words, self.at, self.anchors = _anchors(chunk.split(), window, gram)
        at, n = self.at, len(self.at)
        doc = np.searchsorted(chunk.woff, at, "right") - 1
        new = np.ones(n, bool)
        new[1:] = (self.anchors[1:] != self.anchors[:-1]) | (doc[1:] != doc[:-1])
        self.first = np.flatnonzero(new)
        self.count = np.diff(np.append(self.first, n))
        self.doc, self.window_doc = doc[self.first], doc
        self.start = at[self.first]
        self.anchor = self.anchors[self.first].view(np.int64)
        if n:
            ends = self.start + self.count - 1 + window
            self.s1 = span_hash(self.words, self.start, ends).view(np.int64)
            self.s2 = span_hash(chunk.word_hash(seed=1), self.start, ends).view(np.int64)
        else:
            self.s1 = self.s2 = np.empty(0, np.int64)


def fingerprints(docs: DataFrame, id_col: str, text_col: str, window: int, gram: int) -> DataFrame:
    """doc_id, n_words, digest (SHA-256 of the words), segments (anchor, s1, s2): one row a document."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for c in chunks(batch.column(1)):
                found = _Segments(c, window, gram)
                offsets = np.searchsorted(found.doc, np.arange(c.n + 1)).astype(np.int32)
                parts = pa.StructArray.from_arrays([pa.array(x) for x in (found.anchor, found.s1, found.s2)], names=["anchor", "s1", "s2"])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[c.lo : c.hi],
                        pa.array(np.diff(c.woff).astype(np.int64)),
                        pa.array([hashlib.sha256(_word_bytes(c, i)).hexdigest() for i in range(c.n)]),
                        pa.ListArray.from_arrays(offsets, parts),
                    ],
                    names=["doc_id", "n_words", "digest", "segments"],
                )

    schema = f"doc_id {id_type}, n_words long, digest string, segments array<struct<anchor: long, s1: long, s2: long>>"
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def _windows(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """doc_id, h1, h2: the windows of each text whose anchor is in its ``shared`` list."""
    id_type = texts.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            shared = batch.column(2)
            for c in chunks(batch.column(1)):
                found = _Segments(c, window, gram)
                keep = np.zeros(len(found.first), bool)
                cut = np.searchsorted(found.doc, np.arange(c.n + 1))
                for i, (a, b) in enumerate(zip(cut[:-1], cut[1:])):
                    keep[a:b] = np.isin(found.anchor[a:b], shared[c.lo + i].values.to_numpy())
                keep = np.repeat(keep, found.count)
                at, doc = found.at[keep], found.window_doc[keep]
                h1 = window_hash(found.words, at, window).view(np.int64)
                h2 = window_hash(c.word_hash(seed=1), at, window).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[c.lo : c.hi].take(pa.array(doc)), pa.array(h1), pa.array(h2)], names=["doc_id", "h1", "h2"]
                )

    return texts.select("doc_id", "text", "shared").mapInArrow(run, f"doc_id {id_type}, h1 long, h2 long")


def _cut(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """doc_id, digest, n_removed, kept (the words that stay): texts without the listed segments and windows."""
    id_type = texts.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for c in chunks(batch.column(1)):
                found = _Segments(c, window, gram)
                hashes = window_hash(found.words, found.at, window).view(np.int64)
                cut = np.searchsorted(found.doc, np.arange(c.n + 1))
                gone = np.zeros(len(found.at), bool)
                for i, (a, b) in enumerate(zip(cut[:-1], cut[1:])):
                    if a == b:
                        continue
                    listed = batch.column(2)[c.lo + i].values.to_numpy()
                    lo, hi = found.first[a], found.first[b - 1] + found.count[b - 1]
                    gone[lo:hi] = np.repeat(np.isin(found.s1[a:b], listed), found.count[a:b]) | np.isin(hashes[lo:hi], listed)
                edge = np.zeros(len(found.words) + 1, np.int32)
                np.add.at(edge, found.at[gone], 1)
                np.add.at(edge, found.at[gone] + window, -1)
                stay = np.cumsum(edge[:-1]) == 0
                docs = [stay[a:b] for a, b in zip(c.woff[:-1], c.woff[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[c.lo : c.hi],
                        pa.array([hashlib.sha256(_word_bytes(c, i)).hexdigest() for i in range(c.n)], pa.string()),
                        pa.array([int((~x).sum()) for x in docs], pa.int64()),
                        pa.array([_word_bytes(c, i, x).decode() for i, x in enumerate(docs)], pa.string()),
                    ],
                    names=["doc_id", "digest", "n_removed", "kept"],
                )

    return texts.select("doc_id", "text", "gone").mapInArrow(run, f"doc_id {id_type}, digest string, n_removed long, kept string")


class FingerprintIndex:
    """Sorted immutable runs in one shared folder."""

    def __init__(self, spark: SparkSession, folder: str | None = None, window: int = WINDOW, gram: int = GRAM, fanout: int = FANOUT):
        self.spark, self.window, self.gram, self.fanout = spark, window, gram, fanout
        self.folder = folder or f"{shared_dir(spark)}/cadenza/index-{uuid.uuid4().hex}"
        self.runs: list[str] = []

    def history(self) -> DataFrame | None:
        out = None
        for path in self.runs:
            run = self.spark.read.parquet(path)
            out = run if out is None else out.unionByName(run)
        return out

    def add_run(self, rows: DataFrame) -> None:
        """Write (anchor, s1, s2, doc_id) as a run sorted by anchor."""
        path = f"{self.folder}/run-{len(self.runs)}-{uuid.uuid4().hex}"
        rows.repartitionByRange("anchor").sortWithinPartitions("anchor", "s1").write.option("compression", "zstd").parquet(path)
        self.runs.append(path)
        if len(self.runs) > self.fanout:
            self.compact()

    def compact(self) -> None:
        """Merge all runs into one, a row per segment; the old files stay until their readers are done."""
        merged, self.runs = self.history().groupBy("anchor", "s1", "s2").agg(F.min("doc_id").alias("doc_id")), []
        self.add_run(merged)

    def ingest(self, batch: DataFrame, texts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """doc_id, n_words, n_removed, kept (null if nothing is removed), digest: one row per row of batch.

        ``texts`` holds the texts of history and batch; ids of the batch should be
        larger than those of history, as words are removed from the larger id.
        """
        prints = written(fingerprints(batch, id_col, text_col, self.window, self.gram), "prints")
        own = prints.filter("doc_id IS NOT NULL").select("doc_id", F.explode("segments").alias("s")).select("doc_id", "s.*")
        key = ["anchor", "s1", "s2"]
        fresh = written(own.groupBy(*key).agg(F.min("doc_id").alias("doc_id"), (F.min("doc_id") < F.max("doc_id")).alias("again")), "fresh")
        old = self.history()
        firsts = fresh.withColumn("new", F.lit(True))
        if old is not None:
            known = old.groupBy(*key).agg(F.min("doc_id").alias("was"))
            firsts = fresh.join(known.hint("merge"), key, "left")
            firsts = firsts.select(*key, F.least("doc_id", "was").alias("doc_id"), (F.col("again") | F.col("was").isNotNull()).alias("again"), F.col("was").isNull().alias("new"))
        # whole segments that a smaller document has too
        gone = own.join(firsts.filter("again").select(*key, F.col("doc_id").alias("first")), key).filter("first < doc_id").select("doc_id", F.col("s1").alias("h"))
        # anchors with different segments, at least one of them new: their windows are compared one by one
        sides = firsts.filter("new").select(*key, "doc_id", "new")
        if old is not None:
            sides = sides.unionByName(old.select(*key, "doc_id", F.lit(False).alias("new")))
        variants = sides.groupBy("anchor").agg(F.count("*").alias("n"), F.bool_or("new").alias("new")).filter("n > 1 AND new").select("anchor")
        lists = sides.join(variants.hint("merge"), "anchor", "left_semi").groupBy("doc_id").agg(F.collect_set("anchor").alias("shared"))
        source = texts.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
        windows = written(_windows(source.join(lists, "doc_id"), self.window, self.gram), "windows")
        first = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").drop("last")
        more = windows.join(first, ["h1", "h2"]).filter("first < doc_id").select("doc_id", F.col("h1").alias("h"))
        listed = gone.unionByName(more).groupBy("doc_id").agg(F.collect_set("h").alias("gone"))
        of_batch = batch.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
        cut = _cut(of_batch.join(listed, "doc_id"), self.window, self.gram).dropDuplicates(["doc_id", "digest"])
        out = prints.select("doc_id", "n_words", "digest").join(cut, ["doc_id", "digest"], "left")
        out = written(out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), "kept", "digest"), "deduplicated")
        self.add_run(firsts.filter("new").select(*key, "doc_id"))
        discard(prints, fresh, windows)
        return out


def deduplicate(docs: DataFrame, batches: int = 2, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Ingest docs in batches of ascending id into a new index; rows as FingerprintIndex.ingest."""
    index = FingerprintIndex(docs.sparkSession, **options)
    docs = docs.select(id_col, text_col)
    if not isinstance(docs.schema[id_col].dataType, T.NumericType):
        batches = 1
    share = [i / batches for i in range(1, batches)]
    bounds = docs.select(F.percentile_approx(id_col, share, 1000)).first()[0] if share else []
    bounds = sorted(set(bounds or []))
    out = None
    for lo, hi in zip([None, *bounds], [*bounds, None]):
        inside = F.lit(True)
        if lo is not None:
            inside &= F.col(id_col) > lo
        if hi is not None:
            inside &= F.col(id_col) <= hi
        seen = F.lit(True) if hi is None else F.col(id_col) <= hi
        part = docs.filter(inside if lo is not None or hi is None and lo is None else inside | F.col(id_col).isNull())
        one = index.ingest(part, docs.filter(seen), id_col, text_col)
        out = one if out is None else out.unionByName(one)
    return out


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicate(read(spark, sf_dir, "documents"))
    kept = F.when(F.col("kept").isNull(), F.col("digest")).otherwise(F.sha2(F.col("kept").cast("binary"), 256))
    return found.select("doc_id", "n_words", "n_removed", kept.alias("kept_sha256"))
