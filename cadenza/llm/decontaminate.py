"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

1. Every k-gram of lower-cased words of the test items is a seed.  Seeds are counted
   over the corpus' passages, and a passage meets an item on the rarest seed that they share.
2. One pass over all whole documents cuts a passage around every run of seeds.  An
   alignment that reaches ``least`` spans at most ``n * (3 - 2 * least)`` words for an item of n,
   so a passage reaches that far beyond a seed of the item, and nothing that counts is cut off.
3. Distinct passages join test items on their seeds, so copies are aligned once.
4. A (passage, item) pair whose passage holds too few of the item's words to reach
   ``least`` is left out (no alignment scores more than its matches); all others are
   aligned (match 2, mismatch -1, gap -1).  The score is that of the best local
   alignment over that of a whole verbatim copy; a pair at or above ``least`` is
   contaminated, edited and paraphrased copies included.  An alignment's memory grows with
   the passage alone.

Only the item side is held by the tasks: 12 bytes a seed, in blocks of whole items of about
``block`` seeds, one pass a block; documents are never collected or cut short.

Recall: a copy is found if it shares k words in a row with its item.  With k = 3 that
holds for every copy with fewer than a quarter of its words replaced, wherever they stand.

Edge cases: null or blank texts and items match nothing; an item of fewer than k
words is one seed of all its words; repeated rows each give their own result row
(grouped by id); empty tables give no rows; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.llm.common import discard, read, written
from cadenza.llm.textarrays import chunks, window_hash

K = 3
LEAST = 0.5
BLOCK = 2_000_000
MATCH, MISMATCH, SPACE = 2, -1, -1


def _grams(chunk, k: int):
    """Word hashes, first word of every k-gram, and the k-gram's hash; short texts give one gram of all words."""
    words = chunk.word_hash(lower=True)
    at = chunk.windows(k)
    return words, at, window_hash(words, at, k)


def item_seeds(items: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """item_id, words (binary of uint64), n, seeds (distinct): a row per item with a word."""
    id_type = items.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for c in chunks(batch.column(1)):
                words, at, grams = _grams(c.split(), k)
                cut, out = np.searchsorted(at, c.woff), []
                for i in range(c.n):
                    a, b = c.woff[i], c.woff[i + 1]
                    if a == b:
                        continue
                    own = grams[cut[i] : cut[i + 1]]
                    seeds = np.unique(own) if len(own) else window_hash(words[a:b], np.array([0]), int(b - a))
                    out.append((c.lo + i, words[a:b].tobytes(), int(b - a), seeds.view(np.int64)))
                rows, texts, n, seeds = zip(*out) if out else [()] * 4
                ids = batch.column(0).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(texts, pa.binary()), pa.array(n, pa.int64()), pa.array(seeds, pa.list_(pa.int64()))], names=["item_id", "words", "n", "seeds"])

    return items.select(id_col, text_col).mapInArrow(run, f"item_id {id_type}, words binary, n long, seeds array<long>")


class Seeds:
    """Sorted seeds and how far a passage reaches beyond each, with a small table of low bits before the binary search."""

    def __init__(self, seeds: np.ndarray, pads: np.ndarray):
        order = np.argsort(seeds)
        self.sorted, self.pads = seeds[order], pads[order]
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.sorted & np.uint64(0xFFFF)).astype(np.int64)] = True

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in grams that are seeds, and which."""
        at = np.flatnonzero(self.maybe[(grams & np.uint64(0xFFFF)).astype(np.int64)])
        which = np.minimum(np.searchsorted(self.sorted, grams[at]), max(len(self.sorted) - 1, 0))
        good = self.sorted[which] == grams[at] if len(self.sorted) else np.zeros(0, bool)
        return at[good], which[good]


def _reach(n: np.ndarray, least: float) -> np.ndarray:
    """Most words that an alignment at or above ``least`` spans, for items of n words."""
    return np.ceil(n * (1 + (MATCH / -SPACE) * (1 - least))).astype(np.int64)


def passages(docs: DataFrame, id_col: str, text_col: str, sizes: dict[int, Seeds]) -> DataFrame:
    """doc_id, first (word number), words, seeds: a row per stretch of a document within reach of seeds."""
    id_type = docs.schema[id_col].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(sizes)
    names = ["doc_id", "first", "words", "seeds"]

    def run(batches):
        for batch in batches:
            ids, out = batch.column(0), []
            for c in chunks(batch.column(1)):
                words, found = c.split().word_hash(lower=True), []
                for k, seeds in held.value.items():
                    at = c.windows(k)
                    hit, which = seeds.find(grams := window_hash(words, at, k))
                    pad = seeds.pads[which]
                    found.append((at[hit] - pad, at[hit] + k + pad, at[hit], grams[hit]))
                lo, hi, at, grams = map(np.concatenate, zip(*found)) if found else [np.empty(0, np.int64)] * 4
                doc = np.searchsorted(c.woff, at, "right") - 1
                lo, hi = np.maximum(lo, c.woff[doc]), np.minimum(hi, c.woff[doc + 1])
                order = np.argsort(lo, kind="stable")
                lo, hi, doc, grams = lo[order], hi[order], doc[order], grams[order]
                upto = np.maximum.accumulate(hi)
                new = np.flatnonzero(np.concatenate([[True], lo[1:] >= upto[:-1]])) if len(lo) else []
                for i, j in zip(new, [*new[1:], len(lo)]):
                    a, b = lo[i], upto[j - 1]
                    out.append((ids[c.lo + int(doc[i])].as_py(), int(a - c.woff[doc[i]]), words[a:b].tobytes(), np.unique(grams[i:j]).view(np.int64).tolist()))
            if out:
                types = [batch.schema.field(0).type, pa.int64(), pa.binary(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=names)

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {id_type}, first long, words binary, seeds array<long>")


def align(item: np.ndarray, passage: np.ndarray) -> tuple[float, int, int]:
    """Best local alignment: score over that of a verbatim copy, and the words of the passage it spans.

    Row by row, a cell holds its score in the high and where its alignment starts in the low half (smaller starts
    are larger, so they win ties): memory grows with the passage only.
    """
    one, low = np.int64(1 << 32), np.int64((1 << 32) - 1)
    steps = np.arange(len(passage) + 1, dtype=np.int64)
    fresh = low - steps
    row, best, start, end = fresh, 0, 0, 0
    for w in item:
        new = np.maximum(row + SPACE * one, fresh)
        new[1:] = np.maximum(new[1:], row[:-1] + np.where(passage == w, MATCH * one, MISMATCH * one))
        row = np.maximum.accumulate(new - SPACE * one * steps) + SPACE * one * steps
        scores = row >> 32
        at = int(scores.argmax())
        if scores[at] > best:
            best, start, end = int(scores[at]), int(low - (row[at] & low)), at
    return best / (MATCH * len(item)), start, end


def _block(docs: DataFrame, id_col: str, text_col: str, items: DataFrame, least: float) -> DataFrame:
    """The contaminated pairs of ``items`` (item_id, words, n, k, seeds)."""
    seeds = items.select("item_id", "n", "k", F.explode("seeds").alias("seed"))
    own = seeds.groupBy("seed", "k").agg(F.max("n").alias("n")).toPandas()
    sizes = {
        int(k): Seeds(part.seed.to_numpy(np.int64).view(np.uint64), _reach(part.n.to_numpy(), least).astype(np.int32)) for k, part in own.groupby("k")
    }
    hits = written(passages(docs, id_col, text_col, sizes).withColumn("passage", F.sha2("words", 256)), "passages")
    shapes = hits.groupBy("passage").agg(F.first("words").alias("words"), F.first("seeds").alias("seeds"), F.count("*").alias("copies"))
    shapes = written(shapes, "shapes")
    met = shapes.select("passage", "copies", F.explode("seeds").alias("seed"))
    rarity = met.groupBy("seed").agg(F.sum("copies").alias("df"))
    pairs = met.join(seeds.select("seed", "item_id").distinct().join(rarity, "seed"), "seed")
    pairs = pairs.groupBy("passage", "item_id").agg(F.min(F.struct("df", "seed")).alias("rarest"))
    texts = items.groupBy("item_id").agg(F.min("words").alias("item_words"))
    both = pairs.join(shapes.select("passage", "words"), "passage").join(texts, "item_id")
    schema = T.StructType(
        [
            T.StructField("passage", T.StringType()),
            T.StructField("item_id", both.schema["item_id"].dataType),
            T.StructField("seed_df", T.LongType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("a", T.LongType()),
            T.StructField("b", T.LongType()),
        ]
    )

    def verify(batches):
        for batch in batches:
            rows = []
            for i, (item, passage) in enumerate(zip(batch.column(3), batch.column(4))):
                item, passage = np.frombuffer(item.as_buffer(), np.uint64), np.frombuffer(passage.as_buffer(), np.uint64)
                if np.isin(item, passage).sum() / len(item) >= least and (found := align(item, passage))[0] >= least:
                    rows.append((i, *found))
            at, score, start, end = zip(*rows) if rows else [()] * 4
            own = batch.select([0, 1, 2]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*own.columns, pa.array(score, pa.float64()), pa.array(start, pa.int64()), pa.array(end, pa.int64())],
                names=[f.name for f in schema],
            )

    aligned = both.select("passage", "item_id", F.col("rarest.df").alias("seed_df"), "item_words", "words").mapInArrow(verify, schema)
    best = F.max_by(F.struct("score", "start_word", "end_word", "seed_df"), F.struct("score", -F.col("start_word")))
    out = (
        hits.select("doc_id", "first", "passage")
        .join(aligned, "passage")
        .select("doc_id", "item_id", "score", (F.col("first") + F.col("a")).alias("start_word"), (F.col("first") + F.col("b")).alias("end_word"), "seed_df")
        .groupBy("doc_id", "item_id")
        .agg(best.alias("b"))
        .select("doc_id", "item_id", "b.score", "b.start_word", "b.end_word", "b.seed_df")
    )
    out = written(out, "contaminated")
    discard(hits, shapes)
    return out


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    k: int = K,
    least: float = LEAST,
    block: int = BLOCK,
) -> DataFrame:
    """doc_id, item_id, score, start_word, end_word, seed_df: the best alignment of every contaminated pair."""
    tests = written(item_seeds(items, item_id, item_text, k).withColumn("k", F.least("n", F.lit(k)).cast("int")), "items")
    n_blocks = max(1, -(-(tests.agg(F.sum(F.size("seeds"))).first()[0] or 0) // block))
    out = None
    for b in range(n_blocks):  # whole items, so that no copy is judged in fragments
        one = _block(docs, id_col, text_col, tests.filter(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == b), least)
        out = one if out is None else out.unionByName(one)
    discard(tests)
    return out


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
