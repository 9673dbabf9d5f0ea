"""Removal of byte strings that start more than once, by suffix order of small collections.

1. One pass cuts each whole text into segments.  A window is ``window`` consecutive bytes; its
   anchor is the leftmost of its ``gram``-byte strings with the smallest hash, and a segment is
   all windows with one anchor at one place.  Equal windows have equal anchors at equal distances,
   so a window can only be equal to windows of segments with the same anchor.
2. Segments are pre-aggregated by anchor.  An anchor seen once has no equal windows; one whose
   segments are all the same bytes is repeated whole.  The other anchors' distinct segments are cut
   into pieces: windows whose distance to the anchor lies in one bin.  All windows of a bin hold the
   same bytes around the anchor, their core, so only pieces of equal core can have equal windows.
   Again a core seen once is done, and so is one of equal pieces.
3. The other pieces, some 230 bytes each, are the documents of a collection, dealt out by core in
   chunks of some 200 KB.  A chunk's suffixes are ordered column-wise: in each round every document, from
   its right end, gives one symbol to the collection's Burrows-Wheeler transform, and its next suffix is
   inserted by rank; the common prefixes with both new neighbours follow from the least common prefix
   between equal symbols.  A round is one sequential pass over the chunk.  Windows whose common
   prefix with a neighbour has the window's length are repeated: no hash decides it.
   Equal windows lie equally far from their anchor, so a piece stops as soon as its newest suffix
   has no other with enough in common.
4. A core with more pieces than a chunk holds is cut over several; their classes of equal
   windows, a row each, are then added up by two 64-bit hashes.
5. Repeated segments, pieces and windows go back to their texts, which are cut.  Texts that occur twice
   are repeated whole, and are not looked at again.

The external files of the method are tables in the shared folder (segments, chunks, marks), as
executors have no other place that outlives them; a chunk itself is small and held in memory.

Strings are judged on the input.  Edge cases: null text is empty; texts shorter than the window
lose nothing; ids are only passed on, so null, repeated and textual ones are all well; two equal
rows repeat each other; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import discard, read, sieve, sifted, without, written
from cadenza.llm.substring_index import sliding_min
from cadenza.llm.textarrays import _BASE, _INVERSE, U, _byte_values, chunks, mix, powers

WINDOW = 200
GRAM = 64
#: Distances to an anchor that make up one piece.
BIN = 32
#: Pieces of one chunk, about: 200 KB and some 260 rounds.
CELL = 900
#: Bytes of text that are hashed at once: their arrays of 64-bit values stay in a core's cache.
CHUNK_BYTES = 1 << 16
_PLACE = U((1 << 32) - 1)
SPANS = "array<struct<start: long, end: long>>"


class _Sums:
    """Hashes of any span of some bytes, from one pass of prefix sums."""

    def __init__(self, data: np.ndarray, seed: int = 0):
        self.sums = np.zeros(len(data) + 1, U)
        np.cumsum(_byte_values(seed)[data] * powers(_BASE, len(data)), dtype=U, out=self.sums[1:])
        self.back = powers(_INVERSE, len(data) + 1)

    def every(self, length: int) -> np.ndarray:
        """Of each run of ``length`` bytes."""
        raw = (self.sums[length:] - self.sums[:-length]) * self.back[: len(self.sums) - length]
        return mix(raw)

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.sums[ends] - self.sums[starts]) * self.back[starts]
        return mix(raw + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


class _Segments:
    """first (byte of the chunk), count (of windows), doc, anchor, lead (bytes before it) and s (hash of all bytes under the windows) of each segment."""

    def __init__(self, chunk, window: int, gram: int):
        n = len(chunk.data)
        valid = np.ones(max(n - window + 1, 0), bool)
        for end in chunk.off[1:-1]:
            valid[max(end - window + 1, 0) : end] = False
        at = np.flatnonzero(valid)
        if not len(at):
            self.first = self.count = self.doc = self.lead = np.empty(0, np.int64)
            self.anchor = self.s = np.empty(0, np.int64)
            return
        sums = _Sums(chunk.data)
        grams = sums.every(gram)
        ranked = (grams & ~_PLACE) | np.arange(len(grams), dtype=U)
        place = (sliding_min(ranked, window - gram + 1) & _PLACE)[at]
        new = np.ones(len(at), bool)
        new[1:] = (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)
        new = np.flatnonzero(new)
        self.first, self.count = at[new], np.diff(np.append(new, len(at)))
        self.doc = np.searchsorted(chunk.off, self.first, "right") - 1
        place = place[new].astype(np.int64)
        self.anchor, self.lead = grams[place].view(np.int64), place - self.first
        self.s = sums.spans(self.first, self.first + self.count - 1 + window).view(np.int64)

    def cuts(self, n: int) -> np.ndarray:
        """Where the segments of each of n documents begin."""
        return np.searchsorted(self.doc, np.arange(n + 1))


def segments(docs: DataFrame, id_col: str, window: int, gram: int) -> DataFrame:
    """doc_id, digest, t, n_bytes, segments (anchor, s): a row per row of docs (id_col, digest, t, text)."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for c in chunks(batch.column(3), CHUNK_BYTES):
                found = _Segments(c, window, gram)
                parts = pa.StructArray.from_arrays([pa.array(found.anchor), pa.array(found.s)], names=["anchor", "s"])
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(i)[c.lo : c.hi] for i in range(3)),
                        pa.array(np.diff(c.off)),
                        pa.ListArray.from_arrays(found.cuts(c.n).astype(np.int32), parts),
                    ],
                    names=["doc_id", "digest", "t", "n_bytes", "segments"],
                )

    schema = f"doc_id {id_type}, digest string, t binary, n_bytes long, segments array<struct<anchor: long, s: long>>"
    return docs.select(id_col, "digest", "t", "text").mapInArrow(run, schema)


def _pieces(texts: DataFrame, window: int, gram: int, width: int) -> DataFrame:
    """The pieces of the segments of each text that are in its ``wanted`` list.

    anchor, s, begin and n (its windows in the segment), core and piece (hashes), tail (bytes from the anchor on), bytes.
    """

    def run(batches):
        for batch in batches:
            wanted = batch.column(1)
            for c in chunks(batch.column(0), CHUNK_BYTES):
                found = _Segments(c, window, gram)
                cuts, keep = found.cuts(c.n), []
                for i in range(c.n):
                    a, b, mine = cuts[i], cuts[i + 1], wanted[c.lo + i].values
                    hit = np.isin(found.s[a:b], mine.field("s").to_numpy()) & np.isin(found.anchor[a:b], mine.field("anchor").to_numpy())
                    hit = np.flatnonzero(hit)
                    # a segment that the text holds more than once is cut up once
                    _, one = np.unique(found.s[a:b][hit], return_index=True)
                    keep.append(a + hit[one])
                keep = np.concatenate(keep)
                # distances run from lead (the first window) down to lead - count + 1
                far, near = found.lead[keep], found.lead[keep] - found.count[keep] + 1
                low = near // width
                bins = far // width - low + 1
                of = np.repeat(np.arange(len(keep)), bins)
                j = np.arange(len(of)) - np.repeat(np.cumsum(bins) - bins, bins) + low[of]
                high = np.minimum(j * width + width - 1, far[of])
                n = high - np.maximum(j * width, near[of]) + 1
                seg, begin = keep[of], far[of] - high
                start = found.first[seg] + begin
                end, place = start + n - 1 + window, found.first[seg] + found.lead[seg]
                sums, raw = _Sums(c.data), c.data.tobytes()
                core = sums.spans(place - j * width, place - j * width - (width - 1) + window) if len(seg) else np.empty(0, U)
                core = mix(core ^ mix(found.anchor[seg].view(U) + j.astype(U)))
                yield pa.RecordBatch.from_arrays(
                    [
                        *map(pa.array, (found.anchor[seg], found.s[seg], begin.astype(np.int32), n.astype(np.int32), core.view(np.int64))),
                        pa.array(sums.spans(start, end).view(np.int64)),
                        pa.array((end - place).astype(np.int32)),
                        pa.array([raw[a:b] for a, b in zip(start, end)], pa.binary()),
                    ],
                    names=["anchor", "s", "begin", "n", "core", "piece", "tail", "bytes"],
                )

    return texts.select("text", "wanted").mapInArrow(run, "anchor long, s long, begin int, n int, core long, piece long, tail int, bytes binary")


_BLOCK = 16
_AHEAD = np.arange(_BLOCK)


def _least(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum of values[a:b] for every (non-empty) span: short ones byte by byte, long ones by both ends and a table over blocks."""
    out = values[a]
    rest = np.flatnonzero(b - a > 1)
    if not len(rest):
        return out
    a, b = a[rest], b[rest]
    least = values[np.minimum(a[:, None] + _AHEAD, b[:, None] - 1)].min(1)
    long = np.flatnonzero(b - a > _BLOCK)
    if len(long):
        a, b = a[long], b[long]
        more = values[np.maximum(b[:, None] - 1 - _AHEAD, a[:, None])].min(1)
        lo, hi = -(-a // _BLOCK), b // _BLOCK
        inside = np.flatnonzero(hi > lo)
        if len(inside):
            lo, hi = lo[inside], hi[inside]
            level = np.frexp((hi - lo).astype(np.float64))[1].astype(np.int64) - 1  # floor of the binary logarithm
            blocks = len(values) // _BLOCK
            table = np.empty((int(level.max()) + 1, blocks), values.dtype)
            values[: blocks * _BLOCK].reshape(-1, _BLOCK).min(1, out=table[0])
            for k in range(1, len(table)):
                step = 1 << (k - 1)
                np.minimum(table[k - 1, :-step], table[k - 1, step:], out=table[k, :-step])
            table = table.ravel()
            more[inside] = np.minimum(more[inside], np.minimum(table[level * blocks + lo], table[level * blocks + hi - (1 << level)]))
        least[long] = np.minimum(least[long], more)
    out[rest] = least
    return out


def repeated_windows(strings: list[bytes], window: int, tails: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of a collection: whether each window occurs twice or more, and its class of equal windows; rows by string, columns by start.

    Column-wise construction of the collection's Burrows-Wheeler transform and common prefixes (cut off
    at the window's length).  Places past a string's last window hold False and -1.

    ``tails``, where given, are the lengths after a point such that equal windows lie equally far from
    their strings' points.  Symbols equally far from it then go in in one round, so that a string whose
    newest suffix has too short a prefix in common with any other has no repeated window from there on, and
    is not carried further; the classes of such windows are unknown, -1.
    """
    m = len(strings)
    lengths = np.array([len(s) for s in strings], np.int64)
    data = np.frombuffer(b"".join(strings), np.uint8)
    codes = np.zeros(256, np.uint16)
    used = np.unique(data)
    codes[used] = np.arange(1, len(used) + 1)
    codes = codes.astype(np.uint8) if len(used) < 256 else codes
    data = codes[data]
    last = np.cumsum(lengths) - 1
    kind = np.uint8 if window < 255 else np.uint16
    starts = np.zeros(m, np.int64) if tails is None else tails.max(initial=0) - tails
    rounds = int((starts + lengths).max(initial=0))
    joining = np.split(np.argsort(starts, kind="stable"), np.searchsorted(np.sort(starts), np.arange(1, rounds)))
    # the empty suffixes, one a document; a document's open place is where its latest suffix stands
    bwt, common = np.zeros(m, data.dtype), np.zeros(m, kind)
    place, added, live = np.arange(m), np.zeros(m, np.int64), np.empty(0, np.int64)
    for j in range(rounds):
        live = np.concatenate([live, joining[j]])
        k = len(live)
        if not k:
            continue
        open_ = place[live]
        bwt[open_] = data[last[live] - added[live]]
        n = len(bwt)
        order = np.argsort(bwt, kind="stable")[m - k :]  # the others show an end sign
        latest = np.zeros(n, bool)
        latest[open_] = True
        rank = np.flatnonzero(latest[order])
        owner = np.empty(n, np.int32)
        owner[open_] = np.arange(k)
        here = order[rank]
        live = live[owner[here]]
        symbol = bwt[here]
        before, after = order[np.maximum(rank - 1, 0)], order[np.minimum(rank + 1, len(order) - 1)]
        sides = np.zeros(2 * k, kind)
        near = np.flatnonzero(np.concatenate([(rank > 0) & (bwt[before] == symbol), (rank + 1 < len(order)) & (bwt[after] == symbol)]))
        a, b = np.concatenate([before, here])[near], np.concatenate([here, after])[near]
        sides[near] = np.minimum(_least(common, a + 1, b + 1) + kind(1), window)
        q = near[near >= k] - k
        new = m + rank
        old = np.ones(n + k, bool)
        old[new] = False
        grown, prefix = np.zeros(n + k, bwt.dtype), np.empty(n + k, kind)
        grown[old], prefix[old] = bwt, common
        prefix[new] = sides[:k]
        prefix[new[q] + 1] = sides[k:][q]
        bwt, common = grown, prefix
        place[live] = new
        added[live] += 1
        left = lengths[live] - added[live]
        stay = left > 0
        if tails is not None:
            stay &= np.maximum(sides[:k], sides[k:]) >= window - left
        live = live[stay]
    # the same walk once more over the whole transform: where each suffix stands
    back = np.empty(len(bwt), np.int64)
    back[np.argsort(bwt, kind="stable")[m:]] = np.arange(m, len(bwt))
    equal = common >= window
    twice = equal.copy()
    twice[:-1] |= equal[1:]
    classes = np.cumsum(~equal)
    width = max(int(lengths.max(initial=0)) - window + 1, 0)
    found, of = np.zeros((m, width), bool), np.full((m, width), -1, np.int64)
    place, live = np.arange(m), np.arange(m)
    for j in range(int(added.max(initial=0))):
        live = live[added[live] > j]
        place[live] = at = back[place[live]]
        if j + 1 >= window:
            start = lengths[live] - 1 - j
            found[live, start], of[live, start] = twice[at], classes[at]
    return found, of


def _chunk_marks(window: int):
    """Of one chunk (core, piece, bytes, tail, cells): the windows that are repeated in it, and the classes of cores that are cut over chunks."""
    names = ["core", "piece", "mask", "h1", "h2", "at"]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32()]

    def run(group: pa.Table) -> pa.Table:
        core, piece, cells, tail = (group.column(c).to_numpy() for c in ("core", "piece", "cells", "tail"))
        strings = group.column("bytes").to_pylist()
        whole = not (cells > 1).any()
        found, of = repeated_windows(strings, window, tail.astype(np.int64) if whole else None)
        hit = np.flatnonzero(found.any(1))
        packed = np.packbits(found[hit], axis=1, bitorder="little")
        empty = [pa.nulls(len(hit), t) for t in types[3:]]
        tables = [pa.table([pa.array(core[hit]), pa.array(piece[hit]), pa.array([x.tobytes() for x in packed], pa.binary()), *empty], names=names)]
        if not whole:
            row, start = np.nonzero(of >= 0)
            _, one = np.unique(of[row, start], return_index=True)
            row, start = row[one], start[one]
            begin = np.cumsum([0, *map(len, strings)])[row] + start
            data = np.frombuffer(b"".join(strings), np.uint8)
            h1, h2 = (_Sums(data, seed).spans(begin, begin + window).view(np.int64) for seed in (1, 2))
            found_alone = ~found[row, start]
            tables.append(
                pa.table(
                    [pa.array(core[row]), pa.array(piece[row], mask=~found_alone), pa.nulls(len(row), pa.binary()), pa.array(h1), pa.array(h2), pa.array(start.astype(np.int32), mask=~found_alone)],
                    names=names,
                )
            )
        return pa.concat_tables(tables).cast(pa.schema(list(zip(names, types))))

    return run, "core long, piece long, mask binary, h1 long, h2 long, at int"


def _places(chunk, found: _Segments, marks: pa.ListArray, window: int) -> np.ndarray:
    """Whether each byte of the chunk is removed by the marks of its document."""
    marks = marks.slice(chunk.lo, chunk.n)
    doc = np.repeat(np.arange(chunk.n), np.diff(marks.offsets.to_numpy()))
    flat = marks.flatten()
    key = lambda d, anchor, s: mix(mix(anchor.view(U) + d.astype(U)) ^ s.view(U))
    have = key(found.doc, found.anchor, found.s)
    order = np.argsort(have, kind="stable")
    asked = key(doc, *(flat.field(c).to_numpy() for c in ("anchor", "s")))
    lo, hi = (np.searchsorted(have[order], asked, side) for side in ("left", "right"))
    # a segment that a text holds more than once takes each of its marks as often
    times = hi - lo
    mark = np.repeat(np.arange(len(asked)), times)
    segment = order[np.arange(len(mark)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(lo, times)]
    first = found.first[segment] + flat.field("begin").to_numpy()[mark]
    count = pc.fill_null(flat.field("n"), -1).to_numpy()[mark]
    count = np.where(count < 0, found.count[segment], count)
    masks = flat.field("mask")
    some = masks.is_valid().to_numpy(zero_copy_only=False)[mark]
    starts, ends = [first[~some]], [first[~some] + count[~some] - 1 + window]
    if some.any():
        parts = masks.take(pa.array(mark[some])).to_pylist()
        bits = np.flatnonzero(np.unpackbits(np.frombuffer(b"".join(parts), np.uint8), bitorder="little"))
        begin = 8 * np.cumsum([0, *map(len, parts)])
        of = np.searchsorted(begin, bits, "right") - 1
        at = bits - begin[of]
        at = first[some][of] + at
        starts.append(at)
        ends.append(at + window)
    n = len(chunk.data) + 1
    edge = np.bincount(np.concatenate(starts), minlength=n) - np.bincount(np.concatenate(ends), minlength=n)
    return np.cumsum(edge[:-1]) > 0


def _cut(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """t, spans (removed runs of bytes) and kept_sha256 of texts with the segments and windows in ``marks`` removed."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            for c in chunks(batch.column(1), CHUNK_BYTES):
                gone = _places(c, _Segments(c, window, gram), batch.column(2), window)
                # a run ends where its document does
                limit = np.zeros(len(gone) + 1, bool)
                limit[c.off] = True
                before, after = np.concatenate([[False], gone]), np.concatenate([gone, [False]])
                starts = np.flatnonzero(after & (~before | limit))
                ends = np.flatnonzero(before & (~after | limit))
                cuts = np.searchsorted(starts, c.off).astype(np.int32)
                own = np.repeat(c.off[:-1], np.diff(cuts))
                spans = pa.StructArray.from_arrays([pa.array(starts - own), pa.array(ends - own)], fields=list(kind.value_type))
                kept = [hashlib.sha256(c.data[a:b][~gone[a:b]].tobytes()).hexdigest() for a, b in zip(c.off[:-1], c.off[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0)[c.lo : c.hi], pa.ListArray.from_arrays(cuts, spans), pa.array(kept)], names=["t", "spans", "kept_sha256"])

    return texts.select("t", "text", "marks").mapInArrow(run, f"t binary, spans {SPANS}, kept_sha256 string")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, cell: int = CELL) -> DataFrame:
    """doc_id, n_bytes, spans (start and end of every removed run of bytes), kept_sha256: a row per row of docs."""
    if not 0 < gram <= window:
        raise ValueError("gram must lie in 1 to window")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    docs = docs.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256)).withColumn("t", F.unhex(F.left("digest", F.lit(32))))
    prints = written(segments(docs, "doc_id", window, gram), "segments")
    own = prints.select("t", F.explode("segments").alias("x")).select("t", "x.*")

    # anchors that occur more than once: with one segment, or with several
    shared = own.groupBy("anchor").agg(F.min("s").alias("s"), F.max("s").alias("z"), F.count("*").alias("c")).filter("c > 1")
    shared = written(shared, "shared")
    several = shared.filter("s <> z").select("anchor")
    held = sifted(own, "anchor", sieve(several)).groupBy("anchor", "s").agg(F.count("*").alias("copies"), F.min("t").alias("t"))
    held = written(held.join(several, "anchor", "left_semi"), "held")

    # their distinct segments in pieces, each from one text; cores that occur more than once: with one piece, or with several
    wanted = written(held.groupBy("t").agg(F.collect_list(F.struct("anchor", "s")).alias("wanted")), "wanted")
    texts = sifted(docs.select("t", "text"), "t", sieve(wanted.select("t"))).groupBy("t").agg(F.first("text").alias("text"))
    width = min(BIN, max(1, window // 4))
    pieces = written(_pieces(texts.join(wanted, "t"), window, gram, width), "pieces")
    alike = pieces.groupBy("core").agg(F.min("piece").alias("piece"), F.max("piece").alias("z"), F.count("*").alias("c")).filter("c > 1")
    alike = written(alike, "alike")
    mixed = alike.filter("piece <> z").select("core")
    mine = sifted(pieces, "core", sieve(mixed)).join(mixed, "core", "left_semi")
    mine = written(mine.groupBy("core", "piece").agg(F.count("*").alias("c"), F.first("tail").alias("tail"), F.first("bytes").alias("bytes")), "strings")
    cells = mine.groupBy("core").agg(F.ceil(F.count("*") / F.lit(float(cell))).cast("int").alias("cells"))
    buckets = max(1, -(-mine.count() // cell))
    chunk = F.when(F.col("cells") == 1, F.pmod(F.xxhash64("core"), F.lit(buckets))).otherwise(F.xxhash64("core", F.pmod(F.xxhash64("piece"), F.col("cells"))))
    run, schema = _chunk_marks(window)
    found = mine.join(cells, "core").select(chunk.alias("chunk"), "core", "piece", "bytes", "tail", "cells")
    # chunks are small but take long, so they are dealt by their number and not by their bytes
    found = written(found.repartition(max(1, -(-buckets // 4)), "chunk").groupBy("chunk").applyInArrow(run, schema), "chunks")

    # cores cut over chunks: windows that are alone in theirs, but not in all
    classes = found.filter("h1 IS NOT NULL")
    again = classes.groupBy("core", "h1", "h2").agg(F.count("*").alias("c")).filter("c > 1").drop("c")
    alone = classes.filter("piece IS NOT NULL").join(again, ["core", "h1", "h2"])
    nothing = F.lit(None)
    all_of, mask = nothing.cast("int").alias("only"), nothing.cast("binary").alias("mask")
    good = alike.filter("piece = z").select("core", "piece", all_of, mask).unionByName(mine.filter("c > 1").select("core", "piece", all_of, mask))
    good = good.unionByName(found.filter("mask IS NOT NULL").select("core", "piece", all_of, "mask"))
    good = written(good.unionByName(alone.select("core", "piece", F.col("at").alias("only"), mask)), "good")
    rows = sifted(pieces.drop("bytes"), "core", sieve(good.select("core"))).join(good, ["core", "piece"])
    begin = F.col("begin") + F.coalesce("only", F.lit(0))
    marks = rows.select("anchor", "s", begin.alias("begin"), F.when(F.col("only").isNull(), F.col("n")).otherwise(1).alias("n"), "mask")
    whole = [F.lit(0).alias("begin"), nothing.cast("int").alias("n"), mask]
    marks = marks.unionByName(shared.filter("s = z").select("anchor", "s", *whole)).unionByName(held.filter("copies > 1").select("anchor", "s", *whole))
    marks = written(marks.withColumn("both", F.xxhash64("anchor", "s")), "marks")
    discard(wanted, shared, held, pieces, alike, mine, found, good)

    # texts that occur twice are repeated whole; the others get their marks
    none = F.sha2(F.lit("").cast("binary"), 256)
    twins = prints.groupBy("t").agg(F.count("*").alias("c"), F.first("n_bytes").alias("n_bytes")).filter((F.col("c") > 1) & (F.col("n_bytes") >= window))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end"))).alias("spans")
    twins = written(twins.select("t", whole, none.alias("kept_sha256")), "twins")
    mine = sifted(own.withColumn("both", F.xxhash64("anchor", "s")), "both", sieve(marks.select("both"))).drop("both").distinct()
    mine = without(mine.join(marks.drop("both"), ["anchor", "s"]), "t", twins.select("t"))
    lists = written(mine.groupBy("t").agg(F.collect_list(F.struct("anchor", "s", "begin", "n", "mask")).alias("marks")), "lists")
    cut = _cut(sifted(docs.select("t", "text"), "t", sieve(lists.select("t"))).join(lists, "t"), window, gram)
    changed = written(cut.unionByName(twins), "changed")
    discard(marks, lists, twins)
    rows = prints.select("doc_id", "n_bytes", "digest", "t")
    touched = sieve(changed.select("t"))
    nothing = F.expr(f"cast(array() AS {SPANS})")
    kept = sifted(rows, "t", touched, among=False).select("doc_id", "n_bytes", nothing.alias("spans"), F.col("digest").alias("kept_sha256"))
    some = sifted(rows, "t", touched).join(changed, "t", "left")
    return kept.unionByName(some.select("doc_id", "n_bytes", F.coalesce("spans", nothing).alias("spans"), F.coalesce("kept_sha256", "digest").alias("kept_sha256")))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_spans(read(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
