"""Bounded-space online packing of token ids into fixed windows.

Each partition keeps at most ``open_windows`` windows open.  A document longer
than a window is cut into full windows and a rest; a rest goes to the open window
that it fits best; when it fits none, a new window is opened, and if that would
be one too many the fullest is emitted first.  What is open at the end of a
partition is merged in a second step, best fit again, by groups of partitions, so
that no task ever holds more than ``merge_partitions * open_windows`` windows.

Every id lies in exactly one piece; offsets in a window are gapless from 0.
Edge cases: null text is empty and holds only the end id; repeated rows are packed
each; an empty table gives no pieces; extra columns are not read.  The pieces are written once to the shared
folder, so a lost executor never repacks differently what was already read.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import encode, read, written

WINDOW = 1024
OPEN_WINDOWS = 64
MERGE_PARTITIONS = 64
END_ID = 0
#: Window numbers: merged windows have this bit; then the partition or group, then a counter.
MERGED = 1 << 62


class Packer:
    """Open windows of one partition.  place() returns (window, offset, windows that are closed now)."""

    def __init__(self, size: int, most: int, first: int):
        self.size, self.most, self.next = size, most, first
        self.open: list[tuple[int, int]] = []  # (room left, window), sorted

    def place(self, length: int) -> tuple[int, int, list[int]]:
        closed = []
        at = bisect_left(self.open, (length, -1))
        if at < len(self.open):
            room, window = self.open.pop(at)
        else:
            if length < self.size and len(self.open) >= self.most:
                closed.append(self.open.pop(0)[1])  # the fullest is emitted
            room, window = self.size, self.next
            self.next += 1
        if room > length:
            insort(self.open, (room - length, window))
        else:
            closed.append(window)
        return window, self.size - room, closed


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    open_windows: int = OPEN_WINDOWS,
    merge_partitions: int = MERGE_PARTITIONS,
    folder: str | None = None,
) -> DataFrame:
    """doc_id, start, length, ids (binary, little-endian uint32), doc_tokens, sequence_id, offset: a row per piece."""
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "part", "closed"]

    def run(batches):
        part = TaskContext.get().partitionId()
        packer, held, ready = Packer(window, open_windows, part << 32), {}, []  # held: pieces of the open windows
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.append(encode(text, folder), np.uint32(END_ID)).astype("<u4")
                for start in range(0, len(ids), window):
                    piece = ids[start : start + window]
                    seq, offset, closed = packer.place(len(piece))
                    held.setdefault(seq, []).append((doc_id, start, len(piece), piece.tobytes(), len(ids), seq, offset))
                    for w in closed:
                        ready += held.pop(w)
                if len(ready) >= 4096:
                    yield table(ready, part, True)
                    ready = []
        if ready:
            yield table(ready, part, True)
        if held:
            yield table([row for rows in held.values() for row in rows], part, False)

    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(docs.schema[id_col].dataType), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

    def table(rows, part, closed):
        ends = [pa.array([part] * len(rows), pa.int64()), pa.array([closed] * len(rows), pa.bool_())]
        return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(zip(*rows), types)), *ends], names=names)

    pieces = written(docs.select(id_col, text_col).mapInArrow(run, schema + ", part long, closed boolean"), "pieces")
    closed = pieces.filter("closed")
    rest = pieces.filter("NOT closed")

    def merge(key, group):
        seq, offset, length = (group.column(c).to_numpy() for c in ("sequence_id", "offset", "length"))
        windows, inverse = np.unique(seq, return_inverse=True)
        fill = np.bincount(inverse, length, len(windows)).astype(int)
        packer = Packer(window, len(windows) + 1, MERGED | (key[0].as_py() << 32))
        to, shift = np.empty(len(windows), np.int64), np.empty(len(windows), np.int64)
        for i in np.argsort(-fill, kind="stable"):
            to[i], shift[i], _ = packer.place(int(fill[i]))
        group = group.set_column(group.schema.get_field_index("sequence_id"), "sequence_id", pa.array(to[inverse]))
        group = group.set_column(group.schema.get_field_index("offset"), "offset", pa.array(offset + shift[inverse]))
        return group.select(names[:-2])

    merged = rest.withColumn("group", F.expr(f"part div {merge_partitions}")).groupBy("group").applyInArrow(merge, schema)
    return closed.select(*names[:-2]).unionByName(merged.select(*names[:-2]))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(read(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
