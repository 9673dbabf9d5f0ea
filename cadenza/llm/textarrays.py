"""Whole texts as numpy arrays, straight from Arrow string buffers.

Every helper works on one chunk: the UTF-8 bytes of some documents laid end to
end plus their offsets.  No Python string is made per word, so one pass costs a
few nanoseconds a byte.  Words are ``[^\\x20\\x09-\\x0D]+``; null texts are empty.

Hashes are 64-bit: polynomial sums over random byte values with an odd base
(invertible modulo 2**64, so any span is a difference of two prefix sums),
finished with an avalanche step.  Two different spans collide with probability
about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
CHUNK_BYTES = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values (splitmix64 finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(maxsize=None)
def _byte_values(seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, 257, dtype=U) * U(0x632BE59BD9B4E019) + U(seed * 2 + 1))


_powers = {_BASE: np.ones(1, U), _INVERSE: np.ones(1, U)}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; grown to the largest chunk seen."""
    have = _powers[base]
    if len(have) < n:
        have = np.full(max(n, CHUNK_BYTES + 1), U(base))
        have[0] = 1
        _powers[base] = have = np.cumprod(have, dtype=U)
    return have[:n]


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for every span (all non-empty)."""
    sums = np.cumsum(values * powers(_BASE, len(values)), dtype=U)
    before = np.where(starts > 0, sums[np.maximum(starts, 1) - 1], U(0))
    raw = (sums[ends - 1] - before) * powers(_INVERSE, len(values) + 1)[starts]
    return mix(raw + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


class Chunk:
    """Documents lo..hi of a batch: bytes, offsets, and the spans of their words."""

    def __init__(self, lo: int, hi: int, data: np.ndarray, off: np.ndarray):
        self.lo, self.hi, self.data, self.off = lo, hi, data, off
        self.n = hi - lo

    @property
    def docs(self) -> slice:
        return slice(self.lo, self.hi)

    def split(self) -> "Chunk":
        """Find the words: starts, ends (bytes) and woff (first word of each document)."""
        word = ~SEPARATOR[self.data]
        size = len(word)
        before, after = np.zeros(size, bool), np.zeros(size, bool)
        before[1:], after[:-1] = word[:-1], word[1:]
        edges = self.off[:-1][self.off[:-1] < size]
        before[edges] = False
        edges = self.off[1:][self.off[1:] > 0]
        after[edges - 1] = False
        self.word = word
        self.starts = np.flatnonzero(word & ~before)
        self.ends = np.flatnonzero(word & ~after) + 1
        self.woff = np.searchsorted(self.starts, self.off)
        return self

    def doc_of(self, offsets: np.ndarray) -> np.ndarray:
        """Document number of every item, given the items' document offsets."""
        return np.repeat(np.arange(self.n), np.diff(offsets))

    def word_hash(self, lower: bool = False, seed: int = 0) -> np.ndarray:
        table = _byte_values(seed)
        values = (table[LOWER] if lower else table)[self.data]
        return span_hash(values, self.starts, self.ends) if len(self.starts) else np.empty(0, U)

    def per_doc(self, flags: np.ndarray, offsets: np.ndarray | None = None) -> np.ndarray:
        """Sum of flags in each document."""
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        offsets = self.off if offsets is None else offsets
        return sums[offsets[1:]] - sums[offsets[:-1]]

    def windows(self, k: int) -> np.ndarray:
        """First word of every k-word window that lies in one document."""
        ends = np.repeat(self.woff[1:], np.diff(self.woff))
        at = np.arange(len(self.starts))
        return at[at + k <= ends]


def window_hash(words: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Hash of k consecutive word hashes from every position in ``at``."""
    return span_hash(words, at, at + k) if len(at) else np.empty(0, U)


def chunks(column: pa.Array | pa.ChunkedArray, max_bytes: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a text column into chunks of about max_bytes; a longer document is a chunk of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    _, offsets, values = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.empty(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + max_bytes, "right")) - 1)
        hi = min(hi, len(column))
        yield Chunk(lo, hi, data[off[lo] : off[hi]], (off[lo : hi + 1] - off[lo]).astype(np.int64))
        lo = hi


def distinct_in_docs(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each item's key occurs in its document, and whether the item is the first such."""
    with np.errstate(over="ignore"):
        both = mix(keys ^ mix(docs.astype(U) + U(1)))
    _, first, inverse, counts = np.unique(both, return_index=True, return_inverse=True, return_counts=True)
    is_first = np.zeros(len(keys), bool)
    is_first[first] = True
    return counts[inverse], is_first


SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
_CLASSES = {
    "n_upper": (65, 91),
    "n_lower": (97, 123),
    "n_digits": (48, 58),
    "n_high": (128, 256),
}


def statistics(chunk: Chunk) -> dict[str, np.ndarray]:
    """Counts for every document of a chunk that has been split."""
    data, out = chunk.data, {}
    point = (data & 0xC0) != 0x80
    out["n_bytes"] = np.diff(chunk.off)
    out["n_chars"] = chunk.per_doc(point)
    out["n_words"] = np.diff(chunk.woff)
    out["word_chars"] = chunk.per_doc(point & chunk.word)
    out["n_symbols"] = chunk.per_doc(SYMBOLS[data])
    for name, (a, b) in _CLASSES.items():
        out[name] = chunk.per_doc((data >= a) & (data < b))
    out["n_marks"] = chunk.per_doc((data == 33) | (data == 63))

    # lines: between \n, in one document
    size = len(data)
    newline = data == 10
    first = np.zeros(size + 1, bool)
    first[1:][newline] = True
    first[chunk.off[:-1]] = True
    starts = np.flatnonzero(first[:size])
    words_before = np.concatenate([[0], np.cumsum(chunk.word, dtype=np.int64)])
    ends = np.concatenate([starts[1:], [size]]) if len(starts) else starts
    loff = np.searchsorted(starts, chunk.off)
    closed = ends - (newline[ends - 1] if size else 0)
    has_word = words_before[closed] > words_before[starts] if size else np.empty(0, bool)
    docs = chunk.doc_of(loff)[has_word]
    keys = span_hash(_byte_values(0)[data], starts[has_word], closed[has_word]) if has_word.any() else np.empty(0, U)
    _, is_first = distinct_in_docs(keys, docs)
    out["n_lines"] = np.bincount(docs, minlength=chunk.n)
    out["n_dup_lines"] = np.bincount(docs[~is_first], minlength=chunk.n)

    # words of 3-word windows that occur twice or more in the document
    words = chunk.word_hash()
    at = chunk.windows(3)
    word_docs = chunk.doc_of(chunk.woff)
    counts, _ = distinct_in_docs(window_hash(words, at, 3), word_docs[at])
    covered = np.zeros(len(words) + 3, bool)
    twice = at[counts >= 2]
    for j in range(3):
        covered[twice + j] = True
    out["n_repeat_words"] = chunk.per_doc(covered[: len(words)], chunk.woff)
    _, is_first = distinct_in_docs(words, word_docs)
    out["n_unique_words"] = np.bincount(word_docs[is_first], minlength=chunk.n)
    return out
