"""Token counts with a whole-token shortcut.

Offline, every string of the vocabulary is encoded alone: those that come back
as one token are proven, and a pre-token that equals one counts 1 without any
merging.  Only the other pre-tokens are merged, each distinct one once per
worker while the bounded memo has room.

Edge cases: null text is empty (0 bytes, 0 tokens); special strings inside a text
are one token each, as the library's default; texts are never cut; repeated rows
count each; an empty table gives no rows.  One pass, no shuffle; only the id and text columns are read.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cadenza.llm.common import BYTE_BPE, byte_bpe, read, vocabulary_path

SPECIAL = "<|endoftext|>"
LIMIT = 1024
#: Most entries of a worker's memo of merged pre-tokens; beyond it the memo starts anew.
MEMO = 400_000


@lru_cache(maxsize=None)
def whole_tokens(folder: str | None = None) -> frozenset[str]:
    """Vocabulary strings proven to be one pre-token and one token when encoded alone."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary_path(BYTE_BPE, folder))
    decode = byte_bpe(folder).decode_single_token_bytes
    strings = []
    for i in range(tokenizer.get_vocab_size() - 1):
        try:
            strings.append((i, decode(i).decode("utf-8")))
        except UnicodeDecodeError:  # part of a character: no pre-token equals it
            continue
    found = tokenizer.encode_batch([s for _, s in strings], add_special_tokens=False)
    return frozenset(s for (i, s), e in zip(strings, found) if e.ids == [i])


class _Counts(dict):
    """Pre-token -> number of tokens."""

    def __init__(self, folder: str | None):
        import public_tokenizers
        import regex

        self.whole = dict.fromkeys(whole_tokens(folder), 1)
        self.merge = byte_bpe(folder).encode_ordinary
        self.find = regex.compile(public_tokenizers.PATTERN).findall
        super().__init__(self.whole)

    def __missing__(self, piece: str) -> int:
        if len(self) > MEMO + len(self.whole):
            self.clear()
            self.update(self.whole)
        n = self[piece] = len(self.merge(piece))
        return n

    def count(self, text: str) -> int:
        parts = text.split(SPECIAL)
        return len(parts) - 1 + sum(sum(map(self.__getitem__, self.find(p))) for p in parts)


@lru_cache(maxsize=None)
def _counts(folder: str | None) -> _Counts:
    return _Counts(folder)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, folder: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        counts = _counts(folder)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = [counts.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array(n, pa.int64()),
                    pa.array([x > limit for x in n], pa.bool_()),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_tokens long, over_limit boolean")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"))
