"""Quality rules from tokeniser fertility, per language or script.

Two public vocabularies read every whole text: the byte-level BPE gives
characters per token and the entropy of its tokens; the piece vocabulary gives
the share of its tokens that fall back to bytes.  A document is rejected when a
measure leaves the band of its language, or of its script where the language has
no band.  The bands are fixed, so a document's verdict depends on no other row.
Byte tokens for ASCII (line ends) are not counted as fallback.

Edge cases: null or blank texts have no words, fail the base rule and measure 0;
null or unknown languages use their script's bands; repeated rows are judged
each; an empty table gives no rows; extra columns are not read.  The texts are read once, and nothing is shuffled or collected.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import encode, read, vocabulary_path
from cadenza.llm.textarrays import chunks, statistics


@dataclass(frozen=True)
class Band:
    chars_per_token: tuple[float, float]
    byte_share: tuple[float, float]
    entropy: tuple[float, float]


#: Bands by language code, then by script.  Words of inflected or accented languages need more tokens.
BANDS = {
    "en": Band((2.0, 6.5), (0.0, 0.02), (4.0, 14.0)),
    "de": Band((1.9, 6.5), (0.0, 0.02), (4.0, 14.0)),
    "fr": Band((1.8, 6.0), (0.0, 0.02), (4.0, 14.0)),
    "es": Band((1.8, 6.0), (0.0, 0.02), (4.0, 14.0)),
    "latin": Band((1.7, 6.5), (0.0, 0.05), (4.0, 14.0)),
    "other": Band((0.3, 6.5), (0.0, 0.6), (4.0, 14.0)),
}
SCHEMA = (
    "doc_id {id}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, in_band boolean, n_tokens long, chars_per_token double, byte_share double, token_entropy double, band string"
)


@lru_cache(maxsize=None)
def _pieces(folder: str | None):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path("piece_bpe_32k.model", folder))
    value = [int(model.IdToPiece(i)[3:5], 16) if model.IsByte(i) else 0 for i in range(model.GetPieceSize())]
    is_byte = np.array(value) >= 128
    return model, is_byte


def entropy(ids: np.ndarray) -> float:
    """Bits per token of one text."""
    share = np.unique(ids, return_counts=True)[1] / max(len(ids), 1)
    return float(-(share * np.log2(share)).sum())


def measures(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str | None = "lang",
    bands: dict[str, Band] = BANDS,
    folder: str | None = None,
) -> DataFrame:
    """One row per document: base counts, measures, and whether they lie in the fixed band."""
    id_type = docs.schema[id_col].dataType.simpleString()
    cols = [id_col, text_col] + ([lang_col] if lang_col else [])

    def run(batches):
        model, is_byte = _pieces(folder)
        for batch in batches:
            langs = batch.column(2).to_pylist() if lang_col else [None] * batch.num_rows
            for c in chunks(batch.column(1)):
                s = statistics(c.split())
                texts = [c.data[a:b].tobytes().decode() for a, b in zip(c.off[:-1], c.off[1:])]
                wide = c.per_doc(c.data >= 0xCE) * 4 > s["n_chars"]
                n_tokens, share, bits = np.zeros(c.n, np.int64), np.zeros(c.n), np.zeros(c.n)
                for i, (text, other) in enumerate(zip(texts, model.encode(texts, num_threads=1))):
                    ids = encode(text, folder)
                    n_tokens[i], bits[i] = len(ids), entropy(ids)
                    share[i] = is_byte[other].mean() if other else 0.0
                fertility = s["n_chars"] / np.maximum(n_tokens, 1)
                failed = (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])
                names = [
                    lang if lang in bands else ("other" if w else "latin") for lang, w in zip(langs[c.docs], wide)
                ]
                inside = np.array(
                    [
                        all(lo <= v <= hi for v, (lo, hi) in zip(m, (b.chars_per_token, b.byte_share, b.entropy)))
                        for m, b in zip(zip(fertility, share, bits), map(bands.__getitem__, names))
                    ],
                    bool,
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[c.lo : c.hi],
                        *(pa.array(s[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
                        pa.array(failed),
                        pa.array(inside),
                        pa.array(n_tokens),
                        pa.array(fertility),
                        pa.array(share),
                        pa.array(bits),
                        pa.array(names, pa.string()),
                    ],
                    names=[f.split()[0] for f in SCHEMA.split(", ")],
                )

    return docs.select(*cols).mapInArrow(run, SCHEMA.format(id=id_type))


def fertility_rules(docs: DataFrame, **options) -> DataFrame:
    """Measures and verdict."""
    return measures(docs, **options).withColumn("kept", ~F.col("base_failed") & F.col("in_band"))


def op1_fertility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility_rules(read(spark, sf_dir, "documents"))
