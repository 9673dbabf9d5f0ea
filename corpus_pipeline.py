"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; all but the last return the columns of documents.  Rows with a null doc_id
are scored, redacted and packed, but cannot be named by the stages that decide by
id, and so are never taken for duplicates or for contaminated.  Null and empty texts are
scored like others, have no shingles and no passages, and are packed as their end alone; rows that
repeat an id are one document, kept once by the Jaccard join; of equally near duplicates the one
with the smallest id stays; texts of any length are worked on whole; an empty table gives no rows.

A stage's table is deleted as soon as the next one is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import discard, read, small_batches, without, written
from cadenza.llm.decontaminate import contaminated
from cadenza.llm.jaccard_join import jaccard_components
from cadenza.llm.packing import pack
from cadenza.llm.pii import redacted
from cadenza.llm.quality_qda import train, with_features, with_score

#: Score from which the quality classifier keeps a document.
KEEP_SCORE = 0.7
#: Near duplicates: shingles of five words, similarity of 0.8 or more.
SHINGLE_WORDS, PERCENT = 5, 80


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the discriminant accepts."""
    feats, name = with_features(docs.select("doc_id", "text"))
    model = train(feats, name, read(spark, sf_dir, "labels"))
    whole, name = with_features(docs)
    scored, score = with_score(whole, name, model)
    return scored.filter(F.col(score) >= KEEP_SCORE).select(*docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id, once."""
    groups = jaccard_components(docs, k=SHINGLE_WORDS, percent=PERCENT).filter("doc_id IS NOT NULL")
    groups = written(groups.groupBy("doc_id").agg(F.count_if(F.col("doc_id") == F.col("component_id")).alias("first")), "groups")
    kept = without(docs.filter("doc_id IS NOT NULL"), "doc_id", groups.filter("first = 0").select("doc_id"))
    if not groups.filter("first > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id"])
    return kept.select(*docs.columns).unionByName(docs.filter("doc_id IS NULL"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage that aligns with a test item."""
    found = contaminated(docs, read(spark, sf_dir, "benchmark"))
    return without(docs, "doc_id", found.select("doc_id").distinct())


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents, personal data replaced by its kind; n_chars follows the text."""
    small_batches(spark)
    return redacted(docs, "text", "n_chars")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences, a row each, with their token ids."""
    return pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("PII", pii),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents."""
    docs = read(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            before, docs = docs, written(docs, f"stage-{number}")
            discard(before)
    return docs


#: The stages fit models, align and tokenise; SQL cannot express them.  tests/llm holds brute-force versions.
ORACLE_SQL = None
