"""Quality classifier: regularised quadratic discriminant over document statistics.

Per document ten transformed statistics of the whole text.  Per class a mean and
a covariance shrunk towards its diagonal and towards the pooled covariance.  The
score is the posterior of label 1: a difference of Mahalanobis log densities,
each from a Cholesky factor computed once on the driver (10 x 10).

Edge cases: a null text is empty; an empty text has all statistics 0 and is
scored like any other; null labels or null ids never train; with one class only
every score is that class' share; repeated rows are scored each, and repeated label rows
train as often as they stand; an empty table gives no rows.  Extra columns
are not looked at; the added columns' names can be chosen.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.llm.common import fresh, nullable, read, written
from cadenza.llm.textarrays import chunks, statistics

FEATURES = (
    "log_words",
    "word_length",
    "symbol_share",
    "upper_share",
    "digit_share",
    "mark_share",
    "dup_line_share",
    "repeat_share",
    "unique_share",
    "other_share",
)


def features(stats: dict[str, np.ndarray]) -> np.ndarray:
    """n x 10 matrix; shares go through an arcsine root, so that rare events still count."""
    chars = np.maximum(stats["n_chars"], 1)
    words = np.maximum(stats["n_words"], 1)
    letters = np.maximum(stats["n_upper"] + stats["n_lower"] + stats["n_high"], 1)
    root = lambda a, b: np.arcsin(np.sqrt(np.clip(a / b, 0, 1)))
    return np.column_stack(
        [
            np.log1p(stats["n_words"]),
            np.log1p(stats["word_chars"] / words),
            root(stats["n_symbols"], chars),
            root(stats["n_upper"], letters),
            root(stats["n_digits"], chars),
            root(stats["n_marks"], chars),
            root(stats["n_dup_lines"], np.maximum(stats["n_lines"], 1)),
            root(stats["n_repeat_words"], words),
            root(stats["n_unique_words"], words) / np.maximum(np.log1p(np.log1p(words)), 0.5),
            root(
                stats["n_bytes"] - stats["n_upper"] - stats["n_lower"] - stats["n_high"] - stats["n_words"],
                np.maximum(stats["n_bytes"], 1),
            ),
        ]
    )


def with_features(docs: DataFrame, text_col: str = "text", name: str = "qda_features") -> tuple[DataFrame, str]:
    """docs with an array<double> of statistics; one pass, no shuffle."""
    name = fresh(docs, name)
    schema = T.StructType([*nullable(docs.schema), T.StructField(name, T.ArrayType(T.DoubleType()))])
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            parts = [features(statistics(c.split())) for c in chunks(batch.column(at))]
            flat = np.concatenate(parts).ravel() if parts else np.empty(0)
            lists = pa.ListArray.from_arrays(
                np.arange(0, len(flat) + 1, len(FEATURES), dtype=np.int32), pa.array(flat, pa.float64())
            )
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, schema), name


class Discriminant:
    """Two Gaussian classes with shrunk covariances and cached Cholesky factors."""

    def __init__(self, n: np.ndarray, mean: np.ndarray, cov: np.ndarray, to_pooled: float, to_diagonal: float, floor: float):
        self.n, self.share = n, n[1] / max(n.sum(), 1)
        self.one_class = min(n) < 2
        if self.one_class:
            return
        pooled = (n[0] * cov[0] + n[1] * cov[1]) / n.sum()
        self.mean, self.inverse, self.const = mean, [], []
        for c in range(2):
            s = (1 - to_pooled) * cov[c] + to_pooled * pooled
            s = (1 - to_diagonal) * s + to_diagonal * np.diag(np.diag(s)) + floor * np.eye(len(s))
            chol = np.linalg.cholesky(s)
            self.inverse.append(np.linalg.inv(chol))
            self.const.append(np.log(n[c] / n.sum()) - np.log(np.diag(chol)).sum())

    def score(self, x: np.ndarray) -> np.ndarray:
        """Posterior of label 1."""
        if self.one_class:
            return np.full(len(x), self.share)
        logs = [k - 0.5 * (((x - m) @ inv.T) ** 2).sum(1) for k, m, inv in zip(self.const, self.mean, self.inverse)]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def fit(
    labelled: DataFrame,
    feature_col: str,
    label_col: str,
    to_pooled: float = 0.05,
    to_diagonal: float = 0.05,
    floor: float = 1e-4,
) -> Discriminant:
    """Fit on all labelled rows: sums and outer products per partition, added up by Spark.

    What reaches the driver is 2 * (1 + d + d*d) numbers, whatever the input.
    """
    d = len(FEATURES)

    def partial(batches):
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            y = batch.column(1).to_numpy(zero_copy_only=False)
            x = batch.column(0).flatten().to_numpy().reshape(-1, d)
            for c in range(2):
                part = x[y == c]
                total[c] += np.concatenate([[len(part)], part.sum(0), (part.T @ part).ravel()])
        yield pa.RecordBatch.from_pydict(
            {
                "label": pa.array(np.repeat([0, 1], total.shape[1]), pa.int32()),
                "pos": pa.array(np.tile(np.arange(total.shape[1]), 2), pa.int32()),
                "value": pa.array(total.ravel()),
            }
        )

    rows = (
        labelled.filter(F.col(label_col).isin(0, 1) & F.col(feature_col).isNotNull())
        .select(F.col(feature_col), F.col(label_col).cast("int"))
        .mapInArrow(partial, "label int, pos int, value double")
        .groupBy("label", "pos")
        .agg(F.sum("value").alias("value"))
        .collect()
    )
    total = np.zeros((2, 1 + d + d * d))
    for r in rows:
        total[r.label, r.pos] = r.value
    n = total[:, 0]
    safe = np.maximum(n, 1)[:, None]
    mean = total[:, 1 : d + 1] / safe
    cov = total[:, d + 1 :].reshape(2, d, d) / safe[:, :, None] - mean[:, :, None] * mean[:, None, :]
    return Discriminant(n, mean, cov, to_pooled, to_diagonal, floor)


def with_score(df: DataFrame, feature_col: str, model: Discriminant, name: str = "score") -> tuple[DataFrame, str]:
    """df without the statistics, with the posterior."""
    name = fresh(df, name)
    kept = [c for c in df.columns if c != feature_col]
    schema = T.StructType([*(f for f in nullable(df.schema) if f.name != feature_col), T.StructField(name, T.DoubleType())])
    at = df.columns.index(feature_col)

    def run(batches):
        for batch in batches:
            x = batch.column(at).flatten().to_numpy().reshape(-1, len(FEATURES))
            cols = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(model.score(x))], names=[*kept, name])

    return df.mapInArrow(run, schema), name


def held_out(id_col: str = "doc_id", modulus: int = 4, remainder: int = 2):
    """True for ids of the held-out fold (crc32 of the id's decimal text); false for null ids."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def train(feats: DataFrame, feature_col: str, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Discriminant:
    """Fit on the labelled rows outside the held-out fold."""
    y = labels.filter(~held_out(id_col)).select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label"))
    x = feats.select(F.col(id_col).alias("_id"), feature_col)
    return fit(x.join(y, "_id"), feature_col, "_label")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    feats, name = with_features(docs)
    feats = written(feats.drop("text"), "qda")
    model = train(feats, name, read(spark, sf_dir, "labels"))
    scored, score = with_score(feats, name, model)
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        F.col(score).alias("score"),
        (F.col(score) >= 0.7).cast("int").alias("predicted"),
    )
