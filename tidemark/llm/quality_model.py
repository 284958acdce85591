"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One vector of hashed-text weights is shared by all grades; ordered thresholds
cut its score into grades: P(grade <= k) = sigmoid(threshold_k - w.x).  The
expected grade ranks documents and a tail probability selects them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import Rows, adam, collected, labelled_sample, sigmoid
from .words import word_parts

BUCKET_BITS = 16
#: Documents with P(grade >= 1) of at least this are selected.
SELECT = 0.5


def _features(column: pa.Array) -> list[list[np.ndarray]]:
    """Buckets of words, word beginnings and word ends, and their counts; repetition is a feature of its own."""
    h, at = word_parts(column, heads=(4,), tails=(2, 3))
    b = (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    index, count = [], []
    for i in range(len(at) - 1):
        own = b[:, at[i] : at[i + 1]]
        n = own.shape[1]
        ids, times = np.unique(own, return_counts=True)
        if n:
            distinct = len(np.unique(own[0])) / n
            mark = (1 << BUCKET_BITS) + int(distinct * 10)
            ids, times = np.append(ids, mark), np.append(times, max(1, int(times.max())))
        index.append(ids.astype(np.int32))
        count.append(times.astype(np.int32))
    return [index, count]


WIDTH = (1 << BUCKET_BITS) + 11


def _scaled(count: np.ndarray) -> np.ndarray:
    v = np.log1p(count)
    return v / max(1e-9, float(np.sqrt((v * v).sum())))


class Model:
    """Weights and ascending thresholds of grades 0 .. len(thresholds)."""

    def __init__(self, weight: np.ndarray, thresholds: np.ndarray):
        self.weight, self.thresholds = weight, thresholds

    def tails(self, column: pa.Array) -> np.ndarray:
        """P(grade >= k) for k = 1 .. K, a row per text."""
        index, count = _features(column)
        z = Rows(index, [_scaled(c) for c in count], WIDTH).dot(self.weight.astype(float))
        return sigmoid(z[:, None] - self.thresholds[None, :])


def _cuts(p: np.ndarray) -> np.ndarray:
    """Ascending thresholds of the first one and the logarithms of the gaps."""
    return p[0] + np.concatenate([[0.0], np.cumsum(np.exp(p[1:]))])


def slope(x: Rows, grades: np.ndarray, top: int, ridge: float):
    """The gradient of the mean negative log-likelihood of the cumulative logits, with a ridge on the weights."""
    n, width = max(1, len(grades)), x.width

    def gradient(p):
        w, cuts = p[:width], _cuts(p[width:])
        t = sigmoid(x.dot(w)[:, None] - cuts[None, :])
        upper = np.concatenate([np.ones((len(t), 1)), t], 1)
        lower = np.concatenate([t, np.zeros((len(t), 1))], 1)
        at = np.arange(len(t))
        g = grades.astype(int)
        chance = np.maximum(upper[at, g] - lower[at, g], 1e-9)
        slope_up = upper[at, g] * (1 - upper[at, g])
        slope_low = lower[at, g] * (1 - lower[at, g])
        dz = -(slope_up - slope_low) / chance / n
        dcut = np.zeros_like(t)
        has_up, has_low = g >= 1, g < top
        dcut[at[has_up], g[has_up] - 1] += (slope_up / chance / n)[has_up]
        dcut[at[has_low], g[has_low]] -= (slope_low / chance / n)[has_low]
        by_cut = dcut.sum(0)
        rest = np.cumsum(by_cut[::-1])[::-1]
        return np.concatenate([x.back(dz) + ridge * w / n, [by_cut.sum()], rest[1:] * np.exp(p[width + 1 :])])

    return gradient


def fit(grades: np.ndarray, index: list[np.ndarray], count: list[np.ndarray], ridge: float = 0.02) -> Model:
    """Maximum likelihood of the cumulative logits with a ridge; gaps of thresholds stay positive."""
    top = max(1, int(grades.max()) if len(grades) else 1)
    x = Rows(index, [_scaled(c) for c in count], WIDTH)
    share = np.array([(grades >= k).mean() if len(grades) else 0.5 for k in range(1, top + 1)]).clip(0.01, 0.99)
    first = -np.log(share / (1 - share))
    gaps = np.log(np.maximum(np.diff(first), 1e-2))
    p = adam(np.concatenate([np.zeros(WIDTH), [first[0]], gaps]), slope(x, grades, top, ridge), 150, 0.08)
    return Model(p[:WIDTH].astype(np.float32), _cuts(p[WIDTH:]))


def train(docs: DataFrame, ratings: DataFrame) -> Model:
    """Fit on a bounded sample of rated rows (`linear.SAMPLE_ROWS`); `ratings` has doc_id and an integer grade."""
    y, (index, count) = collected(labelled_sample(docs, ratings), _features, 2)
    return fit(y, index, count)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, expected_grade, tails) of every row.

    Null and empty texts have no feature and score by the thresholds alone;
    repeated rows are scored one by one; other columns are ignored.
    """

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                t = model.tails(batch.column(1))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(t.sum(1), pa.float64()), pa.array(list(t), pa.list_(pa.float64()))], names=["doc_id", "expected_grade", "tails"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, expected_grade double, tails array<double>")


def op2_quality_model(spark, sf_dir: str) -> DataFrame:
    """Grades from the labels table: 0 low quality, 1 good but toxic, 2 good."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    out = score(docs, train(docs, labels.where("quality is not null").select("doc_id", grade.alias("grade"))))
    return out.select("doc_id", "expected_grade", F.get("tails", F.lit(0)).alias("tail_probability"), (F.get("tails", F.lit(0)) >= SELECT).alias("selected"))
