"""Sparse rows of hashed text features and how labelled ones reach the driver."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a model is fitted on, at most: the documented bound of training samples.
SAMPLE_ROWS = 6000


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Texts of at most `rows` labelled documents, least hash of the id first.

    `labels` has doc_id and a label; null labels are left out, repeated ids keep
    the highest label, repeated documents the least text.
    """
    names = [c for c in labels.columns if c != "doc_id"]
    label = names[0]
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return picked.groupBy("doc_id").agg(F.min("label").alias("label"), F.min("text").alias("text"))


def collected(sample: DataFrame, features: Callable[[pa.Array], list[list[np.ndarray]]], kinds: int) -> tuple[np.ndarray, list[list[np.ndarray]]]:
    """Labels, and `kinds` lists of int32 arrays, of a bounded sample, in the order of doc_id."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                got = features(batch.column(2))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int64()), *(pa.array([x.astype("<i4").tobytes() for x in k], pa.binary()) for k in got)], names=["doc_id", "label", *(f"f{i}" for i in range(kinds))])

    rows = sample.select("doc_id", "label", "text").mapInArrow(run, "doc_id long, label long, " + ", ".join(f"f{i} binary" for i in range(kinds))).toArrow().sort_by("doc_id")
    return rows["label"].to_numpy(), [[np.frombuffer(x, "<i4") for x in rows[f"f{i}"].to_pylist()] for i in range(kinds)]


class Rows:
    """Compressed sparse rows."""

    def __init__(self, index: list[np.ndarray], value: list[np.ndarray], width: int):
        self.size = np.array([len(x) for x in index], np.int64)
        self.row = np.repeat(np.arange(len(index)), self.size)
        self.index = np.concatenate(index).astype(np.int64) if index else np.zeros(0, np.int64)
        self.value = np.concatenate(value).astype(float) if value else np.zeros(0)
        self.width = width

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.index], minlength=len(self.size))

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.index, self.value * g[self.row], minlength=self.width)


def adam(start: np.ndarray, gradient: Callable[[np.ndarray], np.ndarray], steps: int, rate: float) -> np.ndarray:
    """Full-batch Adam; the same start and gradient give the same result."""
    w, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
