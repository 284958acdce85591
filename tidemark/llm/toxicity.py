"""Toxicity: a logistic classifier regularised by counterfactual identity swaps.

A text is the set of hashed words and word beginnings it holds.  Each labelled
text that names a group is paired with the same text with its identity terms
swapped for those of another group, and the squared change of the score is
penalised, so that naming a group does not make a text toxic.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import Rows, adam, collected, labelled_sample, sigmoid
from .words import word_parts

#: Identity terms by language; a term is swapped with the next one of its list.
IDENTITY = (
    ("women", "men", "girls", "boys", "woman", "man", "girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("femmes", "hommes", "musulmans", "chrétiens", "juifs", "noirs", "blancs", "homosexuels"),
    ("frauen", "männer", "muslime", "christen", "juden", "schwarze", "weiße", "homosexuelle"),
    ("mujeres", "hombres", "musulmanes", "cristianos", "judíos", "negros", "blancos", "homosexuales"),
)
BUCKET_BITS = 22
HEADS = (4, 5, 6)
#: Features kept after screening.
MOST_FEATURES = 4000
LEAST_SUPPORT = 3
THRESHOLD = 0.7
_SWAP = {t: group[(i + 1) % len(group)] for group in IDENTITY for i, t in enumerate(group)}
_TERM = re.compile(r"\b(" + "|".join(sorted(_SWAP, key=len, reverse=True)) + r")\b", re.IGNORECASE)


def swapped(text: str) -> str:
    """The text with each identity term replaced by its counterpart."""
    return _TERM.sub(lambda m: _SWAP[m[0].lower()], text)


def _buckets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    h, at = word_parts(column, heads=HEADS)
    return (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int32), at


def _sets(column: pa.Array) -> list[np.ndarray]:
    b, at = _buckets(column)
    return [np.unique(b[:, at[i] : at[i + 1]]) for i in range(len(at) - 1)]


def _pairs(column: pa.Array) -> list[list[np.ndarray]]:
    plain = _sets(column)
    other = [swapped(t) for t in column.to_pylist()]
    changed = [i for i, t in enumerate(column.to_pylist()) if t != other[i]]
    alt = [np.zeros(0, np.int32)] * len(plain)
    for i, s in zip(changed, _sets(pa.array([other[i] for i in changed], pa.string())) if changed else [], strict=True):
        alt[i] = s
    return [plain, alt]


class Model:
    """Weights of screened buckets and a bias."""

    def __init__(self, bucket: np.ndarray, weight: np.ndarray, bias: float):
        self.bucket, self.weight, self.bias = bucket, weight, bias

    def score(self, column: pa.Array) -> np.ndarray:
        b, at = _buckets(column)
        known = np.zeros(1 << BUCKET_BITS, bool)
        known[self.bucket] = True
        kind, place = np.nonzero(known[b])
        row = np.searchsorted(at, place, "right") - 1
        once = np.unique(row.astype(np.int64) << 32 | b[kind, place])
        weight = self.weight[np.searchsorted(self.bucket, once & 0xFFFFFFFF)]
        return sigmoid(self.bias + np.bincount(once >> 32, weight, minlength=len(at) - 1))


def fit(labels: np.ndarray, sets: list[np.ndarray], others: list[np.ndarray], counterfactual: float = 1.0, ridge: float = 0.002) -> Model:
    """Screen buckets by how far their document counts depart from the label rate, then fit."""
    y = (labels > 0).astype(float)
    n = len(y)
    if not n or y.min() == y.max():
        rate = float(np.clip(y.mean() if n else 0.0, 0.01, 0.99))
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(rate / (1 - rate))))
    size = 1 << BUCKET_BITS
    everything = np.concatenate(sets)
    df = np.bincount(everything, minlength=size)
    pos = np.bincount(everything, np.repeat(y, [len(s) for s in sets]), minlength=size)
    rate = y.mean()
    z = (pos - df * rate) / np.sqrt(np.maximum(df, 1) * rate * (1 - rate))
    ok = np.flatnonzero((df >= LEAST_SUPPORT) & (np.abs(z) >= 3.5))
    bucket = np.sort(ok[np.argsort(-np.abs(z[ok]), kind="stable")[:MOST_FEATURES]])
    place = np.full(size, -1, np.int64)
    place[bucket] = np.arange(len(bucket))
    cut = lambda s: place[s][place[s] >= 0]
    x = Rows([cut(s) for s in sets], [np.ones(len(cut(s))) for s in sets], len(bucket))
    paired = [i for i, s in enumerate(others) if len(s)]
    change = Rows([np.concatenate([cut(sets[i]), cut(others[i])]) for i in paired], [np.concatenate([np.ones(len(cut(sets[i]))), -np.ones(len(cut(others[i])))]) for i in paired], len(bucket))

    def gradient(w):
        miss = (sigmoid(x.dot(w[:-1]) + w[-1]) - y) / n
        g = x.back(miss) + ridge * w[:-1] / n * 10
        if paired:
            g += counterfactual * 2 / len(paired) * change.back(change.dot(w[:-1]))
        return np.append(g, miss.sum())

    w = adam(np.append(np.zeros(len(bucket)), np.log(rate / (1 - rate))), gradient, 400, 0.05)
    return Model(bucket, w[:-1], float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, **options) -> Model:
    """Fit on a bounded labelled sample (`linear.SAMPLE_ROWS`)."""
    y, (sets, others) = collected(labelled_sample(docs, labels), _pairs, 2)
    return fit(y, sets, others, **options)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row: the probability that the text is toxic.

    Null and empty texts score the bias alone; repeated rows are scored one by
    one; other columns are ignored.
    """

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(batch.column(1)), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    """Contract query: labels are learnt from rows whose crc32(doc_id) mod 3 is not 1."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold != 1).select("doc_id", "toxic")
    out = score(docs, train(docs, labels))
    return out.select("doc_id", (fold == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
