"""Soft-membership mixing of documents to target domain weights.

A multinomial classifier fitted on a labelled table gives every document a
posterior over domains.  Document rates r >= least then minimise the squared
distance of the expected domain totals, sum of n * r * p, from the targets.  The
problem is solved by accelerated projected gradient in the metric of token
counts: an iteration is one pass that adds up as many numbers as there are
domains, and a document's rate follows from its posterior and the gradients so
far, so nothing but those gradients is carried along.  What a fixed number of
iterations leaves is closed by Newton's method on the dual problem, whose unknowns
are as many as domains: the rates of least change that reach the targets, or come
as near to them as their bound allows.
"""

from __future__ import annotations

import logging
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import Rows, adam, collected, labelled_sample
from .words import word_parts
from .workspace import Workspace, boxed, row_keys, unboxed

BUCKET_BITS = 14
#: Features are shares of a text's words, times this.
SCALE = 30.0
#: Labelled rows that the classifier is fitted on, at most.
SAMPLE_ROWS = 2000
MOST_STEPS = 40
TOLERANCE = 1e-4
#: Weight of the change of rates against the distance from the targets, by the largest curvature.
RIDGE = 1e-7

#: Target shares of tokens by domain: languages of sound text, and low-quality text.
TARGETS = {"de": 0.15, "en": 0.55, "es": 0.10, "fr": 0.15, "low": 0.05}


def _buckets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    h, at = word_parts(column, heads=(4,))
    return (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), at


def _features(column: pa.Array) -> list[list[np.ndarray]]:
    b, at = _buckets(column)
    found = [np.unique(b[:, at[i] : at[i + 1]], return_counts=True) for i in range(len(at) - 1)]
    return [[i.astype(np.int32) for i, _ in found], [c.astype(np.int32) for _, c in found]]


class Classifier:
    """Multinomial logistic weights over hashed words."""

    def __init__(self, weight: np.ndarray, bias: np.ndarray):
        self.weight, self.bias = weight, bias

    def posteriors(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(words of each text, posterior of each text)."""
        b, at = _buckets(column)
        n = np.diff(at)
        out = np.empty((len(n), len(self.bias)))
        row = np.repeat(np.arange(len(n)), n)
        for k, w in enumerate(self.weight):
            out[:, k] = np.bincount(row, w[b].sum(0), minlength=len(n)) * SCALE / np.maximum(n, 1) / 2 + self.bias[k]
        out = np.exp(out - out.max(1, keepdims=True))
        return n, out / out.sum(1, keepdims=True)


def fit(labels: np.ndarray, index: list[np.ndarray], count: list[np.ndarray], domains: int, ridge: float = 0.1) -> Classifier:
    """Maximum likelihood with a ridge; a domain without rows keeps a small prior."""
    width, n = 1 << BUCKET_BITS, max(1, len(labels))
    x = Rows(index, [c * SCALE / max(1, c.sum()) for c in count], width)
    y = np.zeros((len(labels), domains))
    y[np.arange(len(labels)), labels.astype(int)] = 1
    prior = np.log((y.sum(0) + 0.5) / (n + 0.5 * domains))

    def gradient(p):
        w = p.reshape(domains, width + 1)
        z = np.stack([x.dot(w[k, :width]) + w[k, width] for k in range(domains)], 1)
        q = np.exp(z - z.max(1, keepdims=True)) if len(z) else z
        miss = (q / q.sum(1, keepdims=True) - y) / n if len(z) else z
        return np.concatenate([np.append(x.back(miss[:, k]) + ridge * w[k, :width] / n, miss[:, k].sum()) for k in range(domains)])

    start = np.concatenate([np.append(np.zeros(width), b) for b in prior])
    w = adam(start, gradient, 60, 0.1).reshape(domains, width + 1)
    return Classifier(w[:, :width].copy(), w[:, width].copy())


def train(docs: DataFrame, labelled: DataFrame, domains: list[str], rows: int = SAMPLE_ROWS) -> Classifier:
    """Fit on a bounded sample of `labelled` (doc_id, domain); domains that are not listed are left out."""
    number = F.coalesce(*[F.when(F.col("domain") == d, F.lit(i)) for i, d in enumerate(domains)])
    y, (index, count) = collected(labelled_sample(docs, labelled.select("doc_id", number.alias("label")), rows), _features, 2)
    return fit(y, index, count, len(domains))


def _closed(p: np.ndarray, r: np.ndarray, price: np.ndarray | None, least: float) -> np.ndarray:
    """Rates after the dual prices of the domains, if there are any."""
    return r if price is None else np.maximum(least, r - p @ price)


def _replay(p: np.ndarray, steps: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rates and the extrapolated point of accelerated projected gradient after the given gradients."""
    r = point = np.ones(len(p))
    t = 1.0
    for g in steps:
        new = np.maximum(least, point - p @ g)
        t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
        point = new + (t - 1) / t_new * (new - r)
        r, t = new, t_new
    return r, point


def _table(batch: pa.RecordBatch, domains: int) -> np.ndarray:
    return batch["p"].flatten().to_numpy().reshape(-1, domains) if batch.num_rows else np.zeros((0, domains))


def solve(table: DataFrame, domains: int, targets: np.ndarray, least: float, budget: float = 1.0) -> tuple[list[np.ndarray], np.ndarray | None, np.ndarray, np.ndarray]:
    """Gradients and dual prices whose replay gives the rates, and the totals before and after; `table` has n_tokens and p."""

    def totals(steps, moments):
        def run(batches):
            for batch in batches:
                p, n = _table(batch, domains), batch["n_tokens"].to_numpy().astype(float)
                r, point = _replay(p, steps, least)
                got = [(n * point) @ p, (n * r) @ p]
                if moments:
                    got.append(((p * n[:, None]).T @ p).ravel())
                got = np.concatenate(got)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(got), dtype=np.int32)), pa.array(got)], names=["i", "v"])

        rows = table.select("n_tokens", "p").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        out = np.zeros(2 * domains + domains * domains * moments)
        for row in rows:
            out[row["i"]] = row["v"]
        return out

    first = totals([], True)
    before = first[domains : 2 * domains]
    goal = targets * before.sum() * budget
    top = float(np.linalg.eigvalsh(first[2 * domains :].reshape(domains, domains))[-1]) if before.sum() else 0.0
    steps: list[np.ndarray] = []
    if top <= 0:
        return steps, None, before, before
    at, after = first[:domains], before
    for _ in range(MOST_STEPS):
        steps.append((at - goal) / top)
        got = totals(steps, False)
        at, last, after = got[:domains], after, got[domains : 2 * domains]
        if min(np.abs(after - goal).max(), np.abs(after - last).max() * 10) <= TOLERANCE * goal.sum():
            break
    if np.abs(after - goal).max() <= TOLERANCE * goal.sum():
        return steps, None, before, after

    def dual(price):
        """Value of the dual problem, totals, and the curvature of the rates above their bound."""

        def run(batches):
            for batch in batches:
                p, n = _table(batch, domains), batch["n_tokens"].to_numpy().astype(float)
                start, _ = _replay(p, steps, least)
                r = _closed(p, start, price, least)
                free = n * (r > least)
                got = np.concatenate([[n @ ((r - start) ** 2 / 2 + r * (p @ price))], (n * r) @ p, ((p * free[:, None]).T @ p).ravel()])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(got), dtype=np.int32)), pa.array(got)], names=["i", "v"])

        got = np.zeros(1 + domains + domains * domains)
        for row in table.select("n_tokens", "p").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
            got[row["i"]] = row["v"]
        value = got[0] - price @ goal - ridge * (price @ price) / 2
        return value, got[1 : 1 + domains], got[1 + domains :].reshape(domains, domains)

    ridge = RIDGE * top
    price = np.zeros(domains)
    value, after, curve = dual(price)
    while True:
        slope = after - goal - ridge * price
        if np.abs(slope).max() <= TOLERANCE / 10 * goal.sum():
            break
        step, part = np.linalg.solve(curve + ridge * np.eye(domains), slope), 1.0
        found = dual(price + step)
        while found[0] < value + 1e-4 * part * (slope @ step) and part > 1e-6:
            part /= 2
            found = dual(price + part * step)
        if found[0] <= value:
            break  # no step rises any more in double precision
        price = price + part * step
        value, after, curve = found
    return steps, price, before, after


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, least: float = 0.0, budget: float = 1.0, id_col: str = "doc_id", text_col: str = "text", reached: dict[str, float] | None = None, keys: bool = False) -> DataFrame:
    """(doc_id, n_tokens, domain, posterior, rate) of every row.

    Targets are shares of `budget` times the tokens and are scaled to add up to one.  A null or
    empty text has no tokens, the prior as its posterior, and a rate like any
    other.  Ties of posteriors go to the first domain by name.  Repeated rows get
    equal rates; without labelled rows all domains are equally likely; other
    columns are ignored.  The domains' shares of `budget` times the tokens that the
    rates reach are put into `reached`; a target that cannot be met is logged.
    With `keys`, the two numbers of workspace.row_keys come too.
    """
    targets = dict(sorted((targets or TARGETS).items()))
    domains = list(targets)
    goal = np.array(list(targets.values())) / sum(targets.values())
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    model = train(slim, labelled, domains)
    work = Workspace(docs.sparkSession, "mixing")

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                n, p = model.posteriors(batch.column(1))
                yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(n, pa.int64()), pa.array(list(p), pa.list_(pa.float64()))], names=["doc_id", *numbers, "n_tokens", "p"])

    numbers = ("row", "row2") if keys else ()
    number_kinds = "row long, row2 long, " if keys else ""
    table = work.keep(slim.select("doc_id", "text", *(row_keys("doc_id", "text") if keys else [])).mapInArrow(run, f"doc_id long, {number_kinds}n_tokens long, p array<double>"), "posteriors")
    steps, price, before, after = solve(table, len(domains), goal, least, budget)
    shares = dict(zip(domains, (after / max(1.0, before.sum() * budget)).tolist(), strict=True))
    if reached is not None:
        reached.update(shares)
    missed = {d: (round(shares[d], 4), round(g, 4)) for d, g in zip(domains, goal.tolist(), strict=True) if before.sum() and abs(shares[d] - g) > 10 * TOLERANCE}
    if missed:
        logging.getLogger(__name__).warning("domains whose targets the rates cannot meet (reached, target): %s", missed)

    def rates(batches):
        for batch in batches:
            p = _table(batch, len(domains))
            r = _closed(p, _replay(p, steps, least)[0], price, least)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(batch[c] for c in numbers), batch["n_tokens"], pa.array([domains[k] for k in p.argmax(1)], pa.string()), pa.array(p.max(1) if len(p) else [], pa.float64()), pa.array(r, pa.float64())], names=["doc_id", *numbers, "n_tokens", "domain", "posterior", "rate"])

    return table.mapInArrow(rates, f"doc_id long, {number_kinds}n_tokens long, domain string, posterior double, rate double")


def labelled_domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, domain): the language of documents rated sound, "low" for the others."""
    rated = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return docs.select("doc_id", "lang").join(rated, "doc_id").select("doc_id", F.when(F.col("quality") == 0, "low").otherwise(F.col("lang")).alias("domain"))


def copies(docs: DataFrame, rates: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, each as often as its rate says: the whole part, and one more by a hash of the row for the rest.

    `rates` come from `mixed` with `keys`.  Rates belong to the row's own id and
    text, so rows that share an id, or have none, have each its own; repeated rows
    are copied alike; rows without a rate go; column names may be any.
    """
    chance = F.pmod(F.xxhash64(F.lit(7), "row"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    n = (F.floor("rate") + F.when(chance < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int")
    by_row = rates.groupBy("row", "row2").agg(F.max("rate").alias("rate")).select("row", "row2", n.alias("n")).where("n > 0")
    box = F.col("box")
    joined = boxed(docs).select("box", *row_keys(box.getField(id_col), box.getField(text_col))).join(by_row, ["row", "row2"])
    return unboxed(joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n")))), docs.columns)


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    """The whole documents table with the targets of TARGETS."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mixed(docs, labelled_domains(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
