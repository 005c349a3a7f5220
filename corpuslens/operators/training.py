"""Text classifier fitted epoch by epoch, with an evaluation after each and the best epoch kept.

Logistic regression on hashed words (log term count times inverse document frequency, unit
length).  An epoch is one pass of mini-batches in every task from the same weights, with a
rate per weight (Adagrad); the tasks' changes of a weight are averaged, by their rows, over
the tasks that touched it, in a grouped sum.  The driver holds the weights (``buckets``
numbers) and one row per epoch; it never sees texts or features.  The rate falls linearly
over the epochs.

Rows without a label take no part.  A null text has no words: its score is the intercept's.
Without training rows the weights stay 0.  The result depends on how the rows lie in
partitions, as mini-batches do.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.text import words
from corpuslens.operators.metrics import binary_metrics
from corpuslens.session import materialise

BUCKETS = 1 << 18
HISTORY = ("epoch int, train_loss double, train_accuracy double, eval_loss double, eval_accuracy double, eval_precision double, "
           "eval_recall double, eval_f1 double, is_new_best boolean")


@dataclass(frozen=True)
class Weights:
    idf: np.ndarray
    weight: np.ndarray  # the last one is the intercept

    def predict(self, df: DataFrame, key: str = "doc_id", text: str = "text", label: str = "label") -> DataFrame:
        """key, label, p_yes and pred of every row."""
        return _predicted(_features(df, key, text, label, len(self.idf)), self, key, label)


@dataclass(frozen=True)
class Fit:
    history: list[tuple]
    best: Weights
    best_epoch: int


def fit_epochs(train: DataFrame, validation: DataFrame, epochs: int = 4, batch: int = 32, rate: float = 1.0,
               key: str = "doc_id", text: str = "text", label: str = "label", buckets: int = BUCKETS) -> Fit:
    """Train on ``train``, evaluate on ``validation`` after every epoch; the best epoch has the largest F1 (the first of equals)."""
    rows = materialise(_features(train.where(F.col(label).isNotNull()), key, text, label, buckets))
    checks = materialise(_features(validation.where(F.col(label).isNotNull()), key, text, label, buckets))
    counted = rows.select(F.explode(F.array_distinct("at")).alias("b")).groupBy("b").count().toArrow()  # at most one row a bucket
    found = np.zeros(buckets)
    found[counted["b"].to_numpy()] = counted["count"].to_numpy()
    idf = np.log((1 + rows.count()) / (1 + found)) + 1
    now = Weights(idf, np.zeros(buckets + 1))
    best, best_f1, best_epoch, history = now, 0.0, 0, []
    for epoch in range(1, epochs + 1):
        pace = rate * (1 - (epoch - 1) / epochs)
        change = rows.select("at", "label").mapInArrow(partial(_descend, now, batch, pace, epoch), "b int, moved double, n long")
        sums = change.groupBy("b").agg(F.sum("moved").alias("moved"), F.sum("n").alias("n")).toArrow()
        at, moved, n = (sums[c].to_numpy() for c in ("b", "moved", "n"))
        weight = now.weight.copy()
        weight[at[at >= 0]] += moved[at >= 0] / n[at >= 0]
        now = Weights(idf, weight)
        totals = dict(zip(at[at < 0].tolist(), zip(moved[at < 0].tolist(), n[at < 0].tolist(), strict=True), strict=True))
        loss, seen = totals.get(-1, (0.0, 0))
        right = totals.get(-2, (0.0, 0))[0]
        ev = _evaluated(checks, now)
        history.append((epoch, loss / max(seen, 1), right / max(seen, 1), *ev, ev[-1] > best_f1))
        if ev[-1] > best_f1 or epoch == 1:
            best, best_f1, best_epoch = now, ev[-1], epoch
    return Fit(history, best, best_epoch)


def _features(df: DataFrame, key: str, text: str, label: str, buckets: int) -> DataFrame:
    hashed = F.transform(words(F.lower(F.col(text))), lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))
    return df.select(F.col(key).alias("key"), F.col(label).cast("double").alias("label"),
                     F.coalesce(hashed, F.array().cast("array<int>")).alias("at"))


def _predicted(features: DataFrame, weights: Weights, key: str, label: str) -> DataFrame:
    kind = features.schema["key"].dataType.simpleString()
    out = features.mapInArrow(partial(_score, weights), f"key {kind}, label double, p_yes double")
    return out.select(F.col("key").alias(key), F.col("label").cast("int").alias(label), "p_yes", (F.col("p_yes") >= 0.5).cast("int").alias("pred"))


def _evaluated(checks: DataFrame, weights: Weights) -> tuple[float, ...]:
    """(loss, accuracy, precision, recall, F1)."""
    p = materialise(_predicted(checks, weights, "key", "label").withColumn("g", F.lit(0)))
    right = F.when(F.col("label") == 1, F.col("p_yes")).otherwise(1 - F.col("p_yes"))
    loss = p.agg(F.avg(-F.log(F.greatest(right, F.lit(1e-15))))).first()[0]
    m = binary_metrics(p, ["g"]).first()
    return (loss or 0.0, *[m[c] for c in ("accuracy", "precision", "recall", "f1")]) if m else (0.0,) * 5


# inside tasks -------------------------------------------------------------
def _sparse(at: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, values, row ends) of the rows: different buckets of each row, unit length, then the intercept."""
    if isinstance(at, pa.ChunkedArray):
        at = at.combine_chunks()
    n = pc.list_value_length(at).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(n)), n)
    pair, count = np.unique(row.astype(np.int64) * len(idf) + pc.list_flatten(at).to_numpy(), return_counts=True)
    row, bucket = pair // len(idf), pair % len(idf)
    value = np.log1p(count) * idf[bucket]
    norm = np.sqrt(np.bincount(row, value * value, len(n)))
    value = value / norm[row]
    order = np.argsort(np.concatenate([row, np.arange(len(n))]), kind="stable")
    bucket = np.concatenate([bucket, np.full(len(n), len(idf))])[order]
    value = np.concatenate([value, np.ones(len(n))])[order]
    return bucket, value, np.cumsum(np.bincount(row, minlength=len(n)) + 1)


def _logits(weight: np.ndarray, bucket: np.ndarray, value: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return np.add.reduceat(weight[bucket] * value, np.concatenate([[0], ends[:-1]])) if len(ends) else np.zeros(0)


def _score(weights: Weights, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        s = _logits(weights.weight, *_sparse(batch.column("at"), weights.idf))
        p = pa.array(1 / (1 + np.exp(-np.clip(s, -500, 500))))
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("label"), p], ["key", "label", "p_yes"])


def _gradient(w: np.ndarray, bucket: np.ndarray, value: np.ndarray, ends: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(logits, buckets that occur, gradient of the mean log loss in them)."""
    s = _logits(w, bucket, value, ends)
    g = (1 / (1 + np.exp(-np.clip(s, -500, 500))) - y) / len(y)
    used, inverse = np.unique(bucket, return_inverse=True)
    return s, used, np.bincount(inverse, value * np.repeat(g, np.diff(ends, prepend=0)))


def _descend(weights: Weights, size: int, rate: float, epoch: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Changes of the touched weights times the task's rows; under -1 the loss, under -2 the right answers."""
    w, touched, squares = weights.weight.copy(), np.zeros(len(weights.weight), bool), np.zeros(len(weights.weight))
    loss, right, rows = 0.0, 0, 0
    for batch in batches:
        order = np.random.default_rng(epoch).permutation(batch.num_rows)
        at = batch.column("at").take(pa.array(order))
        y_all = batch.column("label").to_numpy(zero_copy_only=False)[order]
        for i in range(0, len(order), size):
            bucket, value, ends = _sparse(at.slice(i, size), weights.idf)
            y = y_all[i: i + size]
            s, used, total = _gradient(w, bucket, value, ends, y)
            loss += float(np.logaddexp(0, np.where(y > 0, -s, s)).sum())
            right += int(((s >= 0) == (y > 0)).sum())
            rows += len(y)
            squares[used] += total * total
            w[used] -= rate * total / np.sqrt(squares[used] + 1e-12)
            touched[used] = True
    if rows:
        b = np.flatnonzero(touched)
        moved = (w - weights.weight)[b] * rows
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([b, [-1, -2]]).astype(np.int32)), pa.array(np.concatenate([moved, [loss, float(right)]])),
             pa.array(np.full(len(b) + 2, rows))], ["b", "moved", "n"])
