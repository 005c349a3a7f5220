"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

``fit`` learns from labelled rows, ``predict_column`` classifies whole texts.

* Features: texts are lower-cased, runs of non-letters become one space, and
  character 1- to 3-grams (with those spaces) are hashed into ``DIM`` buckets.
  A weight is the relative frequency in the text times the bucket's inverse
  document frequency.  Document frequencies cover every labelled text.
* Training: FTRL-proximal with L1 and L2 penalties, on a bounded sample of at
  most ``per_language`` labelled rows per language (smallest hashes of row id
  and text), passed over ``epochs`` times on the driver.  A fifth of the sample is kept back
  to fit one temperature, which divides the logits.
* The model is a DIM x languages table; it is shipped with the tasks.

Defined results: a null text, an empty text and one without letters give
``und`` with score 0; so does every text when no labelled row has letters.
Null labels are not learned from.  Repeated rows count once each.  Ties in
probability go to the label first in code-point order.  Other columns of the
input are neither read nor renamed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ._batches import U, mix, text_blocks
from ._spark import small, small_batches

DIM_BITS = 15
DIM = 1 << DIM_BITS
ORDERS = (1, 2, 3)
UNKNOWN = "und"
SCALE = 8.0  # brings typical TF-IDF weights near 1
PART_BYTES = 1 << 20


@dataclass(frozen=True)
class Model:
    labels: tuple[str, ...]
    table: np.ndarray  # DIM x labels: idf * weight / temperature
    bias: np.ndarray  # / temperature
    temperature: float
    idf: np.ndarray
    nonzero: float = 0.0  # share of weights that the penalty left in place


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _grams(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bucket of every n-gram, n-grams per row), rows in order, in blocks."""
    letters = _letters()
    for first, data, offs in text_blocks(pc.utf8_lower(texts)):
        for i, j in _parts(offs):
            raw = data[offs[i]: offs[j]]
            code = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
            chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[offs[i: j + 1] - offs[i]]
            row = np.repeat(np.arange(j - i), np.diff(chars))
            alpha = letters[code]
            keep = alpha.copy()
            keep[1:] |= alpha[:-1] & (row[1:] == row[:-1])  # one space after each run of letters
            code, row = np.where(alpha, code, 32)[keep].astype(np.uint64), row[keep]
            found, rows = [], []
            for n in ORDERS:
                m = len(code) - n + 1
                if m <= 0:
                    continue
                h = code[:m].copy()
                for k in range(1, n):
                    h |= code[k: m + k] << U(21 * k)
                ok = row[:m] == row[n - 1:]
                if n == 1:
                    ok &= code != 32
                found.append((mix(h[ok] + U(n * 0x1E3779B97F4A7C15)) >> U(64 - DIM_BITS)).astype(np.int32))
                rows.append(row[:m][ok])
            counts = np.zeros((len(ORDERS), j - i), np.int64)
            for k, r in enumerate(rows):
                counts[k] = np.bincount(r, minlength=j - i)
            yield first + i, found, counts


def _parts(offs: np.ndarray) -> Iterator[tuple[int, int]]:
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + PART_BYTES, "right")) - 1)
        yield i, j
        i = j


def _rows(texts: pa.Array) -> Iterator[np.ndarray]:
    """The n-gram buckets of each text, in order."""
    for _, found, counts in _grams(texts):
        ends = np.cumsum(counts, axis=1)
        for r in range(counts.shape[1]):
            yield np.concatenate([f[ends[k, r] - counts[k, r]: ends[k, r]] for k, f in enumerate(found)]
                                 or [np.zeros(0, np.int32)])


def _count_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df = np.zeros(DIM, np.int64)
    n = 0
    for batch in batches:
        for h in _rows(batch.column(0)):
            if len(h):
                seen = np.zeros(DIM, bool)
                seen[h] = True
                df += seen
                n += 1
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], ["bucket", "n"])


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, tf = [], []
        for h in _rows(batch.column(0)):
            b, c = np.unique(h, return_counts=True)
            at.append(b.astype(np.int32))
            tf.append((c / max(len(h), 1)).astype(np.float32))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.float32())),
                                         batch.column(1), batch.column(2)],
                                         ["at", "tf", "label", "h"])


def fit(rows: DataFrame, text: str, label: str, row_id: str, per_language: int = 400, epochs: int = 3,
        alpha: float = 2.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02) -> Model | None:
    """Learn from the labelled ``rows``; None if none of them has a label and letters."""
    small_batches(rows.sparkSession)
    rows = rows.select(F.col(text).alias("text"), F.col(label).cast("string").alias("label"), F.col(row_id).alias("id"))
    rows = rows.where("text is not null and label is not null")
    df = np.zeros(DIM)
    n = 0
    counted = (rows.select("text").mapInArrow(_count_documents, "bucket long, n long")
               .groupBy("bucket").agg(F.sum("n").alias("n")).toArrow())  # at most DIM + 1 rows
    for b, c in zip(counted["bucket"].to_pylist(), counted["n"].to_pylist(), strict=True):
        if b < 0:
            n = c
        else:
            df[b] = c
    if not n:
        return None
    idf = np.log((1 + n) / (1 + df)) + 1
    # about twice the bound by hash, then exactly the bound: the second step sorts few rows
    sizes = rows.groupBy("label").agg(F.count("*").alias("n"))
    order = F.xxhash64(F.col("id").cast("string"), "text")
    few = rows.withColumn("h", order).join(small(sizes, sizes.count()), "label")
    few = few.where(F.expr(f"pmod(h, 1000000) < 2e6 * {int(per_language)} / n"))
    w = Window.partitionBy("label").orderBy("h", "id")
    sample = (few.withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_language)
              .select("text", "label", "h").repartition(8, "h")
              .mapInArrow(_sparse, "at array<int>, tf array<float>, label string, h long").toArrow())
    if not sample.num_rows:
        return None
    sample = sample.sort_by([("h", "ascending"), ("label", "ascending")])  # rows come in no fixed order
    sample = sample.combine_chunks()
    ends = np.cumsum(pc.list_value_length(sample["at"]).to_numpy())
    at = np.split(pc.list_flatten(sample["at"]).to_numpy().astype(np.int64), ends[:-1])
    tf = np.split(pc.list_flatten(sample["tf"]).to_numpy(), ends[:-1])
    x = [v * idf[a] * SCALE for v, a in zip(tf, at, strict=True)]
    names = sample["label"].to_pylist()
    usable = [i for i in range(len(at)) if len(at[i])]
    if not usable:
        return None
    labels = tuple(sorted(set(names[i] for i in usable), key=lambda s: s.encode()))
    y = {i: labels.index(names[i]) for i in usable}
    held = usable[::5] if len(usable) >= 10 else []
    train = [i for k, i in enumerate(usable) if k % 5] if held else usable
    weights, bias = _ftrl([at[i] for i in train], [x[i] for i in train], [y[i] for i in train], len(labels),
                          epochs, alpha, beta, l1, l2)
    t = 1.0
    if held:
        logits = np.array([x[i] @ weights[at[i]] + bias for i in held])
        t = _temperature(logits, np.array([y[i] for i in held]))
    return Model(labels, SCALE * idf[:, None] * weights / t, bias / t, t, idf, float((weights != 0).mean()))


def _ftrl(at: list, x: list, y: list, k: int, epochs: int, alpha: float, beta: float, l1: float, l2: float):
    """FTRL-proximal, one example at a time, softmax loss; weights DIM x k and an unpenalised bias."""
    z, n = np.zeros((DIM + 1, k)), np.zeros((DIM + 1, k))
    l1s, l2s = np.full((DIM + 1, 1), l1), np.full((DIM + 1, 1), l2)
    l1s[DIM] = l2s[DIM] = 0.0

    def weights(i):
        w = (np.sign(z[i]) * l1s[i] - z[i]) / ((beta + np.sqrt(n[i])) / alpha + l2s[i])
        return np.where(np.abs(z[i]) > l1s[i], w, 0.0)

    at = [np.append(a, DIM) for a in at]
    x = [np.append(v, 1.0) for v in x]
    for _ in range(epochs):
        for a, v, c in zip(at, x, y, strict=True):
            w = weights(a)
            s = v @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[c] -= 1.0
            g = v[:, None] * p[None, :]
            g2 = g * g
            z[a] += g - (np.sqrt(n[a] + g2) - np.sqrt(n[a])) / alpha * w
            n[a] += g2
    w = weights(np.arange(DIM + 1))
    return w[:DIM], w[DIM]


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature between 1/20 and 20 with the smallest held-back log loss (golden section).

    Targets are smoothed as in Platt scaling, (n + 1) / (n + k) for the label, so that
    a perfectly separated sample does not ask for infinite confidence.
    """
    n, k = logits.shape
    target = np.full((n, k), 1.0 / (n + k))
    target[np.arange(n), y] = (n + 1.0) / (n + k)

    def loss(u: float) -> float:
        s = logits / np.exp(u)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - (target * s).sum(axis=1)).mean())

    lo, hi, g = -np.log(20.0), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(50):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def predict_column(model: Model | None, text: Column) -> Column:
    """struct<lang_pred: string, score: double> of a text column."""
    if model is None:
        return F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    labels, table, bias = model.labels, model.table, model.bias

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def predict(texts: pa.Array) -> pa.Array:
        names = np.array([*labels, UNKNOWN], object)
        best = np.full(len(texts), len(labels))
        score = np.zeros(len(texts))
        for first, found, counts in _grams(texts):
            total = counts.sum(axis=0)
            sums = np.zeros((counts.shape[1], len(labels)))
            for k, h in enumerate(found):
                ends = np.cumsum(counts[k])
                has = counts[k] > 0
                if has.any():
                    for c in range(len(labels)):
                        sums[has, c] += np.add.reduceat(table[:, c][h], (ends - counts[k])[has])
            ok = total > 0
            s = sums[ok] / total[ok, None] + bias
            p = np.exp(s - s.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            at = first + np.flatnonzero(ok)
            best[at] = p.argmax(axis=1)
            score[at] = p.max(axis=1)
        return pa.StructArray.from_arrays([pa.array(names[best], pa.string()), pa.array(score)], ["lang_pred", "score"])

    return predict.asNondeterministic()(text)  # not evaluated again for each use


def fold(doc_id: str) -> Column:
    """True for the held-out quarter: crc32 of the id as text, mod 4, is 2 (null id: false)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def learned(docs: DataFrame) -> Model | None:
    """The model of the documents that are not held out (ids must not be null)."""
    return fit(docs.where(F.col("doc_id").isNotNull() & ~fold("doc_id")), "text", "lang", "doc_id")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    model = learned(docs)
    small_batches(docs.sparkSession)
    out = docs.select("doc_id", fold("doc_id").alias("held_out"), predict_column(model, F.col("text")).alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score")


def reject_unknown(docs: DataFrame, min_score: float = 0.35) -> DataFrame:
    """Drop documents without a language: no letters, or no language with ``min_score`` probability.

    All columns are kept as they are; rows are judged one by one.
    """
    model = learned(docs)
    small_batches(docs.sparkSession)
    names = docs.columns
    p = "p"
    while p in names:
        p += "_"
    out = docs.withColumn(p, predict_column(model, docs["text"]))
    return out.where((out[p]["lang_pred"] != UNKNOWN) & (out[p]["score"] >= min_score)).drop(p)
