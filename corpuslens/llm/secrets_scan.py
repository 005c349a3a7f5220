"""Secret scan: fixed patterns plus character Markov models compared by log-likelihood ratio.

Base kinds (code-point spans, end exclusive, leftmost and non-overlapping per
kind, found in the whole text): ``assign`` (a key word, ``:`` or ``=``, and a
value of 6 or more characters), ``access`` (``AKIA`` and upper-case letters or
digits, 20 or more) and ``hex`` (24 or more).

The ``markov`` kind covers what no pattern names: every run of 16 or more of
``A-Za-z0-9+/_=-`` that holds a letter and touches no base span is scored under
two first-order character models, one of random strings and one of ordinary
identifiers; it is a span when the log-likelihood ratio per character and in
total reach their thresholds.

``train`` counts character transitions of labelled strings per task and adds
the counts up: a fixed-size table whatever the number of strings.  The query
labels strings itself: values that the base patterns find are random strings,
other words are identifiers, both from a bounded hash sample of documents
(``sample_documents``, a documented parameter).

Defined results: null is the empty text; no spans give zero counts, an empty
``spans`` and the SHA-256 of the empty string.  Rows are judged one by one, so
repeated rows repeat their result.  An empty training set gives equal models
and no markov spans.  Only the named text column is read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ._spark import small_batches

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so this is the runs of 24 or more
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
KINDS = ("assign", "access", "hex", "markov")
RESULT = "struct<n_assign: long, n_access: long, n_hex: long, base_sha256: string, spans: string, n_markov: long>"
ASSIGN_HINT = re.compile(r"[:=]")
SIZE = 128  # models cover ASCII; the last code stands for the start of a string


@dataclass(frozen=True)
class Model:
    ratio: np.ndarray  # SIZE x SIZE: log P(next | previous) as random string minus as identifier


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base matches, in order."""
    found = []
    if ASSIGN_HINT.search(text):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("ascii", "replace"), np.uint8)


def markov_spans(text: str, base: list[tuple[int, int, int]], model: Model, per_char: float, total: float):
    found = []
    for m in RUN.finditer(text):
        s, e = m.span()
        if any(a < e and s < b for a, _, b in base):
            continue
        run = m[0]
        if not any(c.isalpha() for c in run):
            continue
        c = _codes(run)
        ratio = float(model.ratio[np.append(SIZE - 1, c[:-1]), c].sum())
        if ratio >= total and ratio >= per_char * len(run):
            found.append((s, 3, e))
    return found


def _join(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, SIZE * SIZE), np.int64)
    for batch in batches:
        for s, random in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if s and random is not None:
                c = _codes(s).astype(np.int64)
                np.add.at(counts[int(random)], np.append(SIZE - 1, c[:-1]) * SIZE + c, 1)
    yield _counted(counts)


def _counted(counts: np.ndarray) -> pa.RecordBatch:
    kind, pair = np.nonzero(counts)
    return pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), pa.array(pair), pa.array(counts[kind, pair])],
                                      ["kind", "pair", "n"])


def _label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Transition counts of the strings of whole documents: base values against all other words."""
    word = re.compile(r"[A-Za-z0-9+/_=-]+")
    counts = np.zeros((2, SIZE * SIZE), np.int64)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if not text:
                continue
            secret, rest, at = [], [], 0
            for s, k, e in base_spans(text):
                value = ASSIGN.match(text, s)[2] if k == 0 else text[s:e]
                secret.append(value)
                if s > at:
                    rest.append(text[at:s])
                at = max(at, e)
            rest.append(text[at:])
            words = [w for part in rest for w in word.findall(part) if not w.isdigit()]
            for kind, strings in ((1, secret), (0, words)):
                if strings:
                    c = np.frombuffer(("\x7f" + "\x7f".join(strings)).encode("ascii"), np.uint8).astype(np.int64)
                    pair = c[:-1] * SIZE + c[1:]
                    counts[kind] += np.bincount(pair[c[1:] != SIZE - 1], minlength=SIZE * SIZE)
    yield _counted(counts)


def _fit(counted: DataFrame, smoothing: float) -> Model:
    got = counted.groupBy("kind", "pair").agg(F.sum("n").alias("n")).toArrow()  # at most 2 x 16,384 rows
    counts = np.zeros((2, SIZE * SIZE))
    counts[got["kind"].to_numpy(), got["pair"].to_numpy()] = got["n"].to_numpy()
    counts = counts.reshape(2, SIZE, SIZE)
    used = [ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."]
    p = (counts[:, :, used] + smoothing) / (counts[:, :, used].sum(axis=2, keepdims=True) + smoothing * len(used))
    ratio = np.zeros((SIZE, SIZE))
    ratio[:, used] = np.log(p[1]) - np.log(p[0])
    return Model(ratio)


def train(samples: DataFrame, string: str, is_random: str, smoothing: float = 1.0) -> Model:
    """Models from labelled strings (``is_random`` true or false; null strings and labels are left out)."""
    rows = samples.select(F.col(string).cast("string").alias("s"), F.col(is_random).cast("boolean").alias("r"))
    return _fit(rows.mapInArrow(_count, "kind int, pair long, n long"), smoothing)


def train_on_documents(docs: DataFrame, text: str, row_id: str, sample_documents: int = 20_000,
                       smoothing: float = 1.0) -> Model:
    """Models from a hash sample of about ``sample_documents`` documents (all, if there are fewer)."""
    n = max(docs.count(), 1)
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(text).alias("text"), F.xxhash64(F.col(row_id).cast("string")).alias("h"))
    rows = rows.where(F.expr(f"pmod(h, 1000000) < {1e6 * sample_documents / n}")).select("text")
    return _fit(rows.mapInArrow(_label, "kind int, pair long, n long"), smoothing)


def scan_column(model: Model, text: Column, per_char: float = 1.0, total: float = 20.0) -> Column:
    """Counts, digest and spans of a text column as a struct."""

    @F.arrow_udf(RESULT)
    def scan(texts: pa.Array) -> pa.Array:
        counts, digests, spans = [], [], []
        for text in texts:
            text = text.as_py() or ""
            base = base_spans(text)
            more = markov_spans(text, base, model, per_char, total)
            counts.append((*(sum(k == kind for _, k, _ in base) for kind in range(3)), len(more)))
            digests.append(hashlib.sha256(_join(base).encode()).hexdigest())
            spans.append(_join(sorted(base + more)))
        a, b, c, d = (pa.array(x, pa.int64()) for x in (zip(*counts) if counts else ([], [], [], [])))
        return pa.StructArray.from_arrays([a, b, c, pa.array(digests, pa.string()), pa.array(spans, pa.string()), d],
                                          ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_markov"])

    return scan.asNondeterministic()(text)


def redact_column(model: Model, text: Column, mark: str = "[secret]", per_char: float = 1.0, total: float = 20.0) -> Column:
    """The text with each span (overlapping spans as one) replaced by ``mark``; null stays null."""

    @F.arrow_udf("string")
    def redact(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts:
            text = text.as_py()
            if text:
                base = base_spans(text)
                parts, at, end = [], 0, -1
                for s, _, e in sorted(base + markov_spans(text, base, model, per_char, total)):
                    if s >= end:
                        parts += [text[at:s], mark]
                    end = at = max(end, e)
                if parts:
                    text = "".join(parts) + text[at:]
            out.append(text)
        return pa.array(out, pa.string())

    return redact.asNondeterministic()(text)


def scan(docs: DataFrame) -> DataFrame:
    """Secrets of every document: counts per base kind, digest of the base spans, all spans."""
    model = train_on_documents(docs, "text", "doc_id")
    out = docs.select("doc_id", scan_column(model, F.col("text")).alias("s"))
    return out.select("doc_id", "s.n_assign", "s.n_access", "s.n_hex", "s.base_sha256", "s.spans", "s.n_markov")


def redact(docs: DataFrame) -> DataFrame:
    """Replace secrets in ``text``; ``n_chars`` follows the new text where it gave the old length.  All rows stay."""
    model = train_on_documents(docs, "text", "doc_id")
    names = docs.columns
    new = "new_text"
    while new in names:
        new += "_"
    out = docs.withColumn(new, redact_column(model, docs["text"]))
    length = F.when(F.col("n_chars") == F.length("text"), F.length(new).cast("long")).otherwise(F.col("n_chars"))
    return out.select(*[F.col(new).alias("text") if c == "text" else length.alias("n_chars") if c == "n_chars"
                        else F.col(f"`{c}`") for c in names])
