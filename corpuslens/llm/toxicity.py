"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs.

* Words are runs of ASCII letters, digits and non-ASCII bytes, ASCII lower-cased; runs
  over ``PIECE`` bytes are cut into pieces, each a word of its own.  A word's input is a
  hashed word vector beside the mean of the vectors of its hashed character 3- to 5-grams.
* A window is ``WINDOW`` words; windows start every ``STRIDE`` words, so each word is seen
  in the middle of one.  Two gated recurrent layers read it in both directions; attention
  over their states gives one vector and one logit.  Every window of every whole text is
  scored; a text's logit is its largest.
* Training (numpy, on the driver): a text labelled 0 has no toxic window, one labelled 1
  has at least one.  Each epoch scores the sample's windows, takes one window of each
  toxic text (drawn by its score, ever more sharply) and the worst and two others of each
  clean text, and descends the log loss by back-propagation through time.  Word vectors
  are dropped at random so that the characters learn to do without.
* Bounds: at most ``per_label`` labelled texts of each label (smallest hashes), at most
  ``TRAIN_WINDOWS`` windows of each.  A fifth of them is kept back to fit the logistic
  curve from logit to probability, weighted by how common the labels are in all labelled rows.

Defined results: null texts, empty ones and those without words score 0.  A text labelled
twice counts as toxic if any label says so; null ids and labels are not learned from.
Without labelled texts every score is 0; with one label only, every text that has words
scores that label.  Repeated rows score alike.  Other columns are neither read nor renamed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ._batches import U, lower_ascii, mix, text_blocks, word_hashes, word_spans
from ._spark import small_batches

PIECE = 24
WINDOW, STRIDE = 32, 16
WORD_BITS, CHAR_BITS = 16, 16
ORDERS = (3, 4, 5)
DIM, HIDDEN = 16, 8
TRAIN_WINDOWS = 64
KNOWN = 200_000  # words whose projected input a task keeps
f32 = np.float32


# words --------------------------------------------------------------------
def _inside() -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(range(48, 58)) + list(range(97, 123)) + list(range(128, 256))] = True
    return t


INSIDE = _inside()


def pieces(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, words per row) of the words, long ones cut."""
    start, end, counts = word_spans(data, offs, INSIDE[data])
    cut = np.maximum((end - start + PIECE - 1) // PIECE, 1)
    if len(cut) and cut.max() > 1:
        row = np.repeat(np.arange(len(counts)), counts)
        counts = np.bincount(row, weights=cut, minlength=len(counts)).astype(np.int64)
        nth = np.arange(cut.sum()) - np.repeat(np.cumsum(cut) - cut, cut)
        start, end = np.repeat(start, cut) + nth * PIECE, np.repeat(end, cut)
        end = np.minimum(end, start + PIECE)
    return start, end, counts


def char_grams(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words x places) buckets of each word's character n-grams, with marks at both ends, and which of them exist."""
    n = end - start
    wide = int(n.max()) + 2
    at = start[:, None] + np.arange(-1, wide - 1)
    place = np.arange(wide)
    b = data[np.clip(at, 0, len(data) - 1)].astype(np.uint64)
    b = np.where(place == 0, U(1), np.where(place == n[:, None] + 1, U(2), b))
    found, there = [], []
    for k in ORDERS:
        if wide < k:
            continue
        h = np.full((len(n), wide - k + 1), U(k))
        for i in range(k):
            h = h * U(0x100000001B3) + b[:, i: wide - k + 1 + i]
        found.append((mix(h) & U((1 << CHAR_BITS) - 1)).astype(np.int64))
        there.append(np.arange(wide - k + 1) + k <= n[:, None] + 2)
    return np.concatenate(found, axis=1), np.concatenate(there, axis=1)


def window_table(counts: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, words) of every window; words are numbered through the block."""
    n = np.where(counts > 0, np.maximum(-(-(counts - WINDOW) // stride), 0) + 1, 0)
    row = np.repeat(np.arange(len(counts)), n)
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    first = (np.cumsum(counts) - counts)[row] + nth * stride
    return row, first, np.minimum(WINDOW, np.cumsum(counts)[row] - first)


# the network --------------------------------------------------------------
@dataclass
class Model:
    words: np.ndarray = field(default_factory=lambda: np.zeros((1 << WORD_BITS, DIM), f32))
    chars: np.ndarray = field(default_factory=lambda: np.zeros((1 << CHAR_BITS, DIM), f32))
    dense: dict[str, np.ndarray] = field(default_factory=dict)
    slope: float = 1.0
    shift: float = 0.0
    constant: float | None = None  # the score of texts with words, where no network was trained

    @staticmethod
    def fresh(seed: int = 5) -> Model:
        rng = np.random.default_rng(seed)
        m = Model()
        m.dense = {"x": (rng.normal(size=(2 * DIM, 6 * HIDDEN)) / np.sqrt(2 * DIM)).astype(f32), "xb": np.zeros(6 * HIDDEN, f32),
                   "h": (rng.normal(size=(2, HIDDEN, 3 * HIDDEN)) / np.sqrt(HIDDEN)).astype(f32),
                   "v": (rng.normal(size=2 * HIDDEN) * 0.3).astype(f32), "w": (rng.normal(size=2 * HIDDEN) * 0.3).astype(f32), "b": np.zeros(1, f32)}
        return m


def _inputs(m: Model, word: np.ndarray, grams: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Word vector and mean character vector of each word."""
    n = np.maximum(there.sum(axis=1, keepdims=True), 1).astype(f32)
    out = np.empty((len(word), 2 * DIM), f32)
    out[:, :DIM] = m.words[word]
    for i in range(0, len(word), 2048):
        j = slice(i, i + 2048)
        out[j, DIM:] = np.einsum("up,upd->ud", there[j].astype(f32), m.chars[grams[j]]) / n[j]
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return f32(0.5) * np.tanh(f32(0.5) * x) + f32(0.5)


def _wide(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b`` summed in double precision: in single precision the last bits depend on a row's place in its block."""
    return (a.astype(np.float64) @ b.astype(np.float64)).astype(f32)


def _states(p: dict[str, np.ndarray], proj: np.ndarray, idx: np.ndarray, n: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States of both directions at every word of each window (windows x WINDOW x 2 HIDDEN)."""
    k = 3 * HIDDEN
    front, back = np.ascontiguousarray(proj[:, :k]), np.ascontiguousarray(proj[:, k:])
    out = np.zeros((len(idx), WINDOW, 2 * HIDDEN), f32)
    h = np.zeros((2, len(idx), HIDDEN), f32)
    x = np.empty((2, len(idx), k), f32)
    for t in range(WINDOW):
        u = WINDOW - 1 - t
        x[0], x[1] = front[idx[:, t]], back[idx[:, u]]
        g = h @ p["h"] if keep is not None else _wide(h, p["h"])
        zr = _sigmoid(x[:, :, : 2 * HIDDEN] + g[:, :, : 2 * HIDDEN])
        z, r, gn = zr[:, :, :HIDDEN], zr[:, :, HIDDEN:], g[:, :, 2 * HIDDEN:]
        new = np.tanh(x[:, :, 2 * HIDDEN:] + r * gn)
        on = np.stack([t < n, u < n])[:, :, None]
        now = np.where(on, new + z * (h - new), h)
        if keep is not None:
            keep.append((h, z, r, gn, new, on))
        h = now
        out[:, t, :HIDDEN], out[:, u, HIDDEN:] = h[0], h[1]
    return out


def _pool(p: dict[str, np.ndarray], states: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(logits, attention, pooled states)."""
    e = np.where(np.arange(WINDOW) < n[:, None], states @ p["v"], f32(-1e9))
    a = np.exp(e - e.max(axis=1, keepdims=True))
    a /= a.sum(axis=1, keepdims=True)
    c = np.einsum("nt,ntk->nk", a, states)
    return c @ p["w"] + p["b"][0], a, c


def window_logits(m: Model, proj: np.ndarray, index: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Logit of each window; ``index`` maps the words of the block to rows of ``proj``."""
    out = np.empty(len(first), f32)
    for i in range(0, len(first), 2048):
        j = slice(i, i + 2048)
        idx = index[np.minimum(first[j, None] + np.arange(WINDOW), len(index) - 1)]
        pooled = _pool(m.dense, _states(m.dense, proj, idx, n[j]), n[j])[2]
        out[j] = _wide(pooled, m.dense["w"]) + m.dense["b"][0]
    return out


def row_sums(at: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(different numbers, sums of the rows with each number)."""
    order = np.argsort(at, kind="stable")
    at = at[order]
    begin = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at[begin], np.add.reduceat(values[order], begin, axis=0)


def gradients(m: Model, x: np.ndarray, idx: np.ndarray, n: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
    """(loss, gradients of the dense parameters, gradient of the word inputs ``x``) of the mean log loss."""
    p, keep = m.dense, []
    proj = x @ p["x"] + p["xb"]
    states = _states(p, proj, idx, n, keep)
    s, a, c = _pool(p, states, n)
    d = (_sigmoid(s) - y) / f32(len(y))
    loss = float(np.mean(np.logaddexp(0, np.where(y > 0, -s, s))))
    g = {k: np.zeros_like(v) for k, v in p.items()}
    g["w"], g["b"][0] = d @ c, d.sum()
    dc = d[:, None] * p["w"]
    da = np.einsum("ntk,nk->nt", states, dc)
    de = a * (da - (a * da).sum(axis=1, keepdims=True))
    g["v"] = np.einsum("nt,ntk->k", de, states)
    ds = a[:, :, None] * dc[:, None, :] + de[:, :, None] * p["v"]
    dxs = np.empty((len(idx), WINDOW, 6 * HIDDEN), f32)
    dh = np.zeros((2, len(idx), HIDDEN), f32)
    k = 3 * HIDDEN
    for t in range(WINDOW - 1, -1, -1):
        u = WINDOW - 1 - t
        h, z, r, gn, new, on = keep[t]
        dh = dh + np.stack([ds[:, t, :HIDDEN], ds[:, u, HIDDEN:]])
        live = np.where(on, dh, f32(0))
        dn = live * (1 - z) * (1 - new * new)
        dz = live * (h - new) * z * (1 - z)
        dr = dn * gn * r * (1 - r)
        dx = np.concatenate([dz, dr, dn], axis=2)
        dg = np.concatenate([dz, dr, dn * r], axis=2)
        g["h"] += np.swapaxes(h, 1, 2) @ dg
        dh = np.where(on, dh * z, dh) + dg @ np.swapaxes(p["h"], 1, 2)
        dxs[:, t, :k], dxs[:, u, k:] = dx[0], dx[1]
    dproj = np.zeros_like(proj)
    rows, sums = row_sums(idx.ravel(), dxs.reshape(-1, 6 * HIDDEN))
    dproj[rows] = sums
    g["x"], g["xb"] = x.T @ dproj, dproj.sum(axis=0)
    return loss, g, dproj @ p["x"].T


# training -----------------------------------------------------------------
class Sample:
    """The windows of the sampled texts, with their different words."""

    def __init__(self, texts: list[list[bytes]], labels: list[int]):
        flat = [w for t in texts for w in t]
        data = lower_ascii(np.frombuffer(b" ".join(flat) + b" ", np.uint8))
        lengths = np.array([len(w) + 1 for w in flat])
        offs = np.concatenate([[0], np.cumsum(lengths)])
        start, end, self.n = pieces(data, offs)
        _, where, index = np.unique(word_hashes(data, start, end), return_index=True, return_inverse=True)
        self.word = (word_hashes(data, start[where], end[where]) & U((1 << WORD_BITS) - 1)).astype(np.int64)
        self.grams, self.there = char_grams(data, start[where], end[where])
        self.index = index
        self.first = np.cumsum(self.n) - self.n
        self.doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        self.label = np.array(labels)

    def rows(self, windows: np.ndarray) -> np.ndarray:
        return self.index[np.minimum(self.first[windows, None] + np.arange(WINDOW), len(self.index) - 1)]

    def logits(self, m: Model) -> np.ndarray:
        proj = _inputs(m, self.word, self.grams, self.there) @ m.dense["x"] + m.dense["xb"]
        return window_logits(m, proj, self.index, self.first, self.n)


def train(texts: list[list[bytes]], labels: list[int], share: float, epochs: int = 8, batch: int = 64, seed: int = 5) -> Model:
    """Fit on the windows of each text; ``share`` is the share of label 1 among all labelled rows."""
    if not texts or min(labels) == max(labels):
        return Model(constant=float(labels[0]) if labels else 0.0)
    rng = np.random.default_rng(seed)
    m, s = Model.fresh(seed), Sample(texts, labels)
    held = np.zeros(len(texts), bool)
    for y in (0, 1):
        of = np.flatnonzero(s.label == y)
        if len(of) >= 10:
            held[of[::5]] = True
    ends = np.cumsum(np.bincount(s.doc, minlength=len(texts)))
    use = [np.arange(e - k, e) for e, k in zip(ends, np.bincount(s.doc, minlength=len(texts)), strict=True)]
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in m.dense.items()}
    seen_w, seen_c = np.full(len(m.words), 1e-6, f32), np.full(len(m.chars), 1e-6, f32)
    step = 0
    for epoch in range(epochs):
        score = s.logits(m)
        picked = []
        for doc in np.flatnonzero(~held):
            w = use[doc]
            if s.label[doc]:
                e = np.exp((score[w] - score[w].max()) * epoch)  # epoch 0: any window
                picked.append(rng.choice(w, 1, p=e / e.sum()))
            else:
                picked.append(np.concatenate([w[[score[w].argmax()]], rng.choice(w, 2)]))
        picked = rng.permutation(np.concatenate(picked))
        for i in range(0, len(picked), batch):
            step += 1
            _descend(m, s, picked[i: i + batch], state, seen_w, seen_c, step, rng)
    score = s.logits(m)
    best = np.array([score[w].max() for w in use], float)
    fit = held if held.any() else np.ones(len(texts), bool)
    m.slope, m.shift = _curve(best[fit], s.label[fit], share)
    return m


def _descend(m: Model, s: Sample, windows: np.ndarray, state: dict, seen_w: np.ndarray, seen_c: np.ndarray, step: int,
             rng: np.random.Generator, rate: float = 0.01, rate_vectors: float = 0.2) -> None:
    """One step: Adam for the dense parameters, Adagrad for the vectors that take part."""
    rows = s.rows(windows)
    used, idx = np.unique(rows, return_inverse=True)
    x = _inputs(m, s.word[used], s.grams[used], s.there[used])
    on = (rng.random((len(used), 1)) < 0.5).astype(f32)
    x[:, :DIM] *= on
    _, g, dx = gradients(m, x, idx.reshape(rows.shape), s.n[windows], s.label[s.doc[windows]].astype(f32))
    for k, (first, second) in state.items():
        first *= f32(0.9)
        first += f32(0.1) * g[k]
        second *= f32(0.999)
        second += f32(0.001) * g[k] * g[k]
        m.dense[k] -= f32(rate) * (first / f32(1 - 0.9 ** step)) / (np.sqrt(second / f32(1 - 0.999 ** step)) + f32(1e-8))
    _vectors(m.words, seen_w, s.word[used], dx[:, :DIM] * on, rate_vectors)
    there = s.there[used]
    dc = dx[:, DIM:] / np.maximum(there.sum(axis=1, keepdims=True), 1).astype(f32)
    _vectors(m.chars, seen_c, s.grams[used][there], np.repeat(dc, there.sum(axis=1), axis=0), rate_vectors)


def _vectors(table: np.ndarray, seen: np.ndarray, at: np.ndarray, g: np.ndarray, rate: float) -> None:
    rows, total = row_sums(at, g)
    seen[rows] += (total * total).mean(axis=1)
    table[rows] -= f32(rate) * total / np.sqrt(seen[rows])[:, None]


def _curve(x: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Slope and shift of the logistic curve (Newton steps), classes weighted to ``share``, targets smoothed as Platt's."""
    ones, zeros = max(int(y.sum()), 1), max(int((1 - y).sum()), 1)
    target = np.where(y > 0, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    weight = np.where(y > 0, share / ones, (1 - share) / zeros) * len(y)
    centre, scale = x.mean(), x.std() + 1e-9
    a = np.stack([(x - centre) / scale, np.ones_like(x)], axis=1)
    b = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        grad = a.T @ (weight * (p - target)) + 1e-3 * b
        hess = (a * (weight * p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
        b = b - np.clip(np.linalg.solve(hess, grad), -2, 2)
    slope = max(b[0], 1e-3) / scale
    return float(slope), float(b[1] - slope * centre)


# Spark --------------------------------------------------------------------
def fold(doc_id: str) -> Column:
    """True for the held-out fifth: crc32 of the id as text, mod 5, is 0 (null id: false)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, per_label: int = 1200) -> Model:
    """Train on documents (doc_id, text) and labels (doc_id, toxic); both are used as given."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.expr("cast(toxic <> 0 as int)")).alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if not sizes:
        return train([], [], 0.0)
    h = F.xxhash64("doc_id")
    few = [known.where(F.col("toxic") == y).orderBy(h, "doc_id").limit(per_label) for y in sizes]
    ids = few[0] if len(few) == 1 else few[0].union(few[1])  # at most 2 * per_label rows
    small_batches(docs.sparkSession)
    met = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select(
        "text", "toxic", F.xxhash64(F.col("doc_id"), F.col("text")).alias("h"))
    cut = met.mapInArrow(_training_windows, "windows array<binary>, toxic int, h long")
    texts, marks = [], []
    for y in sorted(sizes):
        got = cut.where(F.col("toxic") == y).orderBy("h").limit(per_label).toArrow()
        texts += got["windows"].to_pylist()
        marks += [y] * got.num_rows
    return train(texts, marks, sizes.get(1, 0) / sum(sizes.values()))


def _training_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows side by side; of more than ``TRAIN_WINDOWS``, as many evenly spread ones."""
    for batch in batches:
        toxic, h = batch.column("toxic").to_pylist(), batch.column("h").to_pylist()
        out: dict[str, list] = {"windows": [], "toxic": [], "h": []}
        for at, data, offs in text_blocks(batch.column("text")):
            start, end, counts = pieces(lower_ascii(data), offs)
            row, first, n = window_table(counts, WINDOW)
            for r in range(len(counts)):
                mine = np.flatnonzero(row == r)
                if len(mine) > TRAIN_WINDOWS:
                    mine = mine[np.linspace(0, len(mine) - 1, TRAIN_WINDOWS).astype(int)]
                if len(mine):
                    words = [b" ".join(data[start[k]: end[k]].tobytes() for k in range(first[w], first[w] + n[w])) for w in mine]
                    out["windows"].append(words)
                    out["toxic"].append(toxic[at + r])
                    out["h"].append(h[at + r])
        yield pa.RecordBatch.from_pydict({"windows": pa.array(out["windows"], pa.list_(pa.binary())), "toxic": pa.array(out["toxic"], pa.int32()),
                                          "h": pa.array(out["h"], pa.int64())})


class Scorer:
    """Scores texts in a task; keeps the projected inputs of words met before."""

    def __init__(self, m: Model):
        self.m = m
        self.known = np.zeros(0, np.uint64)
        self.proj = np.zeros((0, 6 * HIDDEN), f32)

    def _rows(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Row of ``proj`` of each word."""
        h = word_hashes(data, start, end)
        uniq, where, index = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, uniq)
        new = np.ones(len(uniq), bool) if not len(self.known) else self.known[np.minimum(at, len(self.known) - 1)] != uniq
        if new.any():
            i = where[new]
            added = []
            for k in range(0, len(i), 4096):
                j = i[k: k + 4096]
                x = _inputs(self.m, (h[j] & U((1 << WORD_BITS) - 1)).astype(np.int64), *char_grams(data, start[j], end[j]))
                added.append(_wide(x, self.m.dense["x"]) + self.m.dense["xb"])
            if len(self.known) > KNOWN:  # keep only what this block uses
                self.known, self.proj = uniq[~new], self.proj[at[~new]]
            known = np.concatenate([self.known, uniq[new]])
            order = np.argsort(known)
            self.known, self.proj = known[order], np.concatenate([self.proj, *added])[order]
            at = np.searchsorted(self.known, uniq)
        return at[index]

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(probability, number of windows) of each text."""
        score, windows = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        for at, data, offs in text_blocks(texts):
            data = lower_ascii(data)
            start, end, counts = pieces(data, offs)
            if not len(start):
                continue
            row, first, n = window_table(counts)
            some = np.flatnonzero(counts > 0)
            windows[at: at + len(counts)] = np.bincount(row, minlength=len(counts))
            if self.m.constant is not None:
                score[at + some] = self.m.constant
                continue
            index = self._rows(data, start, end)
            logit = window_logits(self.m, self.proj, index, first, n)
            best = np.maximum.reduceat(logit, np.searchsorted(row, some)).astype(float)
            score[at + some] = 1 / (1 + np.exp(-np.clip(self.m.slope * best + self.m.shift, -700, 700)))
        return score, windows


def score_column(model: Model, text: Column) -> Column:
    """struct<score: double, n_windows: long> of a text column."""

    @F.arrow_udf("struct<score: double, n_windows: long>")
    def toxic(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(model)
        for texts in batches:
            score, n = scorer.score(texts)
            yield pa.StructArray.from_arrays([pa.array(score), pa.array(n)], ["score", "n_windows"])

    return toxic.asNondeterministic()(text)  # not evaluated again for each use


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, n_windows of every document, learned from the labels that are not held out."""
    model = fit(docs, labels.where(~fold("doc_id")))
    out = docs.select("doc_id", fold("doc_id").alias("held_out"), score_column(model, F.col("text")).alias("p"))
    return out.select("doc_id", "held_out", "p.score", F.when(F.col("p.score") >= 0.5, 1).otherwise(0).alias("predicted"), "p.n_windows")
