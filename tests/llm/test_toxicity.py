"""Toxicity: gradients against finite differences, a plain network against the batched one, held-out accuracy, odd rows."""

import random

import numpy as np
import pyarrow as pa
import pytest

from corpuslens.llm import toxicity as T
from corpuslens.llm._batches import lower_ascii, text_blocks


def table_of(text):
    (_, data, offs), = list(text_blocks(pa.array([text])))
    data = lower_ascii(data)
    start, end, counts = T.pieces(data, offs)
    return data, start, end, counts


def model(seed=1):
    m = T.Model.fresh(seed)
    rng = np.random.default_rng(seed)
    m.words[:] = rng.normal(size=m.words.shape)
    m.chars[:] = rng.normal(size=m.chars.shape)
    return m


def plain_logits(m, x):
    """Window logits of one text, word by word; ``x`` are the words' inputs."""
    sig = lambda v: 1 / (1 + np.exp(-v))
    p = {k: v.astype(float) for k, v in m.dense.items()}
    H = T.HIDDEN

    def run(seq, k):
        h, out = np.zeros(H), []
        for v in seq:
            a = (v @ p["x"] + p["xb"])[3 * H * k: 3 * H * (k + 1)]
            g = h @ p["h"][k]
            z, r = sig(a[:H] + g[:H]), sig(a[H: 2 * H] + g[H: 2 * H])
            new = np.tanh(a[2 * H:] + r * g[2 * H:])
            h = (1 - z) * new + z * h
            out.append(h)
        return out

    logits = []
    for first in range(0, max(len(x) - T.WINDOW, 0) + T.STRIDE, T.STRIDE):
        w = x[first: first + T.WINDOW].astype(float)
        states = np.concatenate([run(w, 0), run(w[::-1], 1)[::-1]], axis=1)
        a = np.exp(states @ p["v"])
        logits.append((a / a.sum()) @ states @ p["w"] + p["b"][0])
        if first + T.WINDOW >= len(x):
            break
    return np.array(logits)


@pytest.mark.parametrize("n", [1, 5, 32, 33, 48, 49, 300])
def test_batched_network_equals_plain_one(n):
    rng = random.Random(n)
    text = " ".join(rng.choice(["Ab", "über", "x", "w" * 60, "word7"]) for _ in range(n))
    m = model()
    data, start, end, counts = table_of(text)
    from corpuslens.llm._batches import U, word_hashes
    word = (word_hashes(data, start, end) & U((1 << T.WORD_BITS) - 1)).astype(np.int64)
    x = T._inputs(m, word, *T.char_grams(data, start, end))
    want = plain_logits(m, x)
    score, windows = T.Scorer(m).score(pa.array([text, None, "", "!?", text]))
    assert list(windows) == [len(want), 0, 0, 0, len(want)]
    assert list(score[1:4]) == [0, 0, 0] and score[0] == score[4]
    np.testing.assert_allclose(score[0], 1 / (1 + np.exp(-want.max())), rtol=2e-4, atol=1e-5)


def test_a_score_does_not_depend_on_the_texts_beside_it():
    m = model()
    for seed in range(30):
        rng = random.Random(seed)
        text, *others = [" ".join(rng.choice(["Ab", "über", "x", "word7"]) for _ in range(rng.randint(1, 150))) for _ in range(rng.randint(1, 9))]
        alone = T.Scorer(m).score(pa.array([text]))[0][0]
        score = T.Scorer(m).score(pa.array([text, *others, text]))[0]
        assert score[0] == score[-1] == alone


def test_windows_overlap_and_cover_every_word():
    counts = np.array([0, 1, 32, 33, 47, 48, 49, 0, 500])
    row, first, n = T.window_table(counts)
    base = np.cumsum(counts) - counts
    for r, c in enumerate(counts):
        seen = np.zeros(c, int)
        for f, k in zip(first[row == r], n[row == r], strict=True):
            seen[f - base[r]: f - base[r] + k] += 1
        assert (seen >= 1).all() and (c <= 64 or (seen[16:-32] == 2).all())


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    m = model(2)
    m.dense = {k: v.astype(np.float64) for k, v in m.dense.items()}
    old, T.f32 = T.f32, np.float64  # checked in double precision
    try:
        x = rng.normal(size=(20, 2 * T.DIM))
        idx = rng.integers(0, 20, (6, T.WINDOW))
        n = np.array([1, 5, 32, 32, 17, 2])
        y = np.array([0, 1, 1, 0, 1, 0], float)
        _, g, dx = T.gradients(m, x, idx, n, y)
        for name, value in [*m.dense.items(), ("input", x)]:
            grad = dx if name == "input" else g[name]
            flat = value.reshape(-1)
            for i in rng.choice(flat.size, min(6, flat.size), replace=False):
                keep = flat[i]
                flat[i] = keep + 1e-5
                up = T.gradients(m, x, idx, n, y)[0]
                flat[i] = keep - 1e-5
                low = T.gradients(m, x, idx, n, y)[0]
                flat[i] = keep
                np.testing.assert_allclose(grad.reshape(-1)[i], (up - low) / 2e-5, rtol=2e-3, atol=1e-7, err_msg=name)
    finally:
        T.f32 = old


def made_up(rng, toxic, n):
    vocab = [a + b for a in ("ba", "du", "ke", "lo", "mi", "né") for b in ("ra", "st", "nt", "ou", "ze", "pi", "gla")]
    words = [rng.choice(vocab) for _ in range(n)]
    if toxic:
        for _ in range(rng.randint(1, 3)):
            words.insert(rng.randrange(n + 1), rng.choice(["idiot", "scum", "vrek" + rng.choice(vocab)]))  # a stem with many endings
    return " ".join(words)


def test_held_out_accuracy_and_odd_rows(spark, make_docs, clashing):
    rng = random.Random(4)
    rows, marks = [], []
    for i in range(900):
        toxic = i % 3 == 0
        rows.append((i, made_up(rng, toxic, rng.randint(1, 250))))
        marks.append((i, int(toxic)))
    rows += [(2000, None), (2001, ""), (2002, "123 ... !"), (None, rows[0][1]), (0, rows[0][1]), (2003, "x" * 200_000), (2004, made_up(rng, False, 30_000) + " idiot")]
    marks += [(None, 1), (1, None), (2, 0), (2, 0), (5000, 1)]
    docs, labels = clashing(make_docs(rows)), clashing(spark.createDataFrame(marks, "doc_id long, toxic int"))
    got = T.score(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 900]
    assert len(held) > 100
    right = [r.predicted == (r.doc_id % 3 == 0) for r in held]
    assert sum(right) >= 0.93 * len(right)
    by_id = {r.doc_id: r for r in got}
    assert by_id[2000].score == by_id[2001].score == by_id[2002].score or by_id[2002].n_windows == 1
    assert by_id[2000].score == 0 and by_id[2000].n_windows == 0
    same = {r.score for r in got if r.doc_id in (None, 0)}
    assert len(same) == 1
    assert by_id[2004].n_windows > 1800 and by_id[2004].predicted == 1  # found in a whole long text


def test_few_labels(spark, make_docs):
    docs = make_docs([(1, "a b"), (2, "c"), (3, None)])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in T.score(docs, none).collect()] == [0, 0, 0]
    one = spark.createDataFrame([(i, 1) for i in (1, 2, 3)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in T.score(docs, one).collect()}
    assert got[3] == 0 and got[1] == got[2] == 1
    assert T.score(docs.limit(0), one).collect() == []
