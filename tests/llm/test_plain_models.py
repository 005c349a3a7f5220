"""Learned operators against plain versions: dense FTRL, unhashed n-grams and TF-IDF, Markov models in dictionaries."""

import collections
import math
import random
import re

import numpy as np
import pyarrow as pa

from corpuslens.llm import language_id, secrets_scan


def plain_grams(text):
    """1- to 3-grams of lower-cased text in which a run of non-letters behind letters is one space."""
    t = re.sub(r"[^a-zà-öø-ÿß]+", " ", text.lower())
    t = t.lstrip(" ")
    return [t[i: i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1) if n > 1 or t[i] != " "]


def test_grams_are_those_of_the_plain_text():
    rng = random.Random(1)
    texts = ["".join(rng.choice(["ab", "É", "ñu", " ", "  ", ", ", "7", "\n", "zoo"]) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    texts += ["", "123", "x", "the end", " lead"]
    bucket = {}
    for text, got in zip(texts, language_id._rows(pa.array(texts)), strict=True):
        want = plain_grams(text)
        assert len(got) == len(want), (text, want)
        counts = collections.Counter(got.tolist())
        for gram, b in zip(want, got.tolist(), strict=True):
            assert bucket.setdefault(gram, b) == b
        assert sum(counts.values()) == len(want)
    assert len(set(bucket.values())) >= 0.98 * len(bucket)  # hashing brings hardly any together


def test_ftrl_equals_a_dense_plain_one():
    rng = np.random.default_rng(3)
    k, alpha, beta, l1, l2, epochs = 3, 0.7, 1.0, 0.05, 0.1, 2
    at = [np.sort(rng.choice(12, rng.integers(1, 7), replace=False)) for _ in range(80)]
    x = [rng.random(len(a)) + 0.1 for a in at]
    y = [int(a[0] % k) for a in at]
    weights, bias = language_id._ftrl(at, x, y, k, epochs, alpha, beta, l1, l2)
    z, n = np.zeros((13, k)), np.zeros((13, k))
    reg1, reg2 = np.array([l1] * 12 + [0.0]), np.array([l2] * 12 + [0.0])

    def weight(i, c):
        if abs(z[i, c]) <= reg1[i]:
            return 0.0
        return -(z[i, c] - math.copysign(reg1[i], z[i, c])) / ((beta + math.sqrt(n[i, c])) / alpha + reg2[i])

    for _ in range(epochs):
        for a, v, label in zip(at, x, y, strict=True):
            row = np.zeros(13)
            row[a], row[12] = v, 1.0
            w = np.array([[weight(i, c) for c in range(k)] for i in range(13)])
            p = np.exp(row @ w)
            p /= p.sum()
            for i in np.flatnonzero(row):
                for c in range(k):
                    g = row[i] * (p[c] - (c == label))
                    s = (math.sqrt(n[i, c] + g * g) - math.sqrt(n[i, c])) / alpha
                    z[i, c] += g - s * w[i, c]
                    n[i, c] += g * g
    want = np.array([[weight(i, c) for c in range(k)] for i in range(13)])
    np.testing.assert_allclose(weights[:12], want[:12], atol=1e-9)
    np.testing.assert_allclose(bias, want[12], atol=1e-9)
    assert (want[:12] == 0).any()  # the penalty leaves weights at zero


def test_prediction_equals_unhashed_tf_idf(spark, make_docs):
    """Probabilities from dictionaries of n-grams, with the model's weights looked up by n-gram."""
    rng = random.Random(5)
    words = {"aa": ["the", "and", "house", "of", "water"], "bb": ["el", "que", "casa", "ñandú", "de"]}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(rng.randint(3, 30))), lang) for i in range(80) for lang in [("aa", "bb")[i % 2]]]
    docs = make_docs(rows)
    model = language_id.learned(docs)
    got = {r.doc_id: r for r in language_id.identify(docs).collect()}
    bucket = {}
    for (_, text, _), b in zip(rows, language_id._rows(pa.array([r[1] for r in rows])), strict=True):
        bucket.update(zip(plain_grams(text), b.tolist(), strict=True))
    learned = [r for r in rows if not got[r[0]].held_out]
    df = collections.Counter(b for r in learned for b in {bucket[g] for g in plain_grams(r[1])})
    for i, text, _ in rows:
        grams = plain_grams(text)
        s = np.array(model.bias, float)
        for g, c in collections.Counter(grams).items():
            idf = math.log((1 + len(learned)) / (1 + df[bucket[g]])) + 1
            assert model.idf[bucket[g]] == __import__("pytest").approx(idf)
            s = s + c / len(grams) * model.table[bucket[g]]
        p = np.exp(s - s.max())
        p /= p.sum()
        assert got[i].lang_pred == model.labels[int(p.argmax())] and abs(got[i].score - p.max()) < 1e-6


def test_markov_spans_equal_plain_models(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r.spans for r in secrets_scan.scan(docs).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    counts = [collections.Counter(), collections.Counter()]
    for text in texts.values():
        rest, at, strings = [], 0, ([], [])
        for s, kind, e in secrets_scan.base_spans(text):
            strings[1].append(secrets_scan.ASSIGN.match(text, s)[2] if kind == 0 else text[s:e])
            if s > at:
                rest.append(text[at:s])
            at = max(at, e)
        rest.append(text[at:])
        strings[0].extend(w for part in rest for w in re.findall(r"[A-Za-z0-9+/_=-]+", part) if not w.isdigit())
        for kind in (0, 1):
            for w in strings[kind]:
                counts[kind].update(zip("^" + w, w, strict=False))
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
    totals = [collections.Counter(), collections.Counter()]
    for kind in (0, 1):
        for (a, b), n in counts[kind].items():
            if b in alphabet:
                totals[kind][a] += n

    def log(kind, a, b):
        return math.log((counts[kind][a, b] + 1) / (totals[kind][a] + len(alphabet)))

    n_markov = 0
    for i, text in texts.items():
        base = secrets_scan.base_spans(text)
        spans = list(base)
        for m in re.finditer(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}", text):
            s, e = m.span()
            if any(a < e and s < b for a, _, b in base) or not any(c.isalpha() for c in m[0]):
                continue
            ratio = sum(log(1, a, b) - log(0, a, b) for a, b in zip("^" + m[0], m[0], strict=False))
            if ratio >= max(20.0, len(m[0])):
                spans.append((s, 3, e))
                n_markov += 1
        assert got[i] == ",".join(f"{secrets_scan.KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans)), i
    assert n_markov > 0 or all("markov" not in s for s in got.values())
