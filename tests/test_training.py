"""Epoch-wise training: a separable text is learned exactly, the epochs' rows feed the log tables, gradients are right."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuslens.operators import scoring as SC
from corpuslens.operators import trainlog as TL
from corpuslens.operators import training as TR


def corpus(n, seed, noise=0.0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        label = i % 2
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randint(3, 40))] + (["yeah", "sure", "oh"] if label else ["indeed", "thus", "so"])
        rng.shuffle(words)
        rows.append((i, " ".join(words), label if rng.random() >= noise else 1 - label))
    return rows


SCHEMA = "doc_id long, text string, label int"


def test_separable_text_is_learned_exactly(spark):
    train = spark.createDataFrame(corpus(3000, 1) + [(-1, None, 1), (-2, "yeah", None)], SCHEMA).repartition(3, "doc_id")
    test = spark.createDataFrame(corpus(200, 2), SCHEMA)
    fit = TR.fit_epochs(train, test, epochs=4, rate=0.5, buckets=1 << 16)
    assert [r[0] for r in fit.history] == [1, 2, 3, 4]
    losses = [r[1] for r in fit.history]
    assert losses == sorted(losses, reverse=True) and losses[-1] < 0.4
    got = fit.best.predict(test).collect()
    assert len(got) == 200 and all(r.pred == r.label for r in got)
    assert max(r[7] for r in fit.history) == 1.0 and fit.history[fit.best_epoch - 1][7] == 1.0
    history = spark.createDataFrame(fit.history, TR.HISTORY).withColumn("run", F.lit(1))
    best = TL.running_best(history.drop("is_new_best")).orderBy("epoch").collect()
    assert [r.is_new_best for r in best] == [r[8] for r in fit.history]
    assert TL.final_epoch(history).first().epoch == 4


def test_nothing_to_train_on(spark):
    none, some = spark.createDataFrame([], SCHEMA), spark.createDataFrame(corpus(10, 3), SCHEMA)
    fit = TR.fit_epochs(none, some, epochs=2, buckets=64)
    assert all(r[1] == 0 for r in fit.history) and {r.p_yes for r in fit.best.predict(some).collect()} == {0.5}
    assert TR.fit_epochs(some, none, epochs=1, buckets=64).history[0][3:8] == (0.0,) * 5


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(1)
    idf = rng.random(50) + 0.5
    at = pa.array([[1, 2, 2, 7], [], [49, 1], [3]], pa.list_(pa.int32()))
    y, w = np.array([1.0, 0, 0, 1]), rng.normal(size=51)
    rows = TR._sparse(at, idf)
    _, used, g = TR._gradient(w, *rows, y)
    assert used.tolist() == [1, 2, 3, 7, 49, 50]
    for b, v in zip(used, g, strict=True):
        loss = []
        for step in (1e-6, -1e-6):
            moved = w.copy()
            moved[b] += step
            s = TR._logits(moved, *rows)
            loss.append(np.logaddexp(0, np.where(y > 0, -s, s)).mean())
        assert v == pytest.approx((loss[0] - loss[1]) / 2e-6, rel=1e-4)


def test_pipeline_classifier_keeps_ids_and_labels_and_learns_a_separable_text(spark):
    train, test = (spark.createDataFrame(corpus(n, s), SCHEMA) for n, s in ((400, 5), (120, 6)))
    got = SC.train_text_classifier(train, test).select("doc_id", "label", "pred", "probs").collect()
    assert sorted((r.doc_id, int(r.label)) for r in got) == [(i, i % 2) for i in range(120)]
    assert all(abs(sum(r.probs) - 1) < 1e-9 and r.pred == int(r.probs[1] > r.probs[0]) for r in got)
    assert sum(r.pred == r.label for r in got) >= 0.97 * len(got)
