"""Scoring: model replies, class probabilities and confidences.

Array maths (softmax, argmax, confidence pick) are higher-order column
functions.  Applying a model is the one place Python runs per batch:
``score_batches`` uses ``mapInPandas`` so rows cross to Python in Arrow
batches and the scorer is built once per task, never shipped from the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.text import col, word_count


def softmax(logits: Column | str) -> Column:
    """exp(x - max) / sum(exp(x - max)) over an array column."""
    a = col(logits).cast("array<double>")
    m = F.array_max(a)
    e = F.transform(a, lambda x: F.exp(x - m))
    total = F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(e, lambda x: x / total)


def argmax(values: Column | str) -> Column:
    """Index (0-based) of the first largest element."""
    a = col(values)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def probs_to_pred(df: DataFrame, probs: str = "probs") -> DataFrame:
    return df.withColumn("pred", argmax(probs))


def predicted_confidence(df: DataFrame, probs: str = "probs", pred: str = "pred") -> DataFrame:
    """Probability of the predicted class."""
    return df.withColumn("confidence", F.element_at(F.col(probs), F.col(pred) + 1))


def yes_no_confidence(p_yes: Column | str, p_no: Column | str, pred: Column | str) -> Column:
    """Confidence in percent from the yes / no token probabilities:
    renormalised to 100 (0 when both are 0); the predicted side's share, or
    the larger share when the prediction is unclear."""
    y, n, p = col(p_yes), col(p_no), col(pred)
    total = y + n
    yes_pct = F.when(total > 0, y / total * 100.0).otherwise(F.lit(0.0))
    no_pct = F.when(total > 0, n / total * 100.0).otherwise(F.lit(0.0))
    return F.when(p == 1, yes_pct).when(p == 0, no_pct).otherwise(F.greatest(yes_pct, no_pct))


# ---------------------------------------------------------------------------
# Batch scorer.  The shipped scorer is lexical and fixed (cue words), standing
# in for a model; any picklable factory returning ``texts -> (reply, p_yes,
# p_no)`` can be passed instead.
# ---------------------------------------------------------------------------
# Fixed cue words of the lexical scorer.
SCORER_CUES = ["oh", "great", "sure", "totally", "wow", "yeah", "love", "!"]

SCORE_SCHEMA = "doc_id long, reply string, p_yes double, p_no double, error string"


def lexical_scorer() -> Callable[[pd.Series], pd.DataFrame]:
    cues = SCORER_CUES

    def score(texts: pd.Series) -> pd.DataFrame:  # plain strings: a call on one row costs little
        lowered = [t.lower() for t in texts.fillna("")]
        hits = np.array([sum(t.count(c) for c in cues) for t in lowered], float)
        words = np.array([max(len(t.split()), 1) for t in lowered], float)
        p_yes = np.minimum(hits / words * 10, 1.0)
        return pd.DataFrame({"reply": np.where(p_yes >= 0.5, "Yes", "No").astype(object), "p_yes": p_yes, "p_no": 1.0 - p_yes})

    return score


def score_lexical(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The lexical scorer as columns: same result as ``score_batches(df)``, without Python."""
    lowered = F.lower(F.coalesce(col(text), F.lit("")))
    hits = sum((F.length(lowered) - F.length(F.replace(lowered, F.lit(c), F.lit("")))) / len(c) for c in SCORER_CUES)
    p_yes = F.least(hits / F.greatest(word_count(lowered), F.lit(1)) * 10, F.lit(1.0))
    return df.select(F.col(key).cast("long").alias("doc_id"), p_yes.alias("p_yes")).select(
        "doc_id", F.when(F.col("p_yes") >= 0.5, "Yes").otherwise("No").alias("reply"), "p_yes",
        (1.0 - F.col("p_yes")).alias("p_no"), F.lit(None).cast("string").alias("error"))


FEW = 4  # rows of a batch that raises: scored one by one from here on


def _scored(scorer: Callable[[pd.Series], pd.DataFrame], texts: pd.Series) -> pd.DataFrame:
    """Reply, p_yes, p_no and error of each text: whatever a scorer raises, the other rows go on."""
    parts, todo = [], [(0, len(texts))]
    while todo:
        i, j = todo.pop()
        try:
            got = scorer(texts.iloc[i:j].reset_index(drop=True))
        except Exception as e:  # noqa: BLE001
            if j - i > FEW:
                m = (i + j) // 2
                todo += [(i, m), (m, j)]
            elif j - i > 1:
                todo += [(k, k + 1) for k in range(i, j)]
            else:
                parts.append((i, [None], [np.nan], [np.nan], [f"{type(e).__name__}: {e}"]))
        else:
            parts.append((i, got["reply"], got["p_yes"], got["p_no"], [None] * len(got)))
    parts.sort(key=lambda p: p[0])
    kinds = {"reply": object, "p_yes": float, "p_no": float, "error": object}
    return pd.DataFrame({name: np.concatenate([np.asarray(p[k], kind) for p in parts]) for k, (name, kind) in enumerate(kinds.items(), 1)})


def score_batches(df: DataFrame, text: str = "text", key: str = "doc_id",
                  scorer_factory: Callable[[], Callable[[pd.Series], pd.DataFrame]] = lexical_scorer) -> DataFrame:
    """One reply (and yes/no scores) per row, computed batch by batch.

    When a batch raises, it is halved (the last few rows taken one by one) until the rows that raise stand alone; these are kept
    with the error text and null scores, so the caller can report and drop them
    (``score_errors_skipped``).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = scorer_factory()
        for pdf in batches:
            if pdf.empty:
                continue
            out = _scored(scorer, pdf[text].reset_index(drop=True))
            out.insert(0, "doc_id", pdf[key].astype("int64").to_numpy())
            yield out

    return df.select(F.col(key), F.col(text)).mapInPandas(run, SCORE_SCHEMA)


def train_text_classifier(train: DataFrame, test: DataFrame, text: str = "text", label: str = "label",
                          num_features: int = 1 << 18, max_iter: int = 20) -> DataFrame:
    """Fit tokenizer -> hashed term counts -> IDF -> logistic regression on
    ``train`` and predict ``test``; returns test rows with pred and probs."""
    from pyspark.ml import Pipeline as MLPipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer
    from pyspark.ml.functions import vector_to_array

    stages = [
        RegexTokenizer(inputCol=text, outputCol="_tok", pattern=r"\W+", toLowercase=True),
        HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=num_features),
        IDF(inputCol="_tf", outputCol="_feat"),
        LogisticRegression(featuresCol="_feat", labelCol=label, maxIter=max_iter, regParam=0.01),
    ]
    model = MLPipeline(stages=stages).fit(train.withColumn(label, F.col(label).cast("double")))
    out = model.transform(test.withColumn(label, F.col(label).cast("double")))
    return out.select(*[c for c in test.columns],
                      F.col("prediction").cast("int").alias("pred"),
                      vector_to_array("probability").alias("probs"))
