"""Queries: scoring and confidence (2.6) and the streaming jobs (2.13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.functions.numeric import round_to
from corpuslens.functions import parsing as P
from corpuslens.functions.text import words_sql
from corpuslens.operators import sampling as S
from corpuslens.operators import scoring as SC
from corpuslens.operators import trainlog as TL
from corpuslens.operators import training as TR
from corpuslens.operators.normalize import encode_label
from corpuslens.plans import fixtures as fx
from corpuslens.plans.evaluation import PARSED_CTE, _parsed
from corpuslens.plans.fixtures import with_ctes
from corpuslens.plans.registry import query
from corpuslens.session import materialise
from corpuslens.sources.io import scratch_path
from corpuslens.streaming import jobs as ST


def _cue_hits_sql(t: str) -> str:
    return " + ".join(f"((length({t}) - length(replace({t}, '{c}', ''))) // {len(c)})" for c in SC.SCORER_CUES)


_SCORE_SQL = f"""
scored AS (
  SELECT doc_id, least(({_cue_hits_sql('lt')}) / greatest(len({words_sql('lt')}), 1) * 10, 1.0) AS p_yes
  FROM (SELECT doc_id, lower(coalesce(text, '')) AS lt FROM documents))"""


@query("score_batches", with_ctes([], """
SELECT doc_id, CASE WHEN p_yes >= 0.5 THEN 'Yes' ELSE 'No' END AS reply, round(p_yes, 9) AS p_yes,
       round(1.0 - p_yes, 9) AS p_no, NULL::VARCHAR AS error FROM scored""", [_SCORE_SQL]).replace("WITH ,", "WITH "))
def score_batches_q(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents")
    s = SC.score_lexical(docs)
    return s.select("doc_id", "reply", round_to("p_yes", 9).alias("p_yes"), round_to("p_no", 9).alias("p_no"), "error")


def _fails_on_short_texts():
    """The lexical scorer, raising on a text of under 20 characters (what a
    failing model call looks like to the caller)."""
    score = SC.lexical_scorer()

    def run(texts):
        if (texts.fillna("").str.len() < 20).any():
            raise ValueError("text too short to score")
        return score(texts)

    return run


@query("score_errors_skipped", """
SELECT count_if(length(coalesce(text, '')) >= 20) AS scored, count_if(length(coalesce(text, '')) < 20) AS skipped
FROM documents""")
def score_errors_skipped_q(spark, sf_dir):
    """Rows whose scoring raises (here: texts under 20 characters) are
    reported and left out; the counts of both."""
    s = SC.score_batches(fx.table(spark, sf_dir, "documents"), scorer_factory=_fails_on_short_texts)
    return s.agg(F.count_if(F.col("error").isNull()).alias("scored"),
                 F.count_if(F.col("error").isNotNull()).alias("skipped"))


@query("softmax_probs", """
SELECT vec_id, CAST(unnest(range(len(e))) AS INTEGER) AS class_no, round(unnest(e) / list_sum(e), 9) AS p
FROM (SELECT vec_id, list_transform(v, lambda x: exp(x - list_max(v))) AS e
      FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings))""")
def softmax_probs_q(spark, sf_dir):
    e = fx.table(spark, sf_dir, "embeddings")
    p = e.select("vec_id", F.posexplode(SC.softmax("embedding")).alias("class_no", "p"))
    return p.select("vec_id", "class_no", round_to("p", 9).alias("p"))


@query("argmax_class", """
SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS pred, label FROM embeddings""")
def argmax_class_q(spark, sf_dir):
    e = fx.table(spark, sf_dir, "embeddings")
    return e.select("vec_id", SC.argmax("embedding").alias("pred"), "label")


@query("yes_no_confidence", with_ctes(["predictions", "probabilities"], """
SELECT p.model, p.doc_id, p.pred,
       round(CASE WHEN p.pred = 1 THEN CASE WHEN q.probs[2] + q.probs[1] > 0 THEN q.probs[2] / (q.probs[2] + q.probs[1]) * 100.0 ELSE 0.0 END
                  WHEN p.pred = 0 THEN CASE WHEN q.probs[2] + q.probs[1] > 0 THEN q.probs[1] / (q.probs[2] + q.probs[1]) * 100.0 ELSE 0.0 END
                  ELSE greatest(CASE WHEN q.probs[2] + q.probs[1] > 0 THEN q.probs[2] / (q.probs[2] + q.probs[1]) * 100.0 ELSE 0.0 END,
                                CASE WHEN q.probs[2] + q.probs[1] > 0 THEN q.probs[1] / (q.probs[2] + q.probs[1]) * 100.0 ELSE 0.0 END) END, 9) AS confidence
FROM parsed p JOIN probabilities q ON p.model = q.model AND p.doc_id = q.doc_id""", [PARSED_CTE]))
def yes_no_confidence_q(spark, sf_dir):
    p = _parsed(spark, sf_dir).join(fx.probabilities(spark, sf_dir).select("model", "doc_id", "probs"),
                                    ["model", "doc_id"])
    c = SC.yes_no_confidence(F.element_at("probs", 2), F.element_at("probs", 1), F.col("pred"))
    return p.select("model", "doc_id", "pred", round_to(c, 9).alias("confidence"))


@query("predicted_confidence", with_ctes(["probabilities"], """
SELECT model, round(avg(probs[pred + 1]), 9) AS mean_confidence, count(*) AS n
FROM (SELECT *, CASE WHEN probs[2] > probs[1] THEN 1 ELSE 0 END AS pred FROM probabilities) GROUP BY model"""))
def predicted_confidence_q(spark, sf_dir):
    p = SC.predicted_confidence(SC.probs_to_pred(fx.probabilities(spark, sf_dir)))
    return p.groupBy("model").agg(round_to(F.avg("confidence"), 9).alias("mean_confidence"),
                                  F.count(F.lit(1)).alias("n"))


@query("train_text_classifier")
def train_text_classifier_q(spark, sf_dir):
    """Fit on the train split of corpus A, predict its test split (no SQL
    oracle: an iterative fit)."""
    c = fx.corpus_a(spark, sf_dir).withColumn("label", encode_label("class"))
    parts = materialise(S.split_per_class(c, "class", "doc_id", 42, 0.8))  # every pass of the fit reads it
    train = parts.where(F.col("split") == "train").select("doc_id", "text", "label")
    test = parts.where(F.col("split") == "test").select("doc_id", "text", "label")
    return SC.train_text_classifier(train, test).select("doc_id", "label", "pred", "probs")


@query("train_epochs")
def train_epochs_q(spark, sf_dir):
    """Fit on the train split epoch by epoch, evaluate on the test split after each, with the running best F1
    (no oracle: an iterative fit)."""
    c = fx.corpus_a(spark, sf_dir).withColumn("label", encode_label("class"))
    parts = materialise(S.split_per_class(c, "class", "doc_id", 42, 0.8))
    train, test = (parts.where(F.col("split") == s) for s in ("train", "test"))
    history = spark.createDataFrame(TR.fit_epochs(train, test).history, TR.HISTORY).withColumn("run", F.lit(0)).drop("is_new_best")
    return TL.running_best(history).drop("run")


# ---------------------------------------------------------------------------
# 2.13 streaming
# ---------------------------------------------------------------------------
@query("stream_confusion", with_ctes(["predictions"], """
SELECT model, count_if(pred = 1 AND label = 1) AS tp, count_if(pred = 1 AND label = 0) AS fp,
       count_if(pred = 0 AND label = 0) AS tn, count_if(pred = 0 AND label = 1) AS fn
FROM parsed GROUP BY model""", [PARSED_CTE]))
def stream_confusion_q(spark, sf_dir):
    """Labels arrive as a file stream; replies are attached and parsed per
    micro-batch; the running counts' final state is read back."""
    schema = fx.table(spark, sf_dir, "labels").schema
    labels = ST.table_stream(spark, f"{sf_dir}/labels.parquet", schema)
    preds = fx.predictions_from(labels).withColumn("pred", P.parse_contains_unclear("reply"))
    base = scratch_path(spark, "stream-confusion")
    ST.run_to_end(ST.start_confusion(preds, f"{base}/out", f"{base}/checkpoint"))
    return ST.read_confusion(spark, f"{base}/out")


@query("stream_metric_log", with_ctes(["batch_log"], """
SELECT run, step, loss, learning_rate, epoch FROM batch_log"""))
def stream_metric_log_q(spark, sf_dir):
    schema = fx.table(spark, sf_dir, "events").schema
    events = ST.table_stream(spark, f"{sf_dir}/events.parquet", schema)
    log = fx.batch_log_from(events)
    base = scratch_path(spark, "stream-log")
    ST.run_to_end(ST.start_metric_log(log, f"{base}/out", f"{base}/checkpoint"))
    return ST.read_metric_log(spark, f"{base}/out").select("run", "step", "loss", "learning_rate", "epoch")
