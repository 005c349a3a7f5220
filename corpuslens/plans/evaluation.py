"""Queries: reply parsing (2.5) and classification metrics (2.8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.functions.numeric import round_to
from corpuslens.functions import parsing as P
from corpuslens.functions.prompts import prompt_zero_shot, prompt_zero_shot_sql
from corpuslens.functions.text import head_chars, pystrip_sql
from corpuslens.operators import metrics as M
from corpuslens.operators.scoring import predicted_confidence, probs_to_pred
from corpuslens.operators.parsing_ops import resolve_attempts
from corpuslens.plans import fixtures as fx
from corpuslens.plans.fixtures import with_ctes
from corpuslens.plans.registry import query

# ---------------------------------------------------------------------------
# 2.5 reply parsing: one row per (model, doc) with the parsed class.
# ---------------------------------------------------------------------------


def _register_rule(name: str) -> None:
    spark_fn, sql_fn = P.RULES[name]
    sql = with_ctes(["predictions"],
                    f"SELECT model, doc_id, reply, {sql_fn('reply')} AS pred FROM predictions")

    @query(name, sql)
    def _q(spark, sf_dir, _fn=spark_fn):
        return fx.predictions(spark, sf_dir).select("model", "doc_id", "reply", _fn(F.col("reply")).alias("pred"))


for _rule in P.RULES:
    _register_rule(_rule)


@query("parse_cut_prompt", with_ctes(["predictions_text"], f"""
SELECT model, doc_id, pred FROM (
  SELECT model, doc_id, {P.parse_cut_prompt_sql('response', 'prompt')} AS pred
  FROM (SELECT model, doc_id, prompt, prompt || reply AS response
        FROM (SELECT model, doc_id, reply, {prompt_zero_shot_sql('text')} AS prompt FROM predictions_text)))"""))
def parse_cut_prompt_q(spark, sf_dir):
    df = fx.predictions_text(spark, sf_dir).withColumn("prompt", prompt_zero_shot(F.col("text")))
    df = df.withColumn("response", F.concat("prompt", "reply"))
    return df.select("model", "doc_id", P.parse_cut_prompt("response", "prompt").alias("pred"))


@query("parse_word_bag", with_ctes(["predictions_text"], f"""
SELECT model, doc_id, {P.parse_word_bag_sql('response', 'text')} AS pred
FROM (SELECT model, doc_id, text, text || chr(10) || reply AS response FROM predictions_text)"""))
def parse_word_bag_q(spark, sf_dir):
    df = fx.predictions_text(spark, sf_dir)
    df = df.withColumn("response", F.concat("text", F.lit("\n"), "reply"))
    return df.select("model", "doc_id", P.parse_word_bag("response", "text").alias("pred"))


@query("resolve_attempts", with_ctes(["attempts"], f"""
SELECT doc_id, label,
       CASE WHEN first_ok IS NOT NULL THEN first_ok.pred
            WHEN last_try.error IS NOT NULL THEN -1
            ELSE {P.parse_strict_fallback_sql('last_try.raw_reply')} END AS pred,
       CASE WHEN first_ok IS NOT NULL THEN first_ok.response
            WHEN last_try.error IS NOT NULL THEN last_try.error
            ELSE {pystrip_sql('last_try.raw_reply')} END AS response,
       CAST(CASE WHEN first_ok IS NOT NULL THEN first_ok.attempt ELSE last_try.attempt END + 1 AS INTEGER) AS attempts_used
FROM (
  SELECT doc_id, any_value(label) AS label,
         arg_min({{'pred': {P.parse_strict_sql('raw_reply')}, 'response': {pystrip_sql('raw_reply')}, 'attempt': attempt}}, attempt)
           FILTER (WHERE error IS NULL AND {P.parse_strict_sql('raw_reply')} <> -1) AS first_ok,
         arg_max({{'raw_reply': raw_reply, 'error': error, 'attempt': attempt}}, attempt) AS last_try
  FROM attempts GROUP BY doc_id)"""))
def resolve_attempts_q(spark, sf_dir):
    return resolve_attempts(fx.attempts(spark, sf_dir))


# ---------------------------------------------------------------------------
# 2.8 metrics over the parsed predictions (contains-or-unclear rule).
# ---------------------------------------------------------------------------
def _parsed(spark, sf_dir):
    return fx.predictions(spark, sf_dir).withColumn("pred", P.parse_contains_unclear("reply"))


PARSED_CTE = f"parsed AS (SELECT *, {P.parse_contains_unclear_sql('reply')} AS pred FROM predictions)"
BINARY_CTE = f"parsed01 AS (SELECT *, {P.parse_contains_sql('reply')} AS pred FROM predictions)"

_RATIOS_SQL = """
  CASE WHEN {valid} > 0 THEN {correct} / {valid} ELSE 0.0 END AS accuracy,
  CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
  CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall"""
_F1_SQL = "CASE WHEN precision + recall > 0 THEN 2 * (precision * recall) / (precision + recall) ELSE 0.0 END AS f1"


def metrics_sql(source: str, by: str = "model") -> str:
    return f"""
SELECT *, {_F1_SQL} FROM (
  SELECT *, {_RATIOS_SQL.format(valid='valid_predictions', correct='correct_predictions')} FROM (
    SELECT {by},
           count(*) AS total_samples,
           count_if(pred <> -1) AS valid_predictions,
           count_if(pred = -1) AS unclear_responses,
           count_if(pred <> -1 AND pred = label) AS correct_predictions,
           count_if(pred = 1 AND label = 1) AS tp, count_if(pred = 1 AND label = 0) AS fp,
           count_if(pred = 0 AND label = 0) AS tn, count_if(pred = 0 AND label = 1) AS fn
    FROM {source} GROUP BY {by}))"""


def binary_sql(source: str, by: str = "model") -> str:
    return f"""
SELECT *, {_F1_SQL} FROM (
  SELECT *, {_RATIOS_SQL.format(valid='(tp + fp + tn + fn)', correct='(tp + tn)')} FROM (
    SELECT {by}, count_if(pred = 1 AND label = 1) AS tp, count_if(pred = 1 AND label = 0) AS fp,
           count_if(pred = 0 AND label = 0) AS tn, count_if(pred = 0 AND label = 1) AS fn
    FROM {source} GROUP BY {by}))"""


@query("metrics_with_unclear", with_ctes(["predictions"], metrics_sql("parsed"), [PARSED_CTE]))
def metrics_with_unclear_q(spark, sf_dir):
    return M.metrics_with_unclear(_parsed(spark, sf_dir))


@query("confusion_counts", with_ctes(["predictions"], """
SELECT model, count_if(pred = 1 AND label = 1) AS tp, count_if(pred = 1 AND label = 0) AS fp,
       count_if(pred = 0 AND label = 0) AS tn, count_if(pred = 0 AND label = 1) AS fn
FROM parsed GROUP BY model""", [PARSED_CTE]))
def confusion_counts_q(spark, sf_dir):
    return M.confusion_counts(_parsed(spark, sf_dir))


@query("binary_metrics", with_ctes(["predictions"], binary_sql("parsed01"), [BINARY_CTE]))
def binary_metrics_q(spark, sf_dir):
    df = fx.predictions(spark, sf_dir).withColumn("pred", P.parse_contains("reply"))
    return M.binary_metrics(df)


# per-class and report: predictions from probabilities (argmax).
PROB_PRED_CTE = """probpred AS (
  SELECT model, doc_id, label, probs,
         CASE WHEN probs[2] > probs[1] THEN 1 ELSE 0 END AS pred FROM probabilities)"""


def _probpred(spark, sf_dir):
    return probs_to_pred(fx.probabilities(spark, sf_dir))


_PER_CLASS_SQL = """
SELECT model, cls, CASE WHEN pp > 0 THEN tp / pp ELSE 0.0 END AS precision,
       CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall,
       CASE WHEN (CASE WHEN pp > 0 THEN tp / pp ELSE 0.0 END) + (CASE WHEN support > 0 THEN tp / support ELSE 0.0 END) > 0
            THEN 2 * ((CASE WHEN pp > 0 THEN tp / pp ELSE 0.0 END) * (CASE WHEN support > 0 THEN tp / support ELSE 0.0 END))
                 / ((CASE WHEN pp > 0 THEN tp / pp ELSE 0.0 END) + (CASE WHEN support > 0 THEN tp / support ELSE 0.0 END))
            ELSE 0.0 END AS f1,
       support
FROM (SELECT model, c.cls AS cls, count_if(pred = c.cls AND label = c.cls) AS tp, count_if(pred = c.cls) AS pp,
             count_if(label = c.cls) AS support
      FROM probpred CROSS JOIN (VALUES (0), (1)) AS c(cls) GROUP BY model, c.cls)"""


@query("per_class_metrics", with_ctes(["probabilities"], _PER_CLASS_SQL, [PROB_PRED_CTE]))
def per_class_metrics_q(spark, sf_dir):
    return M.per_class_metrics(_probpred(spark, sf_dir))


@query("classification_report", with_ctes(["probabilities"], f"""
SELECT model, row_name, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM (
  SELECT model, CASE cls WHEN 0 THEN 'notsarc' ELSE 'sarc' END AS row_name, precision, recall, f1, support FROM pc
  UNION ALL
  SELECT model, 'accuracy', NULL, NULL, sum(recall * support) / sum(support), CAST(sum(support) AS BIGINT) FROM pc GROUP BY model
  UNION ALL
  SELECT model, 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM pc GROUP BY model
  UNION ALL
  SELECT model, 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
         sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM pc GROUP BY model)""",
    [PROB_PRED_CTE, "pc AS (" + _PER_CLASS_SQL + ")"]))
def classification_report_q(spark, sf_dir):
    rep = M.classification_report(_probpred(spark, sf_dir), names=["notsarc", "sarc"])
    return rep.select("model", "row_name", *[round_to(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("confusion_normalized", with_ctes(["predictions"], """
SELECT model, label, pred, n, CASE WHEN sum(n) OVER (PARTITION BY model, label) > 0
       THEN n / sum(n) OVER (PARTITION BY model, label) * 100.0 ELSE 0.0 END AS pct
FROM (SELECT m.model, CAST(l.v AS INTEGER) AS label, CAST(p.v AS INTEGER) AS pred,
             (SELECT count(*) FROM parsed x WHERE x.model = m.model AND x.label = l.v AND x.pred = p.v) AS n
      FROM (SELECT DISTINCT model FROM parsed) m, (VALUES (0), (1)) l(v), (VALUES (0), (1)) p(v))""", [PARSED_CTE]))
def confusion_normalized_q(spark, sf_dir):
    return M.confusion_normalized(_parsed(spark, sf_dir))


@query("per_class_accuracy", with_ctes(["predictions"], """
SELECT model, label, count(*) AS n, avg(CAST(pred = label AS DOUBLE)) AS accuracy
FROM parsed GROUP BY model, label""", [PARSED_CTE]))
def per_class_accuracy_q(spark, sf_dir):
    return M.per_class_accuracy(_parsed(spark, sf_dir))


@query("misclassified_examples", with_ctes(["probabilities"], """
SELECT p.model, p.doc_id, p.label, p.pred, p.probs[1] AS prob_0, p.probs[2] AS prob_1,
       p.probs[p.pred + 1] AS confidence, substring(d.text, 1, 100) AS text_preview, d.text,
       CASE p.label WHEN 1 THEN 'sarc' ELSE 'notsarc' END AS true_class,
       CASE p.pred WHEN 1 THEN 'sarc' ELSE 'notsarc' END AS predicted_class
FROM probpred p JOIN documents d ON p.doc_id = d.doc_id
WHERE p.pred <> p.label
QUALIFY row_number() OVER (PARTITION BY p.model ORDER BY p.doc_id) <= 20""", [PROB_PRED_CTE]))
def misclassified_examples_q(spark, sf_dir):
    from corpuslens.operators.compare import top_k_per_group
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", "text")
    wrong = predicted_confidence(_probpred(spark, sf_dir)).where(F.col("pred") != F.col("label"))
    # first 20 wrong rows per model, in id order (top-k is the feature)
    first = top_k_per_group(wrong, ["model"], [F.col("doc_id")], 20)
    return first.join(docs, "doc_id").select(
        "model", "doc_id", "label", "pred",
        F.element_at("probs", 1).alias("prob_0"), F.element_at("probs", 2).alias("prob_1"),
        "confidence", head_chars("text", 100).alias("text_preview"), "text",
        *[F.when(F.col(c) == 1, "sarc").otherwise("notsarc").alias(n)
          for c, n in (("label", "true_class"), ("pred", "predicted_class"))])


@query("error_rate", with_ctes(["probabilities"], """
SELECT model, count_if(pred <> label) AS errors, count(*) AS total,
       count_if(pred <> label) / count(*) * 100.0 AS error_pct
FROM probpred GROUP BY model""", [PROB_PRED_CTE]))
def error_rate_q(spark, sf_dir):
    return M.error_rate(_probpred(spark, sf_dir))

