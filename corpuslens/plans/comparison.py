"""Queries: joins and pairing (2.7), ranking and comparison (2.12)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuslens.functions import parsing as P
from corpuslens.functions.numeric import round_to
from corpuslens.functions.text import head_chars
from corpuslens.operators import metrics as M
from corpuslens.operators import pairing as PG
from corpuslens.operators import runs as R
from corpuslens.operators.compare import custom_order, custom_order_sql, regression_flag
from corpuslens.operators.normalize import decode_prediction, mean_std_text
from corpuslens.operators.quantiles import exact_percentile
from corpuslens.operators.scoring import yes_no_confidence
from corpuslens.plans import fixtures as fx
from corpuslens.plans.analytics import METRICS, RUNS_SQL, run_metrics_long
from corpuslens.plans.evaluation import PARSED_CTE, _parsed, metrics_sql
from corpuslens.plans.fixtures import with_ctes
from corpuslens.plans.registry import query
from corpuslens.plans.shaping import MODEL_ORDER

# Fixed maps of the comparison charts: model -> latency key; stage order.
LATENCY_KEYS = {"base": "view", "sft": "signup", "dpo": "purchase", "gpt4": "click"}
STAGES = ["base", "sft", "dpo"]
REFERENCE_MODEL = "gpt4"
# Sweep: beta per run (the 'error' run failed and is missing from the table).
SWEEP_BETAS = {"view": 0.05, "signup": 0.1, "purchase": 0.2, "click": 0.5, "error": 1.0}


def _metrics(spark, sf_dir, by=("model",)):
    return M.metrics_with_unclear(_parsed(spark, sf_dir), by=list(by))


MET_SQL = "met AS (" + metrics_sql("parsed") + ")"

# ---------------------------------------------------------------------------
# 2.7 pairing
# ---------------------------------------------------------------------------


@query("align_predictions", with_ctes(["predictions", "corpus_a"], """
SELECT p.model, p.doc_id, c.class, p.label, p.pred, p.pred = p.label AS correct, substring(c.text, 1, 80) AS text_preview
FROM parsed p JOIN corpus_a c ON p.doc_id = c.doc_id""", [PARSED_CTE]))
def align_predictions_q(spark, sf_dir):
    corpus = fx.corpus_a(spark, sf_dir)
    p = _parsed(spark, sf_dir)
    j = p.join(corpus, "doc_id")
    return j.select("model", "doc_id", "class", "label", "pred", (F.col("pred") == F.col("label")).alias("correct"),
                    head_chars("text", 80).alias("text_preview"))


PAIRED_SQL = """
scored AS (SELECT p.model, p.doc_id, p.label, p.reply, p.pred,
                  round(CASE WHEN p.pred = 1 THEN CASE WHEN q.probs[2] + q.probs[1] > 0 THEN q.probs[2] / (q.probs[2] + q.probs[1]) * 100.0 ELSE 0.0 END
                             WHEN p.pred = 0 THEN CASE WHEN q.probs[2] + q.probs[1] > 0 THEN q.probs[1] / (q.probs[2] + q.probs[1]) * 100.0 ELSE 0.0 END
                             ELSE greatest(CASE WHEN q.probs[2] + q.probs[1] > 0 THEN q.probs[2] / (q.probs[2] + q.probs[1]) * 100.0 ELSE 0.0 END,
                                           CASE WHEN q.probs[2] + q.probs[1] > 0 THEN q.probs[1] / (q.probs[2] + q.probs[1]) * 100.0 ELSE 0.0 END) END, 2) AS confidence
           FROM parsed p JOIN probabilities q ON p.model = q.model AND p.doc_id = q.doc_id),
paired AS (
  SELECT a.doc_id, d.text, CASE WHEN a.label = 1 THEN 'sarc' ELSE 'notsarc' END AS true_label, a.label,
         CASE a.pred WHEN 1 THEN 'Yes' WHEN 0 THEN 'No' ELSE 'Unclear' END AS sft_prediction, a.confidence AS sft_confidence,
         a.reply AS sft_response,
         CASE b.pred WHEN 1 THEN 'Yes' WHEN 0 THEN 'No' ELSE 'Unclear' END AS dpo_prediction, b.confidence AS dpo_confidence,
         b.reply AS dpo_response, a.pred = a.label AS sft_correct, b.pred = b.label AS dpo_correct
  FROM scored a JOIN scored b ON a.doc_id = b.doc_id AND a.model = 'sft' AND b.model = 'dpo'
  JOIN documents d ON a.doc_id = d.doc_id)"""


def paired(spark, sf_dir, with_text=True):
    """Paired predictions of SFT and DPO: text, truth, both answers with
    confidences and raw replies.  The text is joined only where it is asked for."""
    p = _parsed(spark, sf_dir)
    probs = fx.probabilities(spark, sf_dir).select("model", "doc_id", "probs")
    s = p.join(probs, ["model", "doc_id"])
    s = s.withColumn("confidence", round_to(yes_no_confidence(F.element_at("probs", 2), F.element_at("probs", 1),
                                                             F.col("pred")), 2))
    s = s.withColumn("answer", decode_prediction("pred"))
    pm = PG.pair_models(s, "sft", "dpo", value="pred", extra=["answer", "confidence", "reply"])
    if with_text:
        pm = pm.join(fx.table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return pm.select("doc_id", *["text"] * with_text, F.when(F.col("label") == 1, "sarc").otherwise("notsarc").alias("true_label"),
                     "label", F.col("sft_answer").alias("sft_prediction"), "sft_confidence",
                     F.col("sft_reply").alias("sft_response"), F.col("dpo_answer").alias("dpo_prediction"),
                     "dpo_confidence", F.col("dpo_reply").alias("dpo_response"), "sft_correct", "dpo_correct")


@query("pair_models", with_ctes(["predictions", "probabilities"], """
SELECT doc_id, text, true_label, sft_prediction, sft_confidence, sft_response, dpo_prediction, dpo_confidence,
       dpo_response, sft_correct, dpo_correct FROM paired""", [PARSED_CTE, PAIRED_SQL]))
def pair_models_q(spark, sf_dir):
    return paired(spark, sf_dir).drop("label")


def _cells():
    t, s, d = F.col("true_label"), F.col("sft_prediction"), F.col("dpo_prediction")
    return {
        "notsarc_sft_wrong_dpo_right": (t == "notsarc") & (s == "Yes") & (d == "No"),
        "notsarc_sft_right_dpo_wrong": (t == "notsarc") & (s == "No") & (d == "Yes"),
        "sarc_sft_wrong_dpo_right": (t == "sarc") & (s == "No") & (d == "Yes"),
        "sarc_sft_right_dpo_wrong": (t == "sarc") & (s == "Yes") & (d == "No"),
    }


_CELLS_SQL = {
    "notsarc_sft_wrong_dpo_right": "true_label = 'notsarc' AND sft_prediction = 'Yes' AND dpo_prediction = 'No'",
    "notsarc_sft_right_dpo_wrong": "true_label = 'notsarc' AND sft_prediction = 'No' AND dpo_prediction = 'Yes'",
    "sarc_sft_wrong_dpo_right": "true_label = 'sarc' AND sft_prediction = 'No' AND dpo_prediction = 'Yes'",
    "sarc_sft_right_dpo_wrong": "true_label = 'sarc' AND sft_prediction = 'Yes' AND dpo_prediction = 'No'",
}


@query("disagreement_counts", with_ctes(["predictions", "probabilities"], "SELECT " + ", ".join(
    f"count_if({c}) AS {n}" for n, c in _CELLS_SQL.items()) + ", count(*) AS n FROM paired", [PARSED_CTE, PAIRED_SQL]))
def disagreement_counts_q(spark, sf_dir):
    p = paired(spark, sf_dir, with_text=False)
    return p.agg(*[F.count_if(c).alias(n) for n, c in _cells().items()], F.count(F.lit(1)).alias("n"))


@query("disagreement_confidence", with_ctes(["predictions", "probabilities"], f"""
SELECT round(avg(CASE WHEN {_CELLS_SQL['notsarc_sft_wrong_dpo_right']} THEN dpo_confidence END), 6) AS dpo_conf_fixed_fp,
       round(avg(CASE WHEN {_CELLS_SQL['notsarc_sft_right_dpo_wrong']} THEN dpo_confidence END), 6) AS dpo_conf_new_fp,
       round(avg(sft_confidence), 6) AS mean_sft_confidence, round(avg(dpo_confidence), 6) AS mean_dpo_confidence
FROM paired""", [PARSED_CTE, PAIRED_SQL]))
def disagreement_confidence_q(spark, sf_dir):
    p = paired(spark, sf_dir, with_text=False)
    c = _cells()
    conf = F.col("dpo_confidence")
    return p.agg(round_to(PG.mean_where(conf, c["notsarc_sft_wrong_dpo_right"]), 6).alias("dpo_conf_fixed_fp"),
                 round_to(PG.mean_where(conf, c["notsarc_sft_right_dpo_wrong"]), 6).alias("dpo_conf_new_fp"),
                 round_to(F.avg("sft_confidence"), 6).alias("mean_sft_confidence"),
                 round_to(F.avg("dpo_confidence"), 6).alias("mean_dpo_confidence"))


SCAN_LIMIT = 52  # rows 0..51 are examined


@query("find_better_example", with_ctes(["predictions", "probabilities"], f"""
, firsts AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM paired ORDER BY doc_id LIMIT {SCAN_LIMIT}),
hit AS (SELECT max(idx) AS idx FROM firsts WHERE dpo_correct AND NOT sft_correct)
SELECT hit.idx IS NOT NULL AS found_dpo_better_example, CAST(hit.idx AS BIGINT) AS "index",
       (SELECT doc_id FROM firsts WHERE firsts.idx = hit.idx) AS doc_id,
       CAST(coalesce(hit.idx + 1, (SELECT count(*) FROM paired)) AS BIGINT) AS samples_checked,
       f.text, f.true_label, f.sft_prediction, f.sft_confidence, f.sft_response, f.dpo_prediction, f.dpo_confidence, f.dpo_response
FROM hit LEFT JOIN firsts f ON f.idx = hit.idx""", [PARSED_CTE, PAIRED_SQL]))
def find_better_example_q(spark, sf_dir):
    """The last row among the first 52 (id order) where DPO is right and SFT
    wrong, with its text, replies and confidences; samples_checked = index + 1, or
    the whole set when none is found."""
    p = paired(spark, sf_dir, with_text=False)
    first = p.orderBy("doc_id").limit(SCAN_LIMIT)  # the scan stops at row 51: limit is the feature
    first = first.withColumn("idx", F.row_number().over(Window.orderBy("doc_id")) - 1)  # 52 rows
    shown = ["true_label", "sft_prediction", "sft_confidence", "sft_response", "dpo_prediction", "dpo_confidence", "dpo_response"]
    hit = first.where(F.col("dpo_correct") & ~F.col("sft_correct")).agg(
        F.max(F.struct("idx", "doc_id", *shown)).alias("hit"), F.lit(None).cast("long").alias("total"))
    total = p.agg(F.lit(None).cast(hit.schema["hit"].dataType).alias("hit"), F.count(F.lit(1)).alias("total"))
    # two one-row aggregates folded into one row (no join)
    out = hit.unionByName(total).agg(F.max("hit").alias("hit"), F.max("total").alias("total"))
    out = out.select(F.col("hit").isNotNull().alias("found_dpo_better_example"), F.col("hit.idx").cast("long").alias("index"),
                     F.col("hit.doc_id").alias("doc_id"),
                     F.coalesce(F.col("hit.idx") + 1, F.col("total")).cast("long").alias("samples_checked"),
                     *[F.col(f"hit.{c}").alias(c) for c in shown])
    text = fx.table(spark, sf_dir, "documents").select("doc_id", "text")
    return F.broadcast(out).join(text, "doc_id", "left")


@query("domain_gap", with_ctes(["predictions"], """
, dom AS (SELECT p.*, CASE WHEN d.lang = 'en' THEN 'in' ELSE 'out' END AS domain
          FROM parsed p JOIN documents d ON p.doc_id = d.doc_id),
dm AS (""" + metrics_sql("dom", "model, domain") + """)
SELECT a.model, a.f1 AS f1_in_domain, b.f1 AS f1_out_of_domain, a.f1 - b.f1 AS gap
FROM dm a JOIN dm b ON a.model = b.model AND a.domain = 'in' AND b.domain = 'out'""",
    [PARSED_CTE]))
def domain_gap_q(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", "lang")
    p = _parsed(spark, sf_dir).join(docs, "doc_id")
    p = p.withColumn("domain", F.when(F.col("lang") == "en", "in").otherwise("out"))
    m = M.metrics_with_unclear(p, by=["model", "domain"])
    return PG.domain_gap(m)


# the second corpus: the same texts under their other label, with replies of their own
PREDICTIONS_B_CTE = fx.PREDICTIONS_CTE.replace("predictions AS", "predictions_b AS").replace("l.toxic", "l.quality")
PARSED_B_CTE = PARSED_CTE.replace("parsed AS", "parsed_b AS").replace("FROM predictions", "FROM predictions_b")


@query("domain_gap_corpora", with_ctes(["predictions"], """
, a AS (""" + metrics_sql("parsed") + "), b AS (" + metrics_sql("parsed_b") + """)
SELECT a.model, a.f1 AS f1_in_domain, b.f1 AS f1_out_of_domain, a.f1 - b.f1 AS gap FROM a JOIN b ON a.model = b.model""",
    [PARSED_CTE, PREDICTIONS_B_CTE, PARSED_B_CTE]))
def domain_gap_corpora_q(spark, sf_dir):
    """The gap between two corpora, each with its own labels and replies."""
    labels = fx.table(spark, sf_dir, "labels")
    second = fx.predictions_from(labels.withColumn("toxic", F.col("quality"))).withColumn("pred", P.parse_contains_unclear("reply"))
    both = _parsed(spark, sf_dir).withColumn("domain", F.lit("in")).unionByName(second.withColumn("domain", F.lit("out")))
    return PG.domain_gap(M.metrics_with_unclear(both, by=["model", "domain"]))


def _keymap_sql():
    return "(VALUES " + ", ".join(f"('{m}', '{k}')" for m, k in LATENCY_KEYS.items()) + ") AS km(model, lat_key)"


LATQ_SQL = f"""
latq AS (SELECT met.model, round(l.mean, 6) AS latency_ms, met.f1
         FROM met JOIN {_keymap_sql()} ON met.model = km.model
         JOIN (SELECT model AS lat_key, avg(ms) AS mean FROM latencies GROUP BY 1) l ON l.lat_key = km.lat_key)"""


def latency_quality(spark, sf_dir):
    met = _metrics(spark, sf_dir)
    keys = F.create_map(*[F.lit(x) for kv in LATENCY_KEYS.items() for x in kv])
    lat = fx.latencies(spark, sf_dir).groupBy(F.col("model").alias("lat_key")).agg(F.avg("ms").alias("mean"))
    m = met.withColumn("lat_key", keys[F.col("model")]).where(F.col("lat_key").isNotNull())
    return m.join(lat, "lat_key").select("model", round_to("mean", 6).alias("latency_ms"), "f1")


@query("latency_quality", with_ctes(["predictions", "latencies"], "SELECT model, latency_ms, f1 FROM latq",
                                    [PARSED_CTE, MET_SQL, LATQ_SQL]))
def latency_quality_q(spark, sf_dir):
    return latency_quality(spark, sf_dir)


@query("efficiency_summary", with_ctes(["predictions", "latencies"], f"""
SELECT min(f1) FILTER (WHERE model <> '{REFERENCE_MODEL}') AS min_local_f1,
       max(f1) FILTER (WHERE model <> '{REFERENCE_MODEL}') AS max_local_f1,
       max(latency_ms) FILTER (WHERE model <> '{REFERENCE_MODEL}') AS max_local_latency_ms,
       max(latency_ms) FILTER (WHERE model = '{REFERENCE_MODEL}') / max(latency_ms) FILTER (WHERE model <> '{REFERENCE_MODEL}') AS reference_slowdown,
       max(f1) FILTER (WHERE model = '{REFERENCE_MODEL}') - max(f1) FILTER (WHERE model <> '{REFERENCE_MODEL}') AS reference_f1_gap
FROM latq""", [PARSED_CTE, MET_SQL, LATQ_SQL]))
def efficiency_summary_q(spark, sf_dir):
    lq = latency_quality(spark, sf_dir)
    local = F.col("model") != REFERENCE_MODEL
    ref = F.col("model") == REFERENCE_MODEL
    return lq.agg(F.min(F.when(local, F.col("f1"))).alias("min_local_f1"),
                  F.max(F.when(local, F.col("f1"))).alias("max_local_f1"),
                  F.max(F.when(local, F.col("latency_ms"))).alias("max_local_latency_ms"),
                  (F.max(F.when(ref, F.col("latency_ms"))) / F.max(F.when(local, F.col("latency_ms"))))
                  .alias("reference_slowdown"),
                  (F.max(F.when(ref, F.col("f1"))) - F.max(F.when(local, F.col("f1")))).alias("reference_f1_gap"))


@query("attach_error_bars", with_ctes(["predictions"], """
, scores AS (SELECT model, metric, value * 100.0 AS score FROM (SELECT model, accuracy, precision, recall, f1 FROM met)
             UNPIVOT (value FOR metric IN (accuracy, precision, recall, f1))),
spread AS (SELECT model, metric, stddev_pop(value) AS std FROM long GROUP BY model, metric)
SELECT s.model, s.metric, s.score, round(coalesce(v.std, 0.0), 6) AS error_bar
FROM scores s LEFT JOIN spread v ON s.model = v.model AND s.metric = v.metric""",
    [PARSED_CTE, MET_SQL, RUNS_SQL]))
def attach_error_bars_q(spark, sf_dir):
    scores = R.unpivot_metrics(_metrics(spark, sf_dir), ["model"], METRICS, 100.0).withColumnRenamed("value", "score")
    spread = R.run_variance(run_metrics_long(spark, sf_dir)).select("model", "metric", "std")
    j = scores.join(spread, ["model", "metric"], "left")
    return j.select("model", "metric", "score", round_to(F.coalesce("std", F.lit(0.0)), 6).alias("error_bar"))


# ---------------------------------------------------------------------------
# 2.12 ranking and comparison (over the small per-model metric table)
# ---------------------------------------------------------------------------


@query("comparison_table", with_ctes(["predictions"], f"""
SELECT model, accuracy, precision, recall, f1, total_samples - correct_predictions AS errors,
       {custom_order_sql('model', MODEL_ORDER)} AS order_pos FROM met""", [PARSED_CTE, MET_SQL]))
def comparison_table_q(spark, sf_dir):
    m = _metrics(spark, sf_dir)
    return m.select("model", "accuracy", "precision", "recall", "f1",
                    (F.col("total_samples") - F.col("correct_predictions")).alias("errors"),
                    custom_order("model", MODEL_ORDER).alias("order_pos")).orderBy("order_pos")


@query("best_model", with_ctes(["predictions"], f"""
, ranked AS (SELECT *, {custom_order_sql('model', MODEL_ORDER)} AS pos FROM met)
SELECT (list(model ORDER BY f1 DESC, pos))[1] AS best_by_f1, max(f1) AS best_f1,
       (list(model ORDER BY accuracy DESC, pos))[1] AS best_by_accuracy,
       (list(model ORDER BY accuracy DESC, pos) FILTER (WHERE NOT contains(lower(model), 'gpt')))[1] AS best_local_by_accuracy
FROM ranked""", [PARSED_CTE, MET_SQL]))
def best_model_q(spark, sf_dir):
    m = _metrics(spark, sf_dir).withColumn("pos", custom_order("model", MODEL_ORDER))
    local = ~F.lower("model").contains("gpt")
    return m.agg(F.max_by("model", F.struct("f1", -F.col("pos"))).alias("best_by_f1"), F.max("f1").alias("best_f1"),
                 F.max_by("model", F.struct("accuracy", -F.col("pos"))).alias("best_by_accuracy"),
                 F.max_by(F.when(local, F.col("model")), F.when(local, F.struct("accuracy", -F.col("pos"))))
                 .alias("best_local_by_accuracy"))


@query("improvement_over_first", with_ctes(["predictions"], f"""
SELECT model, (accuracy - first_value(accuracy) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) * 100 AS improvement_points
FROM (SELECT *, {custom_order_sql('model', STAGES)} AS pos FROM met WHERE model IN ('base', 'sft', 'dpo'))""",
    [PARSED_CTE, MET_SQL]))
def improvement_over_first_q(spark, sf_dir):
    m = _metrics(spark, sf_dir).where(F.col("model").isin(*STAGES)).withColumn("pos", custom_order("model", STAGES))
    first = F.first("accuracy").over(Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return m.select("model", ((F.col("accuracy") - first) * 100).alias("improvement_points"))


@query("stage_gains", with_ctes(["predictions"], f"""
SELECT model, f1 - lag(f1) OVER w AS f1_gain, precision - lag(precision) OVER w AS precision_gain,
       recall - lag(recall) OVER w AS recall_gain
FROM (SELECT *, {custom_order_sql('model', STAGES)} AS pos FROM met WHERE model IN ('base', 'sft', 'dpo'))
WINDOW w AS (ORDER BY pos)""", [PARSED_CTE, MET_SQL]))
def stage_gains_q(spark, sf_dir):
    m = _metrics(spark, sf_dir).where(F.col("model").isin(*STAGES)).withColumn("pos", custom_order("model", STAGES))
    w = Window.orderBy("pos")  # three rows
    return m.select("model", *[(F.col(c) - F.lag(c).over(w)).alias(f"{c}_gain") for c in ("f1", "precision", "recall")])


@query("gap_to_reference", with_ctes(["predictions"], f"""
SELECT (max(accuracy) FILTER (WHERE model = '{REFERENCE_MODEL}') - max(accuracy) FILTER (WHERE model <> '{REFERENCE_MODEL}')) * 100
       AS gap_points FROM met""", [PARSED_CTE, MET_SQL]))
def gap_to_reference_q(spark, sf_dir):
    m = _metrics(spark, sf_dir)
    ref = F.col("model") == REFERENCE_MODEL
    return m.agg(((F.max(F.when(ref, F.col("accuracy"))) - F.max(F.when(~ref, F.col("accuracy")))) * 100)
                 .alias("gap_points"))


@query("regression_flag", with_ctes(["predictions"], """
, dom AS (SELECT p.*, d.lang FROM parsed p JOIN documents d ON p.doc_id = d.doc_id),
dm AS (""" + metrics_sql("dom", "model, lang") + """)
SELECT lang, (b.accuracy - a.accuracy) * 100 AS delta_points,
       CASE WHEN (b.accuracy - a.accuracy) * 100 < -2 THEN 'regression'
            WHEN (b.accuracy - a.accuracy) * 100 > 0 THEN 'improved' ELSE 'none' END AS flag
FROM dm a JOIN dm b USING (lang) WHERE a.model = 'sft' AND b.model = 'dpo'""",
    [PARSED_CTE]))
def regression_flag_q(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", "lang")
    m = M.metrics_with_unclear(_parsed(spark, sf_dir).join(docs, "doc_id"), by=["model", "lang"])
    a = m.where(F.col("model") == "sft").select("lang", F.col("accuracy").alias("a"))
    b = m.where(F.col("model") == "dpo").select("lang", F.col("accuracy").alias("b"))
    d = a.join(b, "lang").withColumn("delta_points", (F.col("b") - F.col("a")) * 100)
    return d.select("lang", "delta_points", regression_flag(F.col("delta_points")).alias("flag"))


def _sweep(spark, sf_dir):
    ev = fx.table(spark, sf_dir, "events")
    betas = F.create_map(*[F.lit(x) for kv in SWEEP_BETAS.items() for x in kv])
    done = ev.where(F.col("event_type") != "error")  # the failed run leaves no row
    g = done.groupBy("event_type").agg(F.avg("value").alias("_v"))
    return g.select(betas[F.col("event_type")].alias("beta"),
                    F.concat(F.lit("beta_"), F.col("event_type")).alias("output_dir"),
                    F.lit(3).alias("epoch"), round_to(F.col("_v") / 100.0 % 1, 6).alias("eval_f1"))


@query("sweep_best", """
WITH sweep AS (SELECT CASE event_type WHEN 'view' THEN 0.05 WHEN 'signup' THEN 0.1 WHEN 'purchase' THEN 0.2
                                      WHEN 'click' THEN 0.5 WHEN 'error' THEN 1.0 END::DOUBLE AS beta,
                      round(fmod(avg(value) / 100.0, 1), 6) AS eval_f1
               FROM events WHERE event_type <> 'error' GROUP BY event_type)
SELECT (list(beta ORDER BY eval_f1 DESC, beta))[1] AS best_beta, max(eval_f1) AS best_f1, count(*) AS completed_runs
FROM sweep""")
def sweep_best_q(spark, sf_dir):
    """Best beta by F1; ties go to the first beta of the sweep (ascending);
    null when the sweep table is empty."""
    sw = _sweep(spark, sf_dir)
    return sw.agg(F.max_by("beta", F.struct(F.col("eval_f1"), -F.col("beta"))).alias("best_beta"),
                  F.max("eval_f1").alias("best_f1"), F.count(F.lit(1)).alias("completed_runs"))


@query("variance_table", with_ctes(["predictions"], """
SELECT model, """ + ", ".join(
    f"max(CASE WHEN metric = '{m}' THEN printf('%.1f', mean) || '±' || printf('%.1f', std) END) AS {m}" for m in METRICS)
    + """ FROM (SELECT model, metric, avg(value) AS mean, stddev_pop(value) AS std FROM long GROUP BY model, metric)
GROUP BY model""", [RUNS_SQL]))
def variance_table_q(spark, sf_dir):
    v = R.run_variance(run_metrics_long(spark, sf_dir))
    cell = v.select("model", "metric", mean_std_text(F.col("mean"), F.col("std")).alias("t"))
    return cell.groupBy("model").pivot("metric", METRICS).agg(F.first("t"))


LATENCY_TABLE_MODELS = ["base", "sft", "dpo", "gpt4", "bert"]


@query("latency_table", with_ctes(["latencies", "predictions"], f"""
, stats AS (SELECT km.model, avg(l.ms) AS mean, stddev_samp(l.ms) AS std, median(l.ms) AS median
            FROM latencies l JOIN {_keymap_sql()} ON l.model = km.lat_key GROUP BY km.model),
names AS (SELECT DISTINCT model FROM predictions UNION SELECT 'bert')
SELECT n.model, coalesce(printf('%.2f', s.mean), 'N/A') AS mean_ms, coalesce(printf('%.2f', s.std), 'N/A') AS std_ms,
       coalesce(printf('%.2f', s.median), 'N/A') AS median_ms,
       coalesce(printf('%.1f', max(s.mean) FILTER (WHERE s.model = '{REFERENCE_MODEL}') OVER () / s.mean) || 'x', 'N/A') AS speedup
FROM names n LEFT JOIN stats s ON n.model = s.model"""))
def latency_table_q(spark, sf_dir):
    """Model, mean, std, median and speed-up over the reference model; N/A
    where a model has no timings (the model list is the predictions' models
    plus one extra name)."""
    from corpuslens.operators.profile import fmt1
    lat = fx.latencies(spark, sf_dir)
    models = fx.predictions(spark, sf_dir).select("model").distinct() \
        .unionByName(spark.range(1).select(F.lit("bert").alias("model"))).distinct()
    inv = F.create_map(*[F.lit(x) for k, v in LATENCY_KEYS.items() for x in (v, k)])
    mapped = lat.withColumn("model", inv[F.col("model")]).where(F.col("model").isNotNull())
    stats = mapped.groupBy("model").agg(F.avg("ms").alias("mean"), F.stddev_samp("ms").alias("std")) \
        .join(exact_percentile(mapped, ["model"], "ms", 0.5, "median"), "model", "left")
    t = models.join(stats, "model", "left")
    ref = F.max(F.when(F.col("model") == REFERENCE_MODEL, F.col("mean"))).over(Window.partitionBy(F.lit(0)))

    def f2(c):
        return F.regexp_replace(F.format_number(c, 2), ",", "")

    return t.select("model", F.coalesce(f2(F.col("mean")), F.lit("N/A")).alias("mean_ms"),
                    F.coalesce(f2(F.col("std")), F.lit("N/A")).alias("std_ms"),
                    F.coalesce(f2(F.col("median")), F.lit("N/A")).alias("median_ms"),
                    F.coalesce(F.concat(fmt1(ref / F.col("mean")), F.lit("x")), F.lit("N/A")).alias("speedup"))

