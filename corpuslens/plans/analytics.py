"""Queries: repeated runs and latency (2.9), corpus profiling (2.10) and
training-log analytics (2.11)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuslens.functions.numeric import round_to
from corpuslens.functions import parsing as P
from corpuslens.functions.text import word_count_sql
from corpuslens.operators import metrics as M
from corpuslens.operators import profile as PF
from corpuslens.operators import runs as R
from corpuslens.operators import sampling as S
from corpuslens.operators import sketches as SK
from corpuslens.operators import trainlog as T
from corpuslens.operators.scoring import predicted_confidence, probs_to_pred
from corpuslens.plans import fixtures as fx
from corpuslens.plans.fixtures import with_ctes
from corpuslens.plans.registry import query
from corpuslens.sources.io import scratch_path

METRICS = ["accuracy", "precision", "recall", "f1"]
RUNS, PER_RUN, SEED_STEP = 5, 50, 100
LATENCY_BASELINE = "purchase"   # the slow reference model of the latency table
OVERHEAD_BASE = "view"

# ---------------------------------------------------------------------------
# 2.9 repeated runs
# ---------------------------------------------------------------------------
RUNS_SQL = f"""
runs AS (SELECT doc_id, CAST(run AS INTEGER) AS run FROM labels CROSS JOIN range({RUNS}) AS r(run)
         QUALIFY row_number() OVER (PARTITION BY run ORDER BY {S.seed_key_sql(f'run * {SEED_STEP}', 'doc_id')}, doc_id) <= {PER_RUN}),
pr AS (SELECT r.run, p.model, p.label, {P.parse_contains_sql('p.reply')} AS pred
       FROM runs r JOIN predictions p ON r.doc_id = p.doc_id),
rm AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * (precision * recall) / (precision + recall) ELSE 0.0 END AS f1
       FROM (SELECT model, run, CASE WHEN tp + fp + tn + fn > 0 THEN (tp + tn) / (tp + fp + tn + fn) ELSE 0.0 END AS accuracy,
                    CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
                    CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall
             FROM (SELECT model, run, count_if(pred = 1 AND label = 1) AS tp, count_if(pred = 1 AND label = 0) AS fp,
                          count_if(pred = 0 AND label = 0) AS tn, count_if(pred = 0 AND label = 1) AS fn
                   FROM pr GROUP BY model, run))),
long AS (SELECT model, run, metric, CAST(value * 100.0 AS DOUBLE) AS value FROM rm
         UNPIVOT (value FOR metric IN (accuracy, precision, recall, f1)))"""


def run_metrics_long(spark, sf_dir):
    labels = fx.table(spark, sf_dir, "labels").select("doc_id")
    runs = S.sample_multi_seed(labels, "doc_id", PER_RUN, RUNS, SEED_STEP).select("doc_id", "run")
    preds = fx.predictions(spark, sf_dir).withColumn("pred", P.parse_contains("reply"))
    joined = runs.join(preds, "doc_id")
    per_run = M.binary_metrics(joined, by=["model", "run"])
    return R.unpivot_metrics(per_run, ["model", "run"], METRICS, 100.0)


@query("run_variance", with_ctes(["predictions"], """
SELECT model, metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std,
       round(var_pop(value), 6) AS variance, min(value) AS min, max(value) AS max, list(value ORDER BY run) AS "values"
FROM long GROUP BY model, metric""", [RUNS_SQL]))
def run_variance_q(spark, sf_dir):
    v = R.run_variance(run_metrics_long(spark, sf_dir))
    return v.select("model", "metric", *[round_to(c, 6).alias(c) for c in ("mean", "std", "variance")],
                    "min", "max", "values")


@query("variance_config", f"""
WITH runs AS (SELECT doc_id, CAST(run AS INTEGER) AS run, CAST(run * {SEED_STEP} AS INTEGER) AS seed
              FROM labels CROSS JOIN range({RUNS}) AS r(run)
              QUALIFY row_number() OVER (PARTITION BY run ORDER BY {S.seed_key_sql(f'run * {SEED_STEP}', 'doc_id')}, doc_id) <= {PER_RUN})
SELECT count(DISTINCT run) AS num_runs, max(n) AS samples_per_run, CAST(sum(n) AS BIGINT) AS total_rows, list(seed ORDER BY seed) AS seeds
FROM (SELECT run, seed, count(*) AS n FROM runs GROUP BY run, seed)""")
def variance_config_q(spark, sf_dir):
    labels = fx.table(spark, sf_dir, "labels").select("doc_id")
    runs = S.sample_multi_seed(labels, "doc_id", PER_RUN, RUNS, SEED_STEP)
    per = runs.groupBy("run", "seed").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.count_distinct("run").alias("num_runs"), F.max("n").alias("samples_per_run"),
                   F.sum("n").alias("total_rows"), F.array_sort(F.collect_list("seed")).alias("seeds"))


@query("latency_stats", with_ctes(["latencies"], """
SELECT model, round(avg(ms), 6) AS mean, round(coalesce(stddev_samp(ms), 0.0), 6) AS std, min(ms) AS min,
       max(ms) AS max, round(median(ms), 6) AS median, count(ms) AS n_runs
FROM latencies GROUP BY model"""))
def latency_stats_q(spark, sf_dir):
    s = R.latency_stats(fx.latencies(spark, sf_dir))
    return s.select("model", round_to("mean", 6).alias("mean"), round_to("std", 6).alias("std"), "min", "max",
                    round_to("median", 6).alias("median"), "n_runs")


@query("latency_per_text", with_ctes(["latencies"], """
SELECT model, text_id, round(avg(ms), 6) AS mean_ms, count(*) AS n FROM latencies GROUP BY model, text_id"""))
def latency_per_text_q(spark, sf_dir):
    lat = fx.latencies(spark, sf_dir)
    return lat.groupBy("model", "text_id").agg(round_to(F.avg("ms"), 6).alias("mean_ms"), F.count(F.lit(1)).alias("n"))


@query("warmup_trim", with_ctes(["latencies"], """
SELECT model, text_id, event_id, ms FROM latencies
QUALIFY row_number() OVER (PARTITION BY model, text_id ORDER BY ts, event_id) > 3"""))
def warmup_trim_q(spark, sf_dir):
    lat = fx.latencies(spark, sf_dir)
    return R.warmup_trim(lat, ["model", "text_id"], ["ts", "event_id"], 3, "event_id") \
            .select("model", "text_id", "event_id", "ms")


@query("speedup_vs_baseline", with_ctes(["latencies"], f"""
SELECT model, round(mean, 6) AS mean, round(max(CASE WHEN model = '{LATENCY_BASELINE}' THEN mean END) OVER () / mean, 6) AS speedup
FROM (SELECT model, avg(ms) AS mean FROM latencies GROUP BY model)"""))
def speedup_vs_baseline_q(spark, sf_dir):
    s = fx.latencies(spark, sf_dir).groupBy("model").agg(F.avg("ms").alias("mean"))
    s = R.with_ratio_to(s, "mean", "model", LATENCY_BASELINE, "speedup", inverse=True)
    return s.select("model", round_to("mean", 6).alias("mean"), round_to("speedup", 6).alias("speedup"))


@query("overhead_pct", with_ctes(["latencies"], f"""
SELECT model, round((mean - base) / base * 100.0, 6) AS overhead_pct
FROM (SELECT model, mean, max(CASE WHEN model = '{OVERHEAD_BASE}' THEN mean END) OVER () AS base
      FROM (SELECT model, avg(ms) AS mean FROM latencies GROUP BY model))"""))
def overhead_pct_q(spark, sf_dir):
    s = fx.latencies(spark, sf_dir).groupBy("model").agg(F.avg("ms").alias("mean"))
    base = F.max(F.when(F.col("model") == OVERHEAD_BASE, F.col("mean"))).over(Window.partitionBy())  # one row per model
    s = s.withColumn("base", base)
    return s.select("model", round_to(R.overhead_pct(F.col("mean"), F.col("base")), 6).alias("overhead_pct"))


# ---------------------------------------------------------------------------
# 2.10 corpus profiling
# ---------------------------------------------------------------------------
def _docs_labels(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").join(fx.table(spark, sf_dir, "labels"), "doc_id", "left")


@query("corpus_overview", """
WITH t AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic
           FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT column_name, data_type, null_count, (SELECT count(*) FROM t) AS row_count FROM (
  SELECT 'doc_id' AS column_name, 'bigint' AS data_type, count_if(doc_id IS NULL) AS null_count FROM t UNION ALL
  SELECT 'text', 'string', count_if(text IS NULL) FROM t UNION ALL
  SELECT 'lang', 'string', count_if(lang IS NULL) FROM t UNION ALL
  SELECT 'source', 'string', count_if(source IS NULL) FROM t UNION ALL
  SELECT 'n_chars', 'bigint', count_if(n_chars IS NULL) FROM t UNION ALL
  SELECT 'quality', 'int', count_if(quality IS NULL) FROM t UNION ALL
  SELECT 'toxic', 'int', count_if(toxic IS NULL) FROM t)""")
def corpus_overview_q(spark, sf_dir):
    return PF.corpus_overview(_docs_labels(spark, sf_dir))


SPLIT_SQL = f"""split AS (
  SELECT doc_id, class, text,
         CASE WHEN row_number() OVER (PARTITION BY class ORDER BY {S.seed_key_sql(42, 'doc_id')}, doc_id)
                   <= round_even(count(*) OVER (PARTITION BY class) * CAST(0.8 AS DOUBLE), 0)
              THEN 'train' ELSE 'test' END AS split
  FROM corpus_a)"""


def _split(spark, sf_dir):
    return S.split_per_class(fx.corpus_a(spark, sf_dir), "class", "doc_id", 42, 0.8)


@query("class_distribution", with_ctes(["corpus_a"], """
SELECT split, class, n, n / sum(n) OVER (PARTITION BY split) * 100.0 AS pct FROM (
  SELECT split, class, count(*) AS n FROM split GROUP BY split, class
  UNION ALL SELECT 'all', class, count(*) FROM split GROUP BY class)""", [SPLIT_SQL]))
def class_distribution_q(spark, sf_dir):
    sp = _split(spark, sf_dir)
    g = sp.rollup("class", "split").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_gid"))
    g = g.where(F.col("_gid") < 3).select(F.coalesce("split", F.lit("all")).alias("split"), "class", "n")
    return PF.share_by(g, "n", ["split"])


@query("label_rate", with_ctes(["corpus_b"], """
SELECT CAST(sum(label) AS BIGINT) AS positives, CAST(count(*) - sum(label) AS BIGINT) AS negatives,
       avg(label) AS label_mean FROM corpus_b"""))
def label_rate_q(spark, sf_dir):
    b = fx.corpus_b(spark, sf_dir)
    return b.agg(F.sum("label").cast("long").alias("positives"),
                 (F.count(F.lit(1)) - F.sum("label")).cast("long").alias("negatives"),
                 F.avg("label").alias("label_mean"))


@query("subtype_totals", with_ctes(["corpus_c"], "SELECT flag, CAST(total AS BIGINT) AS total FROM (SELECT " +
       ", ".join(f"sum({s}) AS {s}" for s in fx.SUBTYPES) + " FROM corpus_c) UNPIVOT (total FOR flag IN (" +
       ", ".join(fx.SUBTYPES) + "))"))
def subtype_totals_q(spark, sf_dir):
    c = fx.corpus_c(spark, sf_dir)
    wide = c.agg(*[F.sum(s).cast("long").alias(s) for s in fx.SUBTYPES])
    cells = F.array(*[F.struct(F.lit(s).alias("flag"), F.col(s).alias("total")) for s in fx.SUBTYPES])
    return wide.select(F.explode(cells).alias("c")).select("c.flag", "c.total")


WORDS_SQL = word_count_sql("text")


@query("text_lengths", with_ctes(["corpus_a"], f"""
SELECT doc_id, CAST(length(text) AS INTEGER) AS text_length, CAST({WORDS_SQL} AS INTEGER) AS word_count FROM corpus_a"""))
def text_lengths_q(spark, sf_dir):
    return PF.text_lengths(fx.corpus_a(spark, sf_dir)).select(
        "doc_id", F.col("text_length"), F.col("word_count"))


def _describe_sql(value: str, source: str, by: str = "") -> str:
    sel = f"{by}, " if by else ""
    grp = f" GROUP BY {by}" if by else ""
    return (f"SELECT {sel}count({value}) AS count, round(avg({value}), 6) AS mean, round(stddev_samp({value}), 6) AS std, "
            f"CAST(min({value}) AS DOUBLE) AS min, round(quantile_cont({value}, 0.25), 6) AS p25, "
            f"round(quantile_cont({value}, 0.5), 6) AS p50, round(quantile_cont({value}, 0.75), 6) AS p75, "
            f"CAST(max({value}) AS DOUBLE) AS max FROM {source}{grp}")


def _round_describe(df, keep):
    return df.select(*keep, "count", *[round_to(c, 6).alias(c) for c in ("mean", "std")], "min",
                     *[round_to(c, 6).alias(c) for c in ("p25", "p50", "p75")], "max")


@query("describe_lengths", f"""
WITH t AS (SELECT length(text) AS text_length, {WORDS_SQL} AS word_count FROM documents)
SELECT 'text_length' AS measure, * FROM ({_describe_sql('text_length', 't')})
UNION ALL SELECT 'word_count', * FROM ({_describe_sql('word_count', 't')})""")
def describe_lengths_q(spark, sf_dir):
    t = PF.text_lengths(fx.table(spark, sf_dir, "documents"))
    return _round_describe(PF.describe_columns(t, ["text_length", "word_count"]), ["measure"])


@query("describe_lengths_approx")
def describe_lengths_approx_q(spark, sf_dir):
    """Quartiles from one sketch per file, merged (no oracle: approximate; the rank error is tested)."""
    store = SK.update_store(spark, scratch_path(spark, "sketches"), f"{sf_dir}/documents.parquet", PF.text_lengths, ["text_length", "word_count"])
    return SK.describe_sketches(store)


_CONFIDENCE_CTE = "conf AS (SELECT model, CASE WHEN probs[2] > probs[1] THEN probs[2] ELSE probs[1] END AS v FROM probabilities)"


def _confidences(spark, sf_dir):
    return predicted_confidence(probs_to_pred(fx.probabilities(spark, sf_dir)))


@query("describe_confidence", with_ctes(["probabilities"], _describe_sql("v", "conf", "model"), [_CONFIDENCE_CTE]))
def describe_confidence_q(spark, sf_dir):
    """A fractional column: exact quartiles without holding a model's values in one buffer."""
    return _round_describe(PF.describe(_confidences(spark, sf_dir), "confidence", ["model"]), ["model"])


@query("histogram_confidence", with_ctes(["probabilities"], """
, mm AS (SELECT CAST(min(v) AS DOUBLE) AS lo, CAST(max(v) AS DOUBLE) AS hi FROM conf),
c AS (SELECT CAST(least(floor((v - lo) / ((hi - lo) / 20.0)), 19) AS INTEGER) AS bin, count(*) AS n FROM conf, mm GROUP BY 1)
SELECT CAST(b.bin AS INTEGER) AS bin, lo + b.bin * ((hi - lo) / 20.0) AS bin_start,
       lo + (b.bin + 1) * ((hi - lo) / 20.0) AS bin_end, coalesce(c.n, 0) AS count
FROM range(20) AS b(bin) CROSS JOIN mm LEFT JOIN c ON b.bin = c.bin""", [_CONFIDENCE_CTE]))
def histogram_confidence_q(spark, sf_dir):
    return PF.histogram(_confidences(spark, sf_dir).select("confidence"), "confidence", 20)


@query("latency_stats_all_models", with_ctes(["latencies"], """
SELECT m.model, round(coalesce(avg(ms), 0.0), 6) AS mean, round(coalesce(stddev_samp(ms), 0.0), 6) AS std,
       coalesce(min(ms), 0.0) AS min, coalesce(max(ms), 0.0) AS max, round(coalesce(median(ms), 0.0), 6) AS median, count(ms) AS n_runs
FROM (SELECT DISTINCT model FROM latencies UNION SELECT 'offline') m LEFT JOIN latencies l ON m.model = l.model GROUP BY m.model"""))
def latency_stats_all_models_q(spark, sf_dir):
    """Also a model without timings: zeros."""
    timings = fx.latencies(spark, sf_dir)
    models = timings.select("model").union(spark.range(1).select(F.lit("offline").alias("model"))).distinct()
    s = R.latency_stats_for(models, timings)
    return s.select("model", *[round_to(c, 6).alias(c) for c in ("mean", "std")], "min", "max", round_to("median", 6).alias("median"), "n_runs")


@query("run_names", with_ctes(["batch_log"], """
SELECT run, 'run-' || run || '-' || strftime(min(ts), '%Y%m%d-%H%M') AS run_name, strftime(max(ts), '%Y-%m-%d') AS last_date
FROM batch_log GROUP BY run"""))
def run_names_q(spark, sf_dir):
    """Run names stamped with the first log time (a value of the data, so results repeat)."""
    g = fx.batch_log(spark, sf_dir).groupBy("run").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return g.select("run", F.concat(F.lit("run-"), F.col("run").cast("string"), F.lit("-"), F.date_format("a", "yyyyMMdd-HHmm")).alias("run_name"),
                    F.date_format("b", "yyyy-MM-dd").alias("last_date"))


@query("describe_by_class", with_ctes(["corpus_a"], f"""
WITH t AS (SELECT class, {WORDS_SQL} AS word_count FROM corpus_a)
{_describe_sql('word_count', 't', 'class')}""").replace("\nWITH t AS", ",\nt AS"))
def describe_by_class_q(spark, sf_dir):
    t = PF.text_lengths(fx.corpus_a(spark, sf_dir))
    return _round_describe(PF.describe(t, "word_count", ["class"]), ["class"])


@query("histogram", f"""
WITH t AS (SELECT {WORDS_SQL} AS v FROM documents),
mm AS (SELECT CAST(min(v) AS DOUBLE) AS lo, CAST(max(v) AS DOUBLE) AS hi FROM t),
c AS (SELECT CAST(least(floor((v - lo) / ((hi - lo) / 50.0)), 49) AS INTEGER) AS bin, count(*) AS n FROM t, mm GROUP BY 1)
SELECT CAST(b.bin AS INTEGER) AS bin, lo + b.bin * ((hi - lo) / 50.0) AS bin_start,
       lo + (b.bin + 1) * ((hi - lo) / 50.0) AS bin_end, coalesce(c.n, 0) AS count
FROM range(50) AS b(bin) CROSS JOIN mm LEFT JOIN c ON b.bin = c.bin""")
def histogram_q(spark, sf_dir):
    t = PF.text_lengths(fx.table(spark, sf_dir, "documents")).select("word_count")
    return PF.histogram(t, "word_count", 50)


@query("split_ratio", with_ctes(["corpus_a"], """
SELECT count_if(split = 'train') / count(*) * 100.0 AS train_pct, count_if(split = 'test') / count(*) * 100.0 AS test_pct,
       count_if(split = 'train') / count_if(split = 'test') AS train_test_ratio FROM split""", [SPLIT_SQL]))
def split_ratio_q(spark, sf_dir):
    sp = _split(spark, sf_dir)
    n = F.count(F.lit(1))
    tr, te = F.count_if(F.col("split") == "train"), F.count_if(F.col("split") == "test")
    return sp.agg((tr / n * 100.0).alias("train_pct"), (te / n * 100.0).alias("test_pct"),
                  (tr / te).alias("train_test_ratio"))


# Row labels of the summary table (fixed values).
SUMMARY_METRICS = ["Total Samples", "Sarcastic Samples", "Non-Sarcastic Samples", "Class Balance (%)",
                   "Avg Character Length", "Avg Word Count", "Min Character Length", "Max Character Length",
                   "Min Word Count", "Max Word Count"]


@query("corpus_summary", with_ctes(["corpus_a"], f"""
, per AS (SELECT split, count(*) AS n, count_if(class = 'sarc') AS s, count_if(class = 'notsarc') AS ns,
                avg(length(text)) AS ac, avg({WORDS_SQL}) AS aw, min(length(text)) AS minc, max(length(text)) AS maxc,
                min({WORDS_SQL}) AS minw, max({WORDS_SQL}) AS maxw
         FROM split GROUP BY split),
cells AS (
  SELECT split, 0 AS i, CAST(n AS VARCHAR) AS v FROM per UNION ALL
  SELECT split, 1, CAST(s AS VARCHAR) FROM per UNION ALL
  SELECT split, 2, CAST(ns AS VARCHAR) FROM per UNION ALL
  SELECT split, 3, printf('%.1f / %.1f', s / n * 100.0, ns / n * 100.0) FROM per UNION ALL
  SELECT split, 4, printf('%.1f', ac) FROM per UNION ALL
  SELECT split, 5, printf('%.1f', aw) FROM per UNION ALL
  SELECT split, 6, CAST(minc AS VARCHAR) FROM per UNION ALL
  SELECT split, 7, CAST(maxc AS VARCHAR) FROM per UNION ALL
  SELECT split, 8, CAST(minw AS VARCHAR) FROM per UNION ALL
  SELECT split, 9, CAST(maxw AS VARCHAR) FROM per)
SELECT ({"[" + ", ".join(f"'{m}'" for m in SUMMARY_METRICS) + "]"})[i + 1] AS metric,
       max(CASE WHEN split = 'train' THEN v END) AS train, max(CASE WHEN split = 'test' THEN v END) AS test
FROM cells GROUP BY i""", [SPLIT_SQL]))
def corpus_summary_q(spark, sf_dir):
    sp = PF.text_lengths(_split(spark, sf_dir))
    c = F.col("class")
    per = sp.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(c == "sarc").alias("s"), F.count_if(c == "notsarc").alias("ns"),
        F.avg("text_length").alias("ac"), F.avg("word_count").alias("aw"),
        F.min("text_length").alias("minc"), F.max("text_length").alias("maxc"),
        F.min("word_count").alias("minw"), F.max("word_count").alias("maxw"))
    values = [F.col("n").cast("string"), F.col("s").cast("string"), F.col("ns").cast("string"),
              F.concat(PF.fmt1(F.col("s") / F.col("n") * 100.0), F.lit(" / "), PF.fmt1(F.col("ns") / F.col("n") * 100.0)),
              PF.fmt1(F.col("ac")), PF.fmt1(F.col("aw")), F.col("minc").cast("string"), F.col("maxc").cast("string"),
              F.col("minw").cast("string"), F.col("maxw").cast("string")]
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(i).alias("i"), v.alias("v"))
                      for i, (m, v) in enumerate(zip(SUMMARY_METRICS, values))])
    long = per.select("split", F.explode(cells).alias("c")).select("split", "c.metric", "c.i", "c.v")
    return long.groupBy("metric", "i").pivot("split", ["train", "test"]).agg(F.first("v")).drop("i")


@query("confidence_pairs", with_ctes(["probabilities"], """
SELECT a.doc_id, a.probs[a.pred + 1] AS sft_confidence, b.probs[b.pred + 1] AS dpo_confidence,
       b.probs[b.pred + 1] > a.probs[a.pred + 1] AS above_diagonal
FROM (SELECT *, CASE WHEN probs[2] > probs[1] THEN 1 ELSE 0 END AS pred FROM probabilities WHERE model = 'sft') a
JOIN (SELECT *, CASE WHEN probs[2] > probs[1] THEN 1 ELSE 0 END AS pred FROM probabilities WHERE model = 'dpo') b
  ON a.doc_id = b.doc_id"""))
def confidence_pairs_q(spark, sf_dir):
    p = predicted_confidence(probs_to_pred(fx.probabilities(spark, sf_dir)))
    a = p.where(F.col("model") == "sft").select("doc_id", F.col("confidence").alias("sft_confidence"))
    b = p.where(F.col("model") == "dpo").select("doc_id", F.col("confidence").alias("dpo_confidence"))
    j = a.join(b, "doc_id")
    return j.withColumn("above_diagonal", F.col("dpo_confidence") > F.col("sft_confidence"))


# ---------------------------------------------------------------------------
# 2.11 training logs
# ---------------------------------------------------------------------------
REWARD_STEP_SQL = """per_step AS (
  SELECT run, CAST(dayofmonth(ts) AS INTEGER) AS step, avg(chosen_reward) AS chosen_mean,
         avg(rejected_reward) AS rejected_mean FROM reward_log GROUP BY 1, 2)"""


def _per_step(spark, sf_dir):
    log = fx.reward_log(spark, sf_dir).withColumn("step", F.dayofmonth("ts").cast("int"))
    return T.reward_ratio(log)


@query("reward_ratio", with_ctes(["reward_log"], """
SELECT run, step, round(chosen_mean, 6) AS chosen_mean, round(rejected_mean, 6) AS rejected_mean,
       round(chosen_mean / (rejected_mean + 1e-8), 6) AS reward_ratio FROM per_step""", [REWARD_STEP_SQL]))
def reward_ratio_q(spark, sf_dir):
    r = _per_step(spark, sf_dir)
    return r.select("run", "step", *[round_to(c, 6).alias(c) for c in ("chosen_mean", "rejected_mean", "reward_ratio")])


@query("rolling_drift", with_ctes(["reward_log"], """
SELECT run, step, round(coalesce(stddev_pop(chosen_mean) OVER (PARTITION BY run ORDER BY step
                                 ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 0.0), 6) AS drift
FROM per_step""", [REWARD_STEP_SQL]))
def rolling_drift_q(spark, sf_dir):
    d = T.rolling_drift(_per_step(spark, sf_dir))
    return d.select("run", "step", round_to("drift", 6).alias("drift"))


@query("log_batch_table", with_ctes(["batch_log"], """
SELECT run, step, loss, learning_rate, epoch FROM batch_log WHERE loss IS NOT NULL"""))
def log_batch_table_q(spark, sf_dir):
    return T.log_batch_table(fx.batch_log(spark, sf_dir))


@query("epoch_metrics", with_ctes(["epoch_log", "batch_log"], """
SELECT e.run, e.epoch, e.end_step, e.eval_accuracy, e.eval_precision, e.eval_recall, e.eval_f1,
       coalesce(arg_max(b.loss, b.step), 0.0) AS train_loss
FROM epoch_log e LEFT JOIN batch_log b ON b.run = e.run AND b.step <= e.end_step AND b.loss IS NOT NULL
GROUP BY ALL"""))
def epoch_metrics_q(spark, sf_dir):
    return T.epoch_metrics(fx.epoch_log(spark, sf_dir), fx.batch_log(spark, sf_dir))


@query("running_best_f1", with_ctes(["epoch_log"], """
SELECT run, epoch, eval_f1, best_before, eval_f1 > best_before AS is_new_best, greatest(eval_f1, best_before) AS best_so_far
FROM (SELECT run, epoch, eval_f1,
             coalesce(max(eval_f1) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS best_before
      FROM epoch_log)"""))
def running_best_f1_q(spark, sf_dir):
    e = fx.epoch_log(spark, sf_dir).select("run", "epoch", "eval_f1")
    return T.running_best(e).select("run", "epoch", "eval_f1", "best_before", "is_new_best", "best_so_far")


@query("final_epoch", with_ctes(["epoch_log"], """
SELECT run, epoch, end_step, eval_accuracy, eval_precision, eval_recall, eval_f1 FROM epoch_log
QUALIFY row_number() OVER (PARTITION BY run ORDER BY epoch DESC) = 1"""))
def final_epoch_q(spark, sf_dir):
    return T.final_epoch(fx.epoch_log(spark, sf_dir))


@query("training_summary", with_ctes(["batch_log"], """
SELECT run, count_if(loss IS NOT NULL) AS train_samples, count_if(loss IS NULL) AS validation_samples,
       CAST(max(epoch) AS INTEGER) AS last_epoch FROM batch_log GROUP BY run"""))
def training_summary_q(spark, sf_dir):
    b = fx.batch_log(spark, sf_dir)
    return b.groupBy("run").agg(F.count_if(F.col("loss").isNotNull()).alias("train_samples"),
                                F.count_if(F.col("loss").isNull()).alias("validation_samples"),
                                F.max("epoch").cast("int").alias("last_epoch"))


@query("epoch_mean_loss", with_ctes(["batch_log"], """
SELECT run, CAST(epoch AS INTEGER) AS epoch, round(avg(loss), 6) AS mean_loss,
       round(avg(CAST(loss < 1.0 AS DOUBLE)), 6) AS accuracy
FROM batch_log WHERE loss IS NOT NULL GROUP BY run, epoch"""))
def epoch_mean_loss_q(spark, sf_dir):
    b = fx.batch_log(spark, sf_dir).where(F.col("loss").isNotNull())
    return b.groupBy("run", F.col("epoch").cast("int").alias("epoch")).agg(
        round_to(F.avg("loss"), 6).alias("mean_loss"),
        round_to(F.avg((F.col("loss") < 1.0).cast("double")), 6).alias("accuracy"))
