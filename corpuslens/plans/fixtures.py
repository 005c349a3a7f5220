"""Stand-in inputs built from the driver's test tables.

Every experiment table the library works on (labelled corpora, model replies,
retry attempts, class probabilities, latency timings, training logs) is
derived here from the Parquet tables with Spark, so the work grows with the
data.  Each Spark builder has a twin SQL common-table expression (``*_CTE``)
that builds the same rows in DuckDB for the oracle check; the two must stay in
step.

Multiplying rows by a short fixed list (models, attempts, seeds) is an
``explode`` of a literal array, never a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.functions.numeric import round_to
from corpuslens.sources.io import CORPUS_C_FLAGS

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# ---------------------------------------------------------------------------
# Fixed values of the stand-ins (our own invention, shared with the SQL twins).
# ---------------------------------------------------------------------------
# Model names in evaluation order; position = model_no.
MODELS = ["base", "sft", "dpo", "gpt4"]
# Raw replies, picked by (doc_id * 7 + model_no + 3 * label) % 10.
REPLIES = [
    "Yes",
    "No.",
    "yes, this is sarcastic",
    "I know what you mean",
    "Not sarcastic.",
    "<think>maybe</think>No",
    "Answer: YES",
    "maybe",
    "  This is sarcastic.",
    "NO!",
]
# Error text of a failed attempt.
ATTEMPT_ERROR = "timeout"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _reply_case_sql(key_sql: str) -> str:
    whens = " ".join(f"WHEN {i} THEN {_sql_str(r)}" for i, r in enumerate(REPLIES))
    return f"CASE {key_sql} {whens} END"


def _reply_col(key: Column) -> Column:
    return F.element_at(F.array(*[F.lit(r) for r in REPLIES]), (key + 1).cast("int"))


def _models_sql() -> str:
    rows = ", ".join(f"({i}, {_sql_str(m)})" for i, m in enumerate(MODELS))
    return f"(VALUES {rows}) AS m(model_no, model)"


def _explode_models(df: DataFrame) -> DataFrame:
    models = F.array(*[F.struct(F.lit(i).alias("model_no"), F.lit(m).alias("model"))
                       for i, m in enumerate(MODELS)])
    return df.withColumn("_m", F.explode(models)).select("*", "_m.model_no", "_m.model").drop("_m")


# ---------------------------------------------------------------------------
# corpus A: (doc_id, class, text); class from the toxic flag.
# ---------------------------------------------------------------------------
def corpus_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return (labels.join(docs, "doc_id")
            .select("doc_id",
                    F.when(F.col("toxic") == 1, "sarc").otherwise("notsarc").alias("class"),
                    "text"))


CORPUS_A_CTE = """corpus_a AS (
  SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 'sarc' ELSE 'notsarc' END AS class, d.text
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


# corpus B: (comment, label) with its own column names; label from quality.
def corpus_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return labels.join(docs, "doc_id").select(
        "doc_id", F.col("text").alias("comment"), F.col("quality").cast("int").alias("label"), "lang")


CORPUS_B_CTE = """corpus_b AS (
  SELECT d.doc_id, d.text AS comment, CAST(l.quality AS INTEGER) AS label, d.lang
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


# corpus C: indexed tweets with six 0/1 subtype flags from n_chars % k.
SUBTYPES = CORPUS_C_FLAGS
SUBTYPE_MOD = [2, 3, 5, 7, 11, 13]


def corpus_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    flags = [(F.col("n_chars") % k == 0).cast("int").alias(name) for name, k in zip(SUBTYPES, SUBTYPE_MOD)]
    return docs.select(F.col("doc_id").alias("_c0"), F.col("text").alias("tweet"), *flags)


CORPUS_C_CTE = "corpus_c AS (SELECT doc_id AS _c0, text AS tweet, " + ", ".join(
    f"CAST(n_chars % {k} = 0 AS INTEGER) AS {name}" for name, k in zip(SUBTYPES, SUBTYPE_MOD)
) + " FROM documents)"


# ---------------------------------------------------------------------------
# predictions: (model, doc_id, label, reply), one row per model per labelled doc.
# ---------------------------------------------------------------------------
def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions_from(table(spark, sf_dir, "labels"))


def predictions_from(labels: DataFrame) -> DataFrame:
    """Replies for a labels frame (batch or stream)."""
    df = _explode_models(labels.select("doc_id", F.col("toxic").cast("int").alias("label")))
    key = (F.col("doc_id") * 7 + F.col("model_no") + 3 * F.col("label")) % 10
    return df.select("model", "model_no", "doc_id", "label", _reply_col(key).alias("reply"))


PREDICTIONS_CTE = f"""predictions AS (
  SELECT m.model, m.model_no, l.doc_id, CAST(l.toxic AS INTEGER) AS label,
         {_reply_case_sql('(l.doc_id * 7 + m.model_no + 3 * l.toxic) % 10')} AS reply
  FROM labels l CROSS JOIN {_models_sql()})"""


# predictions with the document text (for pairing and previews).
def predictions_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return predictions(spark, sf_dir).join(docs, "doc_id")


PREDICTIONS_TEXT_CTE = """predictions_text AS (
  SELECT p.*, d.text FROM predictions p JOIN documents d ON p.doc_id = d.doc_id)"""


# ---------------------------------------------------------------------------
# attempts: three tries per labelled doc; some fail with an error.
# ---------------------------------------------------------------------------
def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("int").alias("label"))
    df = labels.withColumn("attempt", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    failed = (F.col("doc_id") + F.col("attempt")) % 13 == 0
    key = (F.col("doc_id") * 7 + F.col("attempt") * 3 + 3 * F.col("label")) % 10
    return df.select(
        "doc_id", "label", F.col("attempt").cast("int").alias("attempt"),
        F.when(failed, F.lit(None).cast("string")).otherwise(_reply_col(key)).alias("raw_reply"),
        F.when(failed, F.lit(ATTEMPT_ERROR)).alias("error"))


ATTEMPTS_CTE = f"""attempts AS (
  SELECT l.doc_id, CAST(l.toxic AS INTEGER) AS label, CAST(a.attempt AS INTEGER) AS attempt,
         CASE WHEN (l.doc_id + a.attempt) % 13 = 0 THEN NULL
              ELSE {_reply_case_sql('(l.doc_id * 7 + a.attempt * 3 + 3 * l.toxic) % 10')} END AS raw_reply,
         CASE WHEN (l.doc_id + a.attempt) % 13 = 0 THEN '{ATTEMPT_ERROR}' END AS error
  FROM labels l CROSS JOIN (VALUES (0), (1), (2)) AS a(attempt))"""


# ---------------------------------------------------------------------------
# probabilities: (model, doc_id, label, probs[2]) from a fixed arithmetic rule.
# ---------------------------------------------------------------------------
def probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("int").alias("label"))
    df = _explode_models(labels)
    p1 = ((F.col("doc_id") * 37 + F.col("model_no")) % 101) / F.lit(101.0)
    return df.select("model", "model_no", "doc_id", "label", F.array(1.0 - p1, p1).alias("probs"))


PROBABILITIES_CTE = f"""probabilities AS (
  SELECT m.model, m.model_no, l.doc_id, CAST(l.toxic AS INTEGER) AS label,
         [1.0 - ((l.doc_id * 37 + m.model_no) % 101) / 101.0,
          ((l.doc_id * 37 + m.model_no) % 101) / 101.0] AS probs
  FROM labels l CROSS JOIN {_models_sql()})"""


# ---------------------------------------------------------------------------
# latencies: (model, text_id, ts, event_id, ms) from events.
# The run number is an order position inside (model, text_id); operators
# that need it compute it (see operators.runs).
# ---------------------------------------------------------------------------
def latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(F.col("event_type").alias("model"),
                     (F.col("user_id") % 5).cast("int").alias("text_id"),
                     "ts", "event_id", F.col("value").alias("ms"))


LATENCIES_CTE = """latencies AS (
  SELECT event_type AS model, CAST(user_id % 5 AS INTEGER) AS text_id, ts, event_id, value AS ms
  FROM events)"""


# ---------------------------------------------------------------------------
# training logs from events: run = user_id; ordered by (ts, event_id).
# ---------------------------------------------------------------------------
def reward_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, ts, event_id, chosen_reward, rejected_reward)."""
    ev = table(spark, sf_dir, "events")
    return ev.select(F.col("user_id").alias("run"), "ts", "event_id",
                     F.col("value").alias("chosen_reward"),
                     ((F.col("event_id") % 17) / F.lit(4.0)).alias("rejected_reward"))


REWARD_LOG_CTE = """reward_log AS (
  SELECT user_id AS run, ts, event_id, value AS chosen_reward, (event_id % 17) / 4.0 AS rejected_reward
  FROM events)"""


def batch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, step, loss, learning_rate, epoch, ts); step = event_id; loss only on some rows."""
    return batch_log_from(table(spark, sf_dir, "events"))


def batch_log_from(ev: DataFrame) -> DataFrame:
    """The batch log of an events frame (batch or stream)."""
    return ev.select(
        F.col("user_id").alias("run"), F.col("event_id").alias("step"),
        F.when(F.col("event_type") != "error", F.col("value") / 100.0).alias("loss"),
        (F.lit(5e-5) / (1 + F.col("event_id") % 10)).alias("learning_rate"),
        F.dayofmonth("ts").cast("double").alias("epoch"), "ts")


BATCH_LOG_CTE = """batch_log AS (
  SELECT user_id AS run, event_id AS step,
         CASE WHEN event_type <> 'error' THEN value / 100.0 END AS loss,
         5e-5 / (1 + event_id % 10) AS learning_rate,
         CAST(dayofmonth(ts) AS DOUBLE) AS epoch, ts
  FROM events)"""


def epoch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, epoch, end_step, eval_accuracy, eval_precision, eval_recall, eval_f1).

    One row per (run, day); the epoch's last step is the largest event_id that
    day.  Eval scores are derived from the day's event values.
    """
    ev = table(spark, sf_dir, "events")
    g = ev.groupBy(F.col("user_id").alias("run"), F.dayofmonth("ts").alias("epoch")).agg(
        F.max("event_id").alias("end_step"),
        F.avg("value").alias("_v"), F.count(F.lit(1)).alias("_n"))
    return g.select("run", F.col("epoch").cast("int").alias("epoch"), "end_step",
                    round_to((g["_v"] % 100) / 100.0, 6).alias("eval_accuracy"),
                    round_to((g["_v"] % 97) / 97.0, 6).alias("eval_precision"),
                    round_to((g["_n"] % 10) / 10.0, 6).alias("eval_recall"),
                    round_to(((g["_v"] + g["_n"]) % 89) / 89.0, 6).alias("eval_f1"))


EPOCH_LOG_CTE = """epoch_log AS (
  SELECT run, CAST(epoch AS INTEGER) AS epoch, end_step,
         round(fmod(_v, 100) / 100.0, 6) AS eval_accuracy,
         round(fmod(_v, 97) / 97.0, 6) AS eval_precision,
         round((_n % 10) / 10.0, 6) AS eval_recall,
         round(fmod(_v + _n, 89) / 89.0, 6) AS eval_f1
  FROM (SELECT user_id AS run, dayofmonth(ts) AS epoch, max(event_id) AS end_step,
               avg(value) AS _v, count(*) AS _n
        FROM events GROUP BY 1, 2))"""


ALL_CTES = {
    "corpus_a": CORPUS_A_CTE,
    "corpus_b": CORPUS_B_CTE,
    "corpus_c": CORPUS_C_CTE,
    "predictions": PREDICTIONS_CTE,
    "predictions_text": PREDICTIONS_TEXT_CTE,
    "attempts": ATTEMPTS_CTE,
    "probabilities": PROBABILITIES_CTE,
    "latencies": LATENCIES_CTE,
    "reward_log": REWARD_LOG_CTE,
    "batch_log": BATCH_LOG_CTE,
    "epoch_log": EPOCH_LOG_CTE,
}

# CTEs that read other CTEs.
_DEPENDS = {"predictions_text": ["predictions"]}


def with_ctes(names: list[str], body: str, extra: list[str] | None = None) -> str:
    """Prefix ``body`` with the named fixture CTEs (dependencies first) and extras."""
    ordered: list[str] = []
    for n in names:
        for dep in _DEPENDS.get(n, []):
            if dep not in ordered:
                ordered.append(dep)
        if n not in ordered:
            ordered.append(n)
    parts = [ALL_CTES[n] for n in ordered] + list(extra or [])
    return "WITH " + ",\n".join(parts) + "\n" + body
