"""Queries: sources and sinks (2.1).  Each writes the data it derived from
the test tables to a fresh shared folder and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.functions.numeric import round_to
from corpuslens.operators import metrics as M
from corpuslens.operators import pairs as PA
from corpuslens.operators import runs as R
from corpuslens.operators import sampling as S
from corpuslens.operators.normalize import encode_label
from corpuslens.plans import fixtures as fx
from corpuslens.plans.evaluation import PARSED_CTE, _parsed, metrics_sql
from corpuslens.plans.fixtures import with_ctes
from corpuslens.plans.registry import query
from corpuslens.plans.shaping import MINED_CTE, MODEL_ORDER, SUMMARY_SQL, _mined
from corpuslens.sources import io

LATENCY_ORDER = ["purchase", "view", "signup", "missing", "click"]


@query("read_corpus_csv", with_ctes(["corpus_a"], "SELECT doc_id, class, text FROM corpus_a"))
def read_corpus_csv_q(spark, sf_dir):
    path = io.write_csv(fx.corpus_a(spark, sf_dir), io.scratch_path(spark, "corpus-a"))
    return io.read_corpus_csv(spark, path)


@query("read_indexed_csv", with_ctes(["corpus_c"], "SELECT _c0 AS row_id, tweet, " + ", ".join(fx.SUBTYPES) + " FROM corpus_c"))
def read_indexed_csv_q(spark, sf_dir):
    c = fx.corpus_c(spark, sf_dir)
    path = io.write_csv(c.withColumnRenamed("_c0", ""), io.scratch_path(spark, "corpus-c"))
    return io.read_indexed_csv(spark, path)


@query("scan_head", with_ctes(["corpus_a"], "SELECT doc_id, class FROM corpus_a ORDER BY doc_id LIMIT 10"))
def scan_head_q(spark, sf_dir):
    """The corpus is stored in id order; only the first file is opened."""
    path = io.write_csv(fx.corpus_a(spark, sf_dir).orderBy("doc_id"), io.scratch_path(spark, "corpus-a"))
    return io.scan_head(spark, path, io.CORPUS_A, 10).select("doc_id", "class")


@query("read_pairs_json", with_ctes(["predictions_text"], """
SELECT doc_id, prompt, chosen, rejected, true_label, sft_prediction, sft_response, is_correct FROM mined""",
    [MINED_CTE]))
def read_pairs_json_q(spark, sf_dir):
    pairs = _mined(spark, sf_dir)
    summary = PA.pairs_summary(pairs, "all")
    pairs_path, _ = io.write_pairs_json(pairs, summary, io.scratch_path(spark, "pairs"))
    return io.read_pairs_json(spark, pairs_path).drop("text")


@query("read_pairs_json_array", with_ctes(["predictions_text"], """
SELECT doc_id, prompt, chosen, rejected, true_label, sft_prediction, sft_response, is_correct FROM mined""",
    [MINED_CTE]))
def read_pairs_json_array_q(spark, sf_dir):
    path = io.write_pairs_array(_mined(spark, sf_dir), io.scratch_path(spark, "pairs-array"))
    return io.read_pairs_json(spark, path, array_file=True).drop("text")


@query("write_pairs_json", with_ctes(["predictions_text"], SUMMARY_SQL, [MINED_CTE]))
def write_pairs_json_q(spark, sf_dir):
    """Pairs and the one-row summary sidecar; the sidecar is read back."""
    pairs = _mined(spark, sf_dir)
    summary = PA.pairs_summary(pairs, "mistakes_only")
    _, summary_path = io.write_pairs_json(PA.filter_pairs(pairs, "mistakes_only"), summary,
                                          io.scratch_path(spark, "pairs"))
    back = spark.read.schema(summary.schema).json(summary_path)
    return back


@query("write_split_csv", with_ctes(["corpus_a"], f"""
SELECT doc_id, class,
       CASE WHEN row_number() OVER (PARTITION BY class ORDER BY {S.seed_key_sql(42, 'doc_id')}, doc_id)
                 <= round_even(count(*) OVER (PARTITION BY class) * CAST(0.8 AS DOUBLE), 0)
            THEN 'train' ELSE 'test' END AS split
FROM corpus_a"""))
def write_split_csv_q(spark, sf_dir):
    """Splits written partitioned by ``split`` and read back with the
    partition column recovered from the folder names."""
    parts = S.split_per_class(fx.corpus_a(spark, sf_dir), "class", "doc_id", 42, 0.8)
    path = io.write_csv(parts.select("doc_id", "class", "text", "split"), io.scratch_path(spark, "splits"), ["split"])
    return io.read_corpus_csv(spark, path).select("doc_id", "class", "split")


_DOC_MODELS_SQL = """
SELECT 'corpus_a_test' AS test_set, max(total_samples) AS test_set_size,
       list({'model_name': model, 'total_samples': total_samples, 'valid_predictions': valid_predictions,
             'unclear_responses': unclear_responses, 'correct_predictions': correct_predictions,
             'accuracy': accuracy, 'precision': precision, 'recall': recall, 'f1_score': f1,
             'true_positives': tp, 'false_positives': fp, 'true_negatives': tn, 'false_negatives': fn}
            ORDER BY list_position(['gpt4', 'base', 'sft', 'dpo'], model)) AS models
FROM met"""


def _results_doc(spark, sf_dir):
    return io.build_results_doc(M.metrics_with_unclear(_parsed(spark, sf_dir)), "corpus_a_test", MODEL_ORDER)


@query("build_results_doc", with_ctes(["predictions"], _DOC_MODELS_SQL,
                                      [PARSED_CTE, "met AS (" + metrics_sql("parsed") + ")"]))
def build_results_doc_q(spark, sf_dir):
    return _results_doc(spark, sf_dir)


@query("explode_results_doc", with_ctes(["predictions"], """
SELECT 'corpus_a_test' AS test_set, model AS model_name, total_samples, valid_predictions, unclear_responses,
       correct_predictions, accuracy, precision, recall, f1 AS f1_score, tp AS true_positives, fp AS false_positives,
       tn AS true_negatives, fn AS false_negatives FROM met""", [PARSED_CTE, "met AS (" + metrics_sql("parsed") + ")"]))
def explode_results_doc_q(spark, sf_dir):
    path = io.write_json_doc(_results_doc(spark, sf_dir), io.scratch_path(spark, "results"))
    return io.explode_results_doc(spark.read.schema(io.RESULTS_DOC).json(path))


@query("explode_latency_map", with_ctes(["latencies"], f"""
SELECT model, round(avg(ms), 6) AS mean, round(coalesce(stddev_samp(ms), 0.0), 6) AS std, min(ms) AS min, max(ms) AS max,
       round(median(ms), 6) AS median, count(*) AS n_runs,
       CAST(list_position({LATENCY_ORDER}, model) - 1 AS INTEGER) AS order_pos
FROM latencies WHERE list_contains({LATENCY_ORDER}, model) GROUP BY model"""))
def explode_latency_map_q(spark, sf_dir):
    stats = R.latency_stats(fx.latencies(spark, sf_dir))
    stats = stats.select("model", *[round_to(c, 6).alias(c) for c in ("mean", "std")], "min", "max",
                         round_to("median", 6).alias("median"), "n_runs")
    path = io.write_json_doc(io.build_latency_doc(stats), io.scratch_path(spark, "latency"))
    return io.explode_latency_map(spark.read.schema(io.LATENCY_DOC).json(path), LATENCY_ORDER)


def _inventory(spark, sf_dir):
    paths = {t: f"{sf_dir}/{t}.parquet" for t in fx.TABLES}
    return io.source_inventory(spark, paths | {"absent": f"{sf_dir}/absent.parquet"})


@query("source_inventory")
def source_inventory_q(spark, sf_dir):
    """Files of every table with sizes; no oracle, as DuckDB's views do not expose files."""
    return _inventory(spark, sf_dir)


@query("check_datasets", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, true AS present, (SELECT count(*) FROM {t}) AS rows, "
    f"CAST((SELECT count(*) FROM (DESCRIBE SELECT * FROM {t})) AS INTEGER) AS n_columns" for t in fx.TABLES)
    + " UNION ALL SELECT 'absent', false, NULL, NULL")
def check_datasets_q(spark, sf_dir):
    """Which inputs are there, with their rows and column counts; an absent one is reported."""
    return _inventory(spark, sf_dir).groupBy("table_name", "present").agg(F.sum("rows").alias("rows"), F.max("n_columns").alias("n_columns"))


@query("check_label_rates", with_ctes(["corpus_a", "corpus_b"], """
SELECT 'corpus_a' AS table_name, 'doc_id, class, text, label' AS columns, count(class) AS samples,
       count(*) FILTER (WHERE class = 'sarc') AS positives, count(*) FILTER (WHERE class = 'sarc') / count(class) AS rate FROM corpus_a
UNION ALL SELECT 'corpus_b', 'doc_id, comment, label, lang', count(label), CAST(sum(label) AS BIGINT), sum(label) / count(label) FROM corpus_b"""))
def check_label_rates_q(spark, sf_dir):
    """Column names and label rate of each corpus."""
    a = fx.corpus_a(spark, sf_dir).withColumn("label", encode_label("class"))
    return io.label_rates({"corpus_a": (a, "label"), "corpus_b": (fx.corpus_b(spark, sf_dir), "label")})
