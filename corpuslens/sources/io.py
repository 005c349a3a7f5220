"""Schemas, readers and writers for corpora, pairs and result documents.

Every reader takes an explicit schema (no inference).  Writers go to folders
under the shared checkpoint directory named by the cluster
(``spark.checkpoint.dir``), one fresh folder per call.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslens.session import checkpoint_dir
from corpuslens.sources.records import read_csv_records, read_json_array

# ---------------------------------------------------------------------------
# schemas: column and field names of the files read (fixed values)
# ---------------------------------------------------------------------------
CORPUS_A = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("class", T.StringType()),
                         T.StructField("text", T.StringType())])
CORPUS_B = T.StructType([T.StructField("comment", T.StringType()), T.StructField("label", T.IntegerType())])
CORPUS_C_FLAGS = ["sarcastic", "irony", "satire", "overstatement", "understatement", "rhetorical_question"]
CORPUS_C = T.StructType([T.StructField("_c0", T.LongType()), T.StructField("tweet", T.StringType())]
                        + [T.StructField(f, T.IntegerType()) for f in CORPUS_C_FLAGS])
PAIRS = T.StructType([T.StructField(n, t) for n, t in [
    ("doc_id", T.LongType()), ("prompt", T.StringType()), ("chosen", T.StringType()), ("rejected", T.StringType()),
    ("true_label", T.IntegerType()), ("sft_prediction", T.IntegerType()), ("sft_response", T.StringType()),
    ("is_correct", T.BooleanType()), ("text", T.StringType())]])
METRIC_ROW = T.StructType([T.StructField(n, t) for n, t in [
    ("model_name", T.StringType()), ("total_samples", T.LongType()), ("valid_predictions", T.LongType()),
    ("unclear_responses", T.LongType()), ("correct_predictions", T.LongType()), ("accuracy", T.DoubleType()),
    ("precision", T.DoubleType()), ("recall", T.DoubleType()), ("f1_score", T.DoubleType()),
    ("true_positives", T.LongType()), ("false_positives", T.LongType()), ("true_negatives", T.LongType()),
    ("false_negatives", T.LongType())]])
RESULTS_DOC = T.StructType([T.StructField("test_set", T.StringType()), T.StructField("test_set_size", T.LongType()),
                            T.StructField("models", T.ArrayType(METRIC_ROW))])
LATENCY_STATS = T.StructType([T.StructField(n, T.DoubleType()) for n in ("mean", "std", "min", "max", "median")]
                             + [T.StructField("n_runs", T.LongType())])
LATENCY_DOC = T.StructType([T.StructField("results", T.MapType(T.StringType(), LATENCY_STATS))])

# CSV dialect of the corpora: quoted multi-line text, quotes doubled.
CSV_WRITE_OPTIONS = {"header": "true", "escape": '"', "quote": '"',
                     "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint directory."""
    return f"{checkpoint_dir(spark).rstrip('/')}/corpuslens-{name}-{uuid.uuid4().hex[:12]}"


# ---------------------------------------------------------------------------
# CSV
# ---------------------------------------------------------------------------
def write_csv(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    w = df.write.mode("overwrite").options(**CSV_WRITE_OPTIONS)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)
    return path


def read_corpus_csv(spark: SparkSession, path: str, schema: T.StructType = CORPUS_A) -> DataFrame:
    """Labelled CSV with quoted multi-line text; a file of any size is read by many tasks."""
    return read_csv_records(spark, path, schema)


def read_indexed_csv(spark: SparkSession, path: str, schema: T.StructType = CORPUS_C,
                     index_name: str = "row_id") -> DataFrame:
    """CSV whose first, unnamed column is a row index (``_c0``)."""
    return read_corpus_csv(spark, path, schema).withColumnRenamed("_c0", index_name)


def scan_head(spark: SparkSession, path: str, schema: T.StructType, n: int) -> DataFrame:
    """The first n rows in the order of the files' names and of the lines in each.

    Files are opened one after the other until there are n rows, and a file is read no
    further than that: one task, as much of one file as the rows take where it has enough.
    """
    rows: list = []
    for file in sorted(spark.read.text(path).inputFiles()):  # lists names, reads nothing
        rows += spark.read.schema(schema).options(header="true", multiLine="true", escape='"', quote='"').csv(file).limit(n - len(rows)).collect()
        if len(rows) == n:
            break
    return spark.createDataFrame(rows, schema)


# ---------------------------------------------------------------------------
# JSON
# ---------------------------------------------------------------------------
def write_pairs_json(pairs: DataFrame, summary: DataFrame, path: str) -> tuple[str, str]:
    """Pairs as JSON lines (splittable) plus a one-row ``_summary`` sidecar."""
    pairs.write.mode("overwrite").json(f"{path}/pairs")
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/pairs_summary")
    return f"{path}/pairs", f"{path}/pairs_summary"


def _array_documents(most_bytes: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """JSON objects, one a row, as JSON arrays of up to ``most_bytes`` (or of one larger object)."""
    rows, size = [], 0
    for batch in batches:
        for row in batch.column(0).to_pylist():
            n = len(row.encode()) + 1
            if rows and size + n > most_bytes:
                yield pa.RecordBatch.from_arrays([pa.array(["[" + ",".join(rows) + "]"])], ["value"])
                rows, size = [], 0
            rows.append(row)
            size += n
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(["[" + ",".join(rows) + "]"])], ["value"])


def write_pairs_array(pairs: DataFrame, path: str, most_bytes: int = 8 << 20) -> str:
    """Pairs as JSON array documents of up to ``most_bytes``, each of which is one text value and
    one file; their number grows with the table, their size does not.  Nothing is shuffled."""
    rows = pairs.select(F.to_json(F.struct(*pairs.columns), {"ignoreNullFields": "false"}).alias("value"))
    rows.mapInArrow(partial(_array_documents, most_bytes), "value string") \
        .write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)  # a file holds one document
    return path


def read_pairs_json(spark: SparkSession, path: str, schema: T.StructType = PAIRS, array_file: bool = False) -> DataFrame:
    """Pairs from JSON lines, or from JSON array documents (``array_file``), of which one is read by many tasks, too."""
    return read_json_array(spark, path, schema) if array_file else spark.read.schema(schema).json(path)


# ---------------------------------------------------------------------------
# result documents
# ---------------------------------------------------------------------------
def build_results_doc(metrics: DataFrame, test_set: str, order: list[str]) -> DataFrame:
    """Metric rows (one per model, a handful) folded into one nested row:
    ``test_set, test_set_size, models: [ {...}, ... ]`` in ``order``."""
    pos = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("model"))
    row = F.struct(*[F.col(c).alias(n) for c, n in [
        ("model", "model_name"), ("total_samples", "total_samples"), ("valid_predictions", "valid_predictions"),
        ("unclear_responses", "unclear_responses"), ("correct_predictions", "correct_predictions"),
        ("accuracy", "accuracy"), ("precision", "precision"), ("recall", "recall"), ("f1", "f1_score"),
        ("tp", "true_positives"), ("fp", "false_positives"), ("tn", "true_negatives"), ("fn", "false_negatives")]])
    g = metrics.agg(F.max("total_samples").alias("test_set_size"),
                    F.array_sort(F.collect_list(F.struct(pos.alias("pos"), row.alias("m")))).alias("ms"))
    return g.select(F.lit(test_set).alias("test_set"), "test_set_size",
                    F.transform("ms", lambda x: x["m"]).alias("models"))


def write_json_doc(doc: DataFrame, path: str) -> str:
    doc.coalesce(1).write.mode("overwrite").json(path)
    return path


def explode_results_doc(doc: DataFrame) -> DataFrame:
    """One row per model of a results document."""
    return doc.select("test_set", F.explode("models").alias("m")).select("test_set", "m.*")


def build_latency_doc(stats: DataFrame) -> DataFrame:
    """model -> stats map (one entry per model)."""
    entry = F.struct(F.col("model"), F.struct("mean", "std", "min", "max", "median", "n_runs"))
    return stats.agg(F.map_from_entries(F.collect_list(entry)).alias("results"))


def explode_latency_map(doc: DataFrame, order: list[str]) -> DataFrame:
    """Entries of the model -> stats map whose key is in ``order``, with their
    position in it."""
    pos = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("model"))
    rows = doc.select(F.explode("results").alias("model", "s")).select("model", "s.*")
    return rows.withColumn("order_pos", (pos - 1).cast("int")).where(F.col("order_pos") >= 0)


# ---------------------------------------------------------------------------
# inventory
# ---------------------------------------------------------------------------
def source_inventory(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Per input file: path, size in MB, rows and column count of its table, from the
    file metadata column (one scan of a single narrow column per table).  An absent
    input is one row with ``present`` false and no counts."""
    schema = "table_name string, present boolean, file_path string, size_mb double, rows long, n_columns int"
    out = spark.createDataFrame([], schema)
    for name, path in paths.items():
        try:
            df = spark.read.parquet(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            out = out.unionByName(spark.createDataFrame([(name, False, None, None, None, None)], schema))
            continue
        files = df.select("_metadata.file_path", "_metadata.file_size").groupBy("file_path").agg(
            F.max("file_size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
        out = out.unionByName(files.select(
            F.lit(name).alias("table_name"), F.lit(True).alias("present"), "file_path",
            F.round(F.col("bytes") / (1024 * 1024), 6).alias("size_mb"), "rows", F.lit(len(df.columns)).alias("n_columns")))
    return out


def label_rates(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """table_name, columns (names in order), samples, positives and positive rate (0 without samples) of each table's 0/1 label."""
    parts = [df.agg(F.count(label).alias("samples"), F.coalesce(F.sum(F.col(label).cast("long")), F.lit(0)).alias("positives"))
             .select(F.lit(name).alias("table_name"), F.lit(", ".join(df.columns)).alias("columns"), "samples", "positives",
                     F.when(F.col("samples") > 0, F.col("positives") / F.col("samples")).otherwise(F.lit(0.0)).alias("rate"))
             for name, (df, label) in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
