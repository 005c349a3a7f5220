"""Structured Streaming forms of the two row-by-row update loops.

* ``stream_confusion``: running confusion counts per model as predictions
  arrive; complete-mode aggregate whose state is one row per model.  Each
  micro-batch writes its full result under its own batch number and readers
  take the newest, so a failed write cannot lose the state before it (the final
  state equals the batch ``confusion_counts``).
* ``stream_metric_log``: training-log rows appended as they come, whatever the
  order of their times.  Keyed state tells which steps of a run were logged
  before: the first row of a (run, step) is kept, later ones are written as
  refused, and rows without run or step are kept as they are.  Source and sink are
  exactly-once: rows in = rows kept + rows refused.

Both take a streaming DataFrame and a shared folder for checkpoints and
output; tests drive them with ``trigger(availableNow=True)``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def confusion_stream(preds: DataFrame, pred: str = "pred", label: str = "label") -> DataFrame:
    p, y = F.col(pred), F.col(label)
    return preds.groupBy("model").agg(
        F.count_if((p == 1) & (y == 1)).alias("tp"), F.count_if((p == 1) & (y == 0)).alias("fp"),
        F.count_if((p == 0) & (y == 0)).alias("tn"), F.count_if((p == 0) & (y == 1)).alias("fn"))


def start_confusion(preds: DataFrame, out_path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Complete-mode running counts; micro-batch n writes ``out_path/batch=n``."""
    counts = confusion_stream(preds)
    empty = preds.sparkSession.createDataFrame([], counts.schema)
    empty.write.mode("overwrite").parquet(f"{out_path}/batch=-1")  # what a reader sees before the first batch

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    w = counts.writeStream.outputMode("complete").foreachBatch(sink).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def read_confusion(spark: SparkSession, out_path: str) -> DataFrame:
    """The counts of the newest batch."""
    batches = spark.read.parquet(out_path)
    newest = batches.agg(F.max("batch")).first()[0]
    return batches.where(F.col("batch") == (-1 if newest is None else newest)).drop("batch")


STEP_RANGE = 1 << 16  # steps of a run that share one state
STATES = 512  # states that the runs and ranges of steps are dealt over, however many there are
WAITING = 10_000  # rows of a micro-batch that may wait before repeated steps among them are refused
ROW_FORMAT = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
              "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def _earliest(rows: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """(the earliest row of each run and step, the other rows)."""
    repeated = rows.duplicated(["run", "step"], keep=False).to_numpy()
    if not repeated.any():
        return rows, rows.iloc[:0]
    some = rows[repeated].sort_values(["run", "step", "at", "row"], kind="stable")
    again = some.duplicated(["run", "step"]).to_numpy()
    return pd.concat([rows[~repeated], some[~again]]), some[again]


def _pack(steps: pd.DataFrame) -> bytes:
    table = pa.table({"run": pa.array(steps["run"], pa.string()).dictionary_encode(), "step": pa.array(steps["step"], pa.int64())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpack(data: bytes) -> pd.DataFrame:
    table = pa.ipc.open_stream(data).read_all()
    return pd.DataFrame({"run": table["run"].cast(pa.string()).to_pandas(), "step": table["step"].to_numpy()})


def _first_of_each_step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The rows of one state's runs and steps with ``refused``: the earliest row of a step not seen before is kept.

    Of the rows of this micro-batch only the best so far of each step wait; the others go on.
    """
    if key[0] < 0:  # rows without run or step
        for frame in frames:
            yield frame[["row"]].assign(refused=False)
        return
    best, waiting, n = None, [], 0

    def settle() -> pd.DataFrame:
        nonlocal best, waiting, n
        best, others = _earliest(pd.concat(waiting if best is None else [best, *waiting], ignore_index=True))
        waiting, n = [], 0
        return others[["row"]].assign(refused=True)

    for frame in frames:
        waiting.append(frame[["run", "step", "at", "row"]])
        n += len(frame)
        if n > max(WAITING, 0 if best is None else len(best)):
            yield settle()
    if waiting:
        yield settle()
    if best is None or not len(best):
        return
    steps = best[["run", "step"]]
    if not state.exists:
        yield best[["row"]].assign(refused=False)
        state.update((_pack(steps),))
        return
    seen = _unpack(state.get[0])
    refused = (steps.merge(seen, "left", ["run", "step"], indicator=True)["_merge"] == "both").to_numpy()
    yield best[["row"]].assign(refused=refused)
    if not refused.all():
        state.update((_pack(pd.concat([seen, steps[~refused]], ignore_index=True)),))


def start_metric_log(log: DataFrame, out_path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append every row, with ``refused`` true for a (run, step) that was logged before.

    ``log`` has ``run``, an integer ``step`` and ``ts``; within a micro-batch the earliest ``ts`` (null first) counts
    as first.  Rows travel as JSON text, so nulls, NaN and large integers come out as they went in.
    """
    named = F.col("run").isNotNull() & F.col("step").isNotNull()
    row = F.to_json(F.struct(*log.columns), ROW_FORMAT)
    # one group takes many runs: a group a run and range would be as many as the rows where runs are short
    steps = F.xxhash64(F.col("run").cast("string"), F.expr(f"step div {STEP_RANGE}"))
    keyed = log.select(
        F.when(named, F.pmod(steps, F.lit(STATES))).otherwise(-1 - F.pmod(F.xxhash64(row), F.lit(64))).cast("int").alias("state"),
        F.col("run").cast("string").alias("run"), F.coalesce(F.col("step").cast("long"), F.lit(0)).alias("step"),
        F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(-1 << 63)).alias("at"), row.alias("row"))
    marked = keyed.groupBy("state").applyInPandasWithState(
        _first_of_each_step, "row string, refused boolean", "seen binary", "append", GroupStateTimeout.NoTimeout)
    rows = marked.select(F.from_json("row", log.schema, ROW_FORMAT).alias("r"), "refused").select("r.*", "refused")
    w = rows.writeStream.outputMode("append").format("parquet").partitionBy("refused") \
        .option("path", out_path).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def read_metric_log(spark: SparkSession, out_path: str) -> DataFrame:
    """The rows kept: the first of each (run, step) and all rows without run or step."""
    return spark.read.parquet(out_path).where(~F.col("refused").cast("boolean")).drop("refused")


def read_refused(spark: SparkSession, out_path: str) -> DataFrame:
    """The rows whose (run, step) was logged before."""
    return spark.read.parquet(out_path).where(F.col("refused").cast("boolean")).drop("refused")


def run_to_end(q: StreamingQuery, timeout_s: float | None = None) -> None:
    """Wait for an availableNow query to finish; raise its error if it failed.

    There is no time limit unless the caller sets one; a query that is still
    running then is stopped and ``TimeoutError`` raised, as its output is partial.
    """
    if timeout_s is None:
        q.awaitTermination()
    elif not q.awaitTermination(timeout_s):
        q.stop()
        raise TimeoutError(f"the stream was still running after {timeout_s} s; its output is partial")
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def table_stream(spark: SparkSession, path: str, schema, max_bytes: int = 1 << 30) -> DataFrame:
    """A Parquet table, one file or a folder of part files, as a stream of micro-batches of
    about ``max_bytes``.  A path that does not exist raises."""
    spark.read.schema(schema).parquet(path)  # raises where nothing is; reads nothing
    # a plain path must be a folder; a pattern that only the path matches may be either
    path = path.rstrip("/")
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", max_bytes).parquet(f"{path[:-1]}[{path[-1]}]")
