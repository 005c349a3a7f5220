"""Streaming jobs over several micro-batches: running confusion state equals
the batch result; duplicate (run, step) log rows are dropped."""

import datetime as dt
import random
import uuid

import pandas as pd
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from corpuslens.functions import parsing as P
from corpuslens.operators.metrics import confusion_counts
from corpuslens.plans import fixtures as fx
from corpuslens.session import checkpoint_dir
from corpuslens.streaming import jobs as ST


def _folder(spark, name):
    return f"{checkpoint_dir(spark)}/test-{name}-{uuid.uuid4().hex[:8]}"


def test_confusion_state_over_three_batches_equals_batch(spark):
    src = _folder(spark, "labels")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    for k in range(3):  # three files -> three micro-batches
        labels.where(F.col("doc_id") % 3 == k).coalesce(1).write.parquet(f"{src}/part{k}")
    stream = spark.readStream.schema(labels.schema).option("maxFilesPerTrigger", 1) \
        .option("recursiveFileLookup", "true").parquet(src)
    preds = fx.predictions_from(stream).withColumn("pred", P.parse_contains_unclear("reply"))
    base = _folder(spark, "conf")
    q = ST.start_confusion(preds, f"{base}/out", f"{base}/ckpt")
    ST.run_to_end(q)
    assert len(q.recentProgress) >= 3
    got = {r["model"]: tuple(r[1:]) for r in ST.read_confusion(spark, f"{base}/out").select("model", "tp", "fp", "tn", "fn").collect()}
    batch = confusion_counts(fx.predictions_from(labels).withColumn("pred", P.parse_contains_unclear("reply")))
    want = {r["model"]: tuple(r[1:]) for r in batch.select("model", "tp", "fp", "tn", "fn").collect()}
    assert got == want


LOG = "run long, step long, loss double, learning_rate double, epoch double, ts timestamp"


def _logged(spark, batches, schema=LOG):
    src, base = _folder(spark, "log"), _folder(spark, "logout")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{src}/b{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(src)
    ST.run_to_end(ST.start_metric_log(stream, f"{base}/out", f"{base}/ckpt"))
    kept, refused = ST.read_metric_log(spark, f"{base}/out"), ST.read_refused(spark, f"{base}/out")
    assert kept.columns == refused.columns == stream.columns
    return kept.collect(), refused.collect()


def test_metric_log_keeps_late_rows_and_refuses_repeated_steps(spark):
    t0 = dt.datetime(2024, 1, 1)
    day = lambda k, steps: [(1, s, 0.5 + s, 1e-5, 1.0, t0 + dt.timedelta(days=k, minutes=s)) for s in steps]
    kept, refused = _logged(spark, [day(10, range(20, 30)), day(1, range(10)), day(2, range(10, 20)), day(1, range(5))])
    assert sorted(r.step for r in kept) == list(range(30))
    assert sorted(r.step for r in refused) == list(range(5))


def test_metric_log_accounts_for_every_row(spark):
    t = lambda k: dt.datetime(2024, 1, 1, 0, 0, 0, k)  # noqa: E731  microseconds apart
    big = (1 << 62) + 1
    batches = [[(7, big, float("nan"), None, 1.0, t(3)), (7, big, 2.0, None, 1.0, t(2)), (None, 5, 1.0, 0.1, 1.0, t(1)), (None, 5, 1.0, 0.1, 1.0, t(1))],
               [(7, big, 9.0, None, 1.0, t(1)), (7, None, None, None, None, None), (7, -3, 1.0, 0.1, 1.0, None), (7, -3, 2.0, 0.1, 1.0, t(0))],
               [(8, big, 1 / 3, 5e-324, 1.0, t(1)), (7, big + 1, 1.0, 1.0, 1.0, t(1)), (7, -3 + (1 << 16), 1.0, 1.0, 1.0, t(1))]]
    kept, refused = _logged(spark, batches)
    rows = [r for b in batches for r in b]
    assert sorted(map(str, map(tuple, kept + refused))) == sorted(map(str, rows))
    assert sorted(str(tuple(r)) for r in refused) == sorted(map(str, [batches[0][0], batches[1][0], batches[1][3]]))


def test_metric_log_with_one_hot_step(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, 1 if i % 3 else i, float(i), 0.1, 1.0, t0 + dt.timedelta(seconds=i)) for i in range(30_000)]
    kept, refused = _logged(spark, [rows])
    assert len(kept) + len(refused) == len(rows) and len(kept) == 10_001
    assert [r.loss for r in kept if r.step == 1] == [1.0]


def test_metric_log_keeps_few_states_of_many_runs(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i % 4000, i * 100_000, float(i), 0.1, 1.0, t0) for i in range(8000)]
    src, base = _folder(spark, "runs"), _folder(spark, "runsout")
    for i in range(2):  # the second batch logs 2,000 steps again
        spark.createDataFrame(rows[i * 3000: i * 3000 + 5000], LOG).coalesce(1).write.parquet(f"{src}/b{i}")
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(src)
    q = ST.start_metric_log(stream, f"{base}/out", f"{base}/ckpt")
    ST.run_to_end(q)
    assert sum(s["numRowsTotal"] for s in q.lastProgress["stateOperators"]) <= 600
    assert sorted(r.loss for r in ST.read_metric_log(spark, f"{base}/out").collect()) == [float(i) for i in range(8000)]
    assert sorted(r.loss for r in ST.read_refused(spark, f"{base}/out").collect()) == [float(i) for i in range(3000, 5000)]


class _State:
    def __init__(self):
        self.get, self.exists = None, False

    def update(self, value):
        self.get, self.exists = value, True


def test_first_of_each_step_against_plain_code(monkeypatch):
    monkeypatch.setattr(ST, "WAITING", 20)
    rng, state, seen = random.Random(5), _State(), set()
    for _ in range(4):
        rows = [(rng.choice(["1", "2", "ü"]), rng.choice([-1 << 62, 7, (1 << 62) + rng.randrange(30)]), rng.randrange(5), f"r{i}-{rng.random()}")
                for i in range(200)]
        frames = [pd.DataFrame(rows[i: i + 13], columns=["run", "step", "at", "row"]) for i in range(0, 200, 13)]
        got = pd.concat(list(ST._first_of_each_step((3,), iter(frames), state)))
        want = set()
        for run, step, _, row in sorted(rows, key=lambda r: r[2:]):
            if (run, step) not in seen:
                seen.add((run, step))
                want.add(row)
        assert set(got["row"][~got["refused"].astype(bool)]) == want
        assert sorted(got["row"]) == sorted(r[3] for r in rows)


@pytest.mark.parametrize("folder", [False, True])
def test_table_stream_reads_a_file_or_a_folder(spark, folder):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    path = "/root/testdata/sf0.001/labels.parquet"
    if folder:
        path = _folder(spark, "parts") + "/labels.parquet"
        labels.repartition(4).write.parquet(path)
    base = _folder(spark, "copy")
    q = ST.table_stream(spark, path, labels.schema).writeStream.format("parquet").option("path", f"{base}/out") \
        .option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start()
    ST.run_to_end(q)
    assert spark.read.parquet(f"{base}/out").count() == labels.count()


def test_table_stream_without_input_raises(spark):
    with pytest.raises(AnalysisException):
        ST.table_stream(spark, _folder(spark, "absent"), "a long").isStreaming  # noqa: B018


def test_a_stream_past_its_limit_raises(spark):
    rate = spark.readStream.format("rate").load()
    base = _folder(spark, "slow")
    q = rate.writeStream.format("noop").option("checkpointLocation", f"{base}/ckpt").start()
    with pytest.raises(TimeoutError):
        ST.run_to_end(q, timeout_s=1)
    assert not q.isActive
