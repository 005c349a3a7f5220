"""Golden values: the saved counts and statistics of the experiments."""

import pytest
from pyspark.sql import functions as F

from corpuslens.operators import metrics as M
from corpuslens.operators import runs as R
from corpuslens.operators import trainlog as T


def _rows(spark, tp, fp, tn, fn):
    data = [(1, 1)] * tp + [(1, 0)] * fp + [(0, 0)] * tn + [(0, 1)] * fn
    return spark.createDataFrame(data, "pred int, label int").withColumn("model", F.lit("m"))


@pytest.mark.parametrize("counts,expected", [
    ((420, 182, 318, 80), (0.738, 0.6977, 0.84, 0.7623)),
    ((236, 226, 274, 264), (0.51, 0.5108225108, 0.472, 0.4906444906)),
    ((376, 78, 422, 124), (0.798, 0.828194, 0.752, None)),
])
def test_binary_metrics_from_counts(spark, counts, expected):
    r = M.binary_metrics(_rows(spark, *counts)).first()
    for name, want in zip(("accuracy", "precision", "recall", "f1"), expected):
        if want is not None:
            assert r[name] == pytest.approx(want, abs=5e-5), name


def test_zero_denominators_give_zero(spark):
    r = M.binary_metrics(_rows(spark, 0, 0, 5, 0)).first()
    assert (r["precision"], r["recall"], r["f1"]) == (0.0, 0.0, 0.0)


def test_unclear_left_out(spark):
    df = _rows(spark, 3, 1, 2, 0).unionByName(
        spark.createDataFrame([(-1, 1), (-1, 0)], "pred int, label int").withColumn("model", F.lit("m")))
    r = M.metrics_with_unclear(df).first()
    assert (r["total_samples"], r["valid_predictions"], r["unclear_responses"]) == (8, 6, 2)
    assert r["accuracy"] == pytest.approx(5 / 6)


def test_macro_f1_is_mean_of_class_f1(spark):
    df = _rows(spark, 30, 10, 40, 20)
    rep = {r["row_name"]: r for r in M.classification_report(df).collect()}
    assert rep["macro avg"]["f1"] == pytest.approx((rep["0"]["f1"] + rep["1"]["f1"]) / 2)
    assert rep["accuracy"]["f1"] == pytest.approx(0.7)


def test_speedup_golden(spark):
    lat = spark.createDataFrame([("gpt4", 631.4413), ("dpo", 165.0475)], "model string, mean double")
    out = {r["model"]: r["speedup"] for r in R.with_ratio_to(lat, "mean", "model", "gpt4", "speedup").collect()}
    assert round(out["dpo"], 1) == 3.8


def test_latency_stats_single_run_and_empty(spark):
    one = spark.createDataFrame([("a", 5.0)], "model string, ms double")
    r = R.latency_stats(one).first()
    assert (r["std"], r["n_runs"]) == (0.0, 1)
    models = spark.createDataFrame([("a",), ("b",)], "model string")
    rows = {x["model"]: x for x in R.latency_stats_for(models, one).collect()}
    assert (rows["b"]["mean"], rows["b"]["n_runs"]) == (0.0, 0)


def test_rolling_drift_single_value_is_zero(spark):
    df = spark.createDataFrame([(1, 1, 0.7)], "run int, step int, chosen_mean double")
    assert T.rolling_drift(df).first()["drift"] == 0.0


def test_histogram_counts_add_up_and_last_bin_closed(spark):
    from corpuslens.operators.profile import histogram

    df = spark.range(1, 1001).select((F.col("id") % 97).cast("int").alias("v"))
    h = histogram(df, "v", 20).collect()
    assert len(h) == 20 and sum(r["count"] for r in h) == 1000
    assert h[-1]["count"] > 0 and h[-1]["bin_end"] == 96.0


def test_confusion_cells_add_up_to_valid(spark):
    rows = [(p, y) for p in (-1, 0, 1) for y in (0, 1) for _ in range(p + 3 + y)]
    df = spark.createDataFrame(rows, "pred int, label int").withColumn("model", F.lit("m"))
    r = M.metrics_with_unclear(df).first()
    assert r["tp"] + r["fp"] + r["tn"] + r["fn"] == r["valid_predictions"]


def test_describe_fractional_matches_pandas(spark):
    import numpy as np
    import pandas as pd

    from corpuslens.operators.profile import describe

    rng = np.random.default_rng(1)
    vals = rng.gamma(2.0, 10.0, 3001)
    df = spark.createDataFrame([(float(x),) for x in vals], "v double")
    got = describe(df, "v").first()
    want = pd.Series(vals).describe()
    for ours, theirs in (("count", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"),
                         ("p25", "25%"), ("p50", "50%"), ("p75", "75%"), ("max", "max")):
        assert got[ours] == pytest.approx(want[theirs], rel=1e-9), ours


def test_sweep_best_is_null_when_empty_and_ties_go_first(spark):
    sweep = spark.createDataFrame([(0.1, 0.5), (0.05, 0.5), (0.2, 0.4)], "beta double, eval_f1 double")
    best = sweep.agg(F.max_by("beta", F.struct(F.col("eval_f1"), -F.col("beta"))).alias("b")).first()["b"]
    assert best == 0.05
    empty = sweep.where("false").agg(F.max_by("beta", F.struct(F.col("eval_f1"), -F.col("beta"))).alias("b"))
    assert empty.first()["b"] is None


def test_rolling_drift_equals_window_form_with_a_hot_run(spark):
    from pyspark.sql import Window

    df = spark.range(20_000).select(
        F.when(F.col("id") % 10 < 9, 1).otherwise(F.col("id") % 7 + 2).alias("run"),
        (F.col("id") * 3 + 1).alias("step"), ((F.col("id") * 37) % 101 / 7.0).alias("chosen_mean"))
    got = {(r["run"], r["step"]): r["drift"] for r in T.rolling_drift(df).collect()}
    w = Window.partitionBy("run").orderBy("step").rowsBetween(-9, 0)
    want = {(r["run"], r["step"]): r["d"] for r in df.select("run", "step", F.stddev_pop("chosen_mean").over(w)
                                                              .alias("d")).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_running_best_equals_window_form_with_a_hot_run(spark):
    from pyspark.sql import Window

    df = spark.range(20_000).select(
        F.when(F.col("id") % 10 < 9, 1).otherwise(F.col("id") % 7 + 2).alias("run"),
        (F.col("id") * 2 + 5).alias("epoch"), ((F.col("id") * 7919) % 10007 / 10007.0).alias("eval_f1"))
    got = {(r["run"], r["epoch"]): (r["best_before"], r["is_new_best"]) for r in T.running_best(df).collect()}
    w = Window.partitionBy("run").orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    ref = df.withColumn("b", F.coalesce(F.max("eval_f1").over(w), F.lit(0.0)))
    want = {(r["run"], r["epoch"]): (r["b"], r["eval_f1"] > r["b"]) for r in ref.collect()}
    assert got == want


def test_position_in_group_exact_with_bunched_steps(spark):
    from pyspark.sql import Window

    # 90 % of the hot run's steps sit in a narrow range: uneven buckets, still exact positions
    df = spark.range(30_000).select(
        F.when(F.col("id") % 10 < 9, 1).otherwise(2).alias("run"),
        F.when(F.col("id") % 10 < 8, F.col("id") % 1000).otherwise(F.col("id") * 1000).alias("step"),
        F.col("id").alias("tb"))
    got = {r["tb"]: r["_pos"] for r in T.position_in_group(df, ["run"], "step", "tb").collect()}
    w = Window.partitionBy("run").orderBy("step", "tb")
    want = {r["tb"]: r["p"] for r in df.select("tb", F.row_number().over(w).alias("p")).collect()}
    assert got == want
