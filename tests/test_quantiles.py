"""Exact percentiles from the approx-bracket plan equal numpy's, also when the
sketch compresses (small accuracy) and one group holds most rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.operators.quantiles import exact_percentile


@pytest.mark.parametrize("p", [0.0, 0.25, 0.5, 0.75, 1.0])
@pytest.mark.parametrize("accuracy", [50, 10_000])
def test_exact_percentile_matches_numpy(spark, p, accuracy):
    rng = np.random.default_rng(7)
    hot = rng.lognormal(5, 1, 40_000)
    cold = rng.normal(100, 5, 1_001)
    rows = [("hot", float(x)) for x in hot] + [("cold", float(x)) for x in cold]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    got = {r["g"]: r["q"] for r in exact_percentile(df, ["g"], "v", p, "q", accuracy=accuracy).collect()}
    assert got["hot"] == pytest.approx(float(np.percentile(hot, p * 100)), rel=1e-12)
    assert got["cold"] == pytest.approx(float(np.percentile(cold, p * 100)), rel=1e-12)


def test_exact_percentile_without_groups(spark):
    df = spark.range(10_001).select((F.col("id") * 1.5).alias("v"))
    got = exact_percentile(df, [], "v", 0.5, "q", accuracy=100).first()["q"]
    assert got == 7500.0


@pytest.mark.parametrize("p", [0.25, 0.5, 0.75, 0.9])
def test_exact_percentile_of_small_and_tied_groups(spark, p):
    rng = np.random.default_rng(3)
    groups = {f"n{n}": rng.normal(size=n).tolist() for n in (1, 2, 3, 4, 5, 399, 400, 401)}
    groups["tied"] = [5.0] * 6000 + rng.normal(size=4000).tolist()
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    got = {r["g"]: r["q"] for r in exact_percentile(df, ["g"], "v", p, "q").collect()}
    assert got == {g: pytest.approx(float(np.percentile(vs, p * 100)), rel=1e-12) for g, vs in groups.items()}


def test_exact_percentile_of_a_null_group(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "g string, v double")
    assert {r["g"]: r["q"] for r in exact_percentile(df, ["g"], "v", 0.5, "q").collect()} == {None: 2.0, "a": 5.0}
