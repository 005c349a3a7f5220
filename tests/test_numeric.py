"""round_to agrees with SQL rounding digit for digit."""

import duckdb
import numpy as np
import pytest

from corpuslens.functions.numeric import round_to


@pytest.mark.parametrize("digits", [1, 2, 6, 9])
def test_round_to_matches_duckdb(spark, digits):
    rng = np.random.default_rng(digits)
    vals = list(rng.normal(0, 100, 3000)) + list(rng.integers(0, 10**7, 500) / 10**7 * 3.0) \
        + [k / 2 / 10**digits for k in range(-50, 50)] + [6.0585e9, 1e300, 0.0]
    vals = [float(v) for v in vals]
    con = duckdb.connect()
    want = [r[0] for r in con.execute(
        f"SELECT round(v, {digits}) FROM (SELECT unnest(?::DOUBLE[]) AS v, generate_subscripts(?::DOUBLE[], 1) AS i) ORDER BY i",
        [vals, vals]).fetchall()]
    df = spark.createDataFrame(list(enumerate(vals)), "i int, v double")
    got = [r[0] for r in df.orderBy("i").select(round_to("v", digits)).collect()]
    assert [(v, a, b) for v, a, b in zip(vals, got, want) if a != b] == []
