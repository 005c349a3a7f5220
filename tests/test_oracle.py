"""Every registered query against its DuckDB oracle (or, without one, that it runs)."""

import pytest

from paths import SF_SMALL
from tools.oracle_check import compare

from __spark_entry__ import entry, oracle_sql, queries

NAMES = sorted(queries())


@pytest.fixture(scope="module")
def con(duck):
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    res = compare(spark, con, name, queries()[name], oracle_sql().get(name), SF_SMALL)
    assert res["status"] in ("ok", "rows-only"), res


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry_runs_with_stable_schema(spark):
    df = entry(spark)
    assert [f.name for f in df.schema.fields][:3] == ["model", "total_samples", "valid_predictions"]
    assert df.count() == 4


FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")


@pytest.mark.parametrize("name", NAMES)
def test_plan_has_no_cross_join_or_row_udf(spark, name):
    """No query pairs every row with every row, and none runs a row-at-a-time
    Python UDF (the scorer's mapInPandas is batched)."""
    df = queries()[name](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [p for p in FORBIDDEN if p in plan], plan[:2000]


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_column_types_match_oracle(spark, con, name):
    """Spark column types equal the DuckDB oracle's (bigint counts, double ratios, ...)."""
    import re

    from tools.type_check import spark_to_duck

    sdf = queries()[name](spark, SF_SMALL)
    rel = con.sql(oracle_sql()[name])
    spark_t = {f.name: re.sub(r"\s", "", spark_to_duck(f.dataType.simpleString())).lower() for f in sdf.schema.fields}
    duck_t = {c: re.sub(r"[\s\"]", "", str(t)).lower() for c, t in zip(rel.columns, rel.types)}
    assert spark_t == duck_t
