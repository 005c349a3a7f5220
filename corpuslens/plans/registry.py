"""Registry of named queries: a Spark builder and, when SQL can say it, the
DuckDB oracle text for the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def count_if_as_filter(sql: str) -> str:
    """``count_if(x)`` -> ``count(*) FILTER (WHERE x)``: the same count, typed
    BIGINT in DuckDB (count_if gives HUGEINT) like Spark's bigint."""
    out, i, key = [], 0, "count_if("
    while True:
        j = sql.find(key, i)
        if j < 0 or (j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_")):
            if j < 0:
                out.append(sql[i:])
                return "".join(out)
            out.append(sql[i:j + len(key)])
            i = j + len(key)
            continue
        depth, k = 1, j + len(key)
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        inner = count_if_as_filter(sql[j + len(key):k - 1])
        out.append(sql[i:j] + f"count(*) FILTER (WHERE {inner})")
        i = k


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = count_if_as_filter(sql)
        return fn

    return deco
