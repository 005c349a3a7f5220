"""Pairing model outputs by key: side-by-side outcomes, disagreement cells,
domain gaps and efficiency tables.

What is paired by list position elsewhere is keyed here: ``pair_models`` folds the
long predictions table into one row per item with a grouped aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pair_models(preds: DataFrame, a: str, b: str, key: str = "doc_id", value: str = "pred",
                extra: list[str] | None = None, model_col: str = "model") -> DataFrame:
    """One row per key that both models have, with ``a``'s and ``b``'s values and correct flags.

    One conditional aggregate over the two models' rows, partly combined before
    the shuffle, instead of a self-join."""
    cols = [value, *(extra or [])]
    of = lambda m: F.max(F.when(F.col(model_col) == m, F.struct("label", *cols)))  # noqa: E731  one row per (key, model)
    both = preds.where(F.col(model_col).isin(a, b)).groupBy(key).agg(of(a).alias("_a"), of(b).alias("_b"))
    out = both.where(F.col("_a").isNotNull() & F.col("_b").isNotNull()).select(
        key, F.col("_a.label").alias("label"), *[F.col(f"_a.{c}").alias(f"{a}_{c}") for c in cols],
        *[F.col(f"_b.{c}").alias(f"{b}_{c}") for c in cols])
    return out.withColumn(f"{a}_correct", F.col(f"{a}_{value}") == F.col("label")) \
              .withColumn(f"{b}_correct", F.col(f"{b}_{value}") == F.col("label"))


def mean_where(value: Column, cond: Column) -> Column:
    """Mean of ``value`` over rows where ``cond`` holds (null if none)."""
    return F.avg(F.when(cond, value))


def domain_gap(metrics: DataFrame, key: str = "model", domain: str = "domain", metric: str = "f1") -> DataFrame:
    """metric in the domain ``in`` minus metric in the domain ``out``, for every model that has both."""
    of = lambda d: F.max(F.when(F.col(domain) == d, F.col(metric)))  # noqa: E731  one row per (model, domain)
    g = metrics.groupBy(key).agg(of("in").alias(f"{metric}_in_domain"), of("out").alias(f"{metric}_out_of_domain"))
    gap = F.col(f"{metric}_in_domain") - F.col(f"{metric}_out_of_domain")
    return g.withColumn("gap", gap).where(F.col("gap").isNotNull())
