"""Repeated-run variance and latency statistics.

All statistics are built-in aggregates (partial aggregation map-side).  The
only collected list is the per-(model, metric) list of run values, bounded
by the number of runs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuslens.operators.compare import top_k_per_group
from corpuslens.operators.quantiles import exact_percentile
from corpuslens.session import is_small, materialise, null_safe_join



def unpivot_metrics(df: DataFrame, ids: Sequence[str], metrics: Sequence[str],
                    scale: float = 1.0) -> DataFrame:
    """Wide metric columns -> (ids..., metric, value)."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), (F.col(m) * scale).cast("double").alias("value"))
                      for m in metrics])
    return df.select(*ids, F.explode(pairs).alias("_m")).select(*ids, "_m.metric", "_m.value")


def run_variance(long: DataFrame, by: Sequence[str] = ("model", "metric"), run: str = "run",
                 value: str = "value") -> DataFrame:
    """mean, population std and variance, min, max and the run-ordered values."""
    return long.groupBy(*by).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.var_pop(value).alias("variance"),
        F.min(value).alias("min"), F.max(value).alias("max"),
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(run), F.col(value)))),
                    lambda x: x[value]).alias("values"))


def latency_stats(df: DataFrame, by: Sequence[str] = ("model",), ms: str = "ms") -> DataFrame:
    """mean, sample std (0 for a single run), min, max, median, n.

    The median is exact without holding a group's values in one buffer
    (``quantiles.exact_percentile``)."""
    stats = df.groupBy(*by).agg(
        F.avg(ms).alias("mean"), F.coalesce(F.stddev_samp(ms), F.lit(0.0)).alias("std"),
        F.min(ms).alias("min"), F.max(ms).alias("max"), F.count(ms).alias("n_runs"))
    med = exact_percentile(df, by, ms, 0.5, "median")
    return null_safe_join(stats, med, list(by), "left").select(*by, "mean", "std", "min", "max", "median", "n_runs")


def latency_stats_for(models: DataFrame, timings: DataFrame, key: str = "model", ms: str = "ms") -> DataFrame:
    """Stats for every model of ``models``; a model without timings gets all
    zeros and n_runs 0."""
    stats = latency_stats(timings, [key], ms)
    out = null_safe_join(models.select(key), stats, [key], "left")
    return out.select(key, *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ("mean", "std", "min", "max", "median")],
                      F.coalesce(F.col("n_runs"), F.lit(0)).cast("long").alias("n_runs"))


def warmup_trim(df: DataFrame, by: Sequence[str], order: Sequence[str], w: int, id_col: str) -> DataFrame:
    """Drop the first ``w`` runs of every group.

    The first w rows per group come from a group limit (partial top-w before
    the shuffle), then a left-anti join removes them: no group is ranked whole.
    """
    first = top_k_per_group(df.select(*by, *order, id_col), by, [F.col(c) for c in order], w).select(id_col)
    first = materialise(first)
    # groups * w ids: broadcast when they are few bytes, so the timings are not shuffled
    side = F.broadcast(first) if is_small(first) else first
    return df.join(side, id_col, "left_anti")


def with_ratio_to(df: DataFrame, value: str, key: str, baseline: str, name: str,
                  inverse: bool = True) -> DataFrame:
    """Add baseline value / value (or value / baseline) over a small per-key table.

    The baseline is read with a window over the table (one row per key), not
    a join."""
    base = F.max(F.when(F.col(key) == baseline, F.col(value))).over(Window.partitionBy(F.lit(0)))
    ratio = base / F.col(value) if inverse else F.col(value) / base
    return df.withColumn(name, ratio)


def overhead_pct(a: Column, b: Column) -> Column:
    """(a - b) / b * 100."""
    return (a - b) / b * 100.0
