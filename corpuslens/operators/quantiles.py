"""Exact percentiles with bounded memory per task.

Spark's exact ``percentile`` keeps a value -> count map per group; for
continuous values (latencies) a hot group would put all its distinct values
in one buffer.  Here the exact linear-interpolated percentile (the
``percentile`` / numpy definition: position p * (n - 1)) is found in two
passes:

1. per group: row count and a bracket ``[lo, hi]`` from ``percentile_approx``
   at p -/+ a margin larger than the sketch's rank error (mergeable sketches,
   partial aggregation);
2. per group: the exact count of rows below ``lo`` (an aggregate), and running
   counts over the distinct values inside the bracket (about 2 * margin * n, fewer with ties).

The bracket table has one row per group and is broadcast after its size is
checked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuslens.session import is_small, materialise, null_safe_join

ACCURACY = 100_000
MARGIN = 4.0 / ACCURACY


def exact_percentile(df: DataFrame, by: Sequence[str], value: str, p: float, name: str = "pct",
                     accuracy: int = ACCURACY) -> DataFrame:
    """(by..., name): the exact p-th percentile of ``value`` per group."""
    margin = 4.0 / accuracy
    by = list(by)
    whole = not by
    if whole:  # one group: a constant key keeps every join keyed
        df, by = df.withColumn("_g", F.lit(0)), ["_g"]
    base = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    lo_p, hi_p = max(0.0, p - margin), min(1.0, p + margin)
    brackets = base.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"),
        F.percentile_approx("_v", F.array(F.lit(lo_p), F.lit(hi_p)), accuracy).alias("_b"))
    pos = F.lit(p) * (F.col("_n") - 1)
    brackets = brackets.select(*by, "_n", F.col("_b")[0].alias("_lo"), F.col("_b")[1].alias("_hi"),
                               F.floor(pos).cast("long").alias("_r0"), F.ceil(pos).cast("long").alias("_r1"),
                               (pos - F.floor(pos)).alias("_frac"))
    if whole:  # one group: the bracket is a few scalars, bound as literals
        row = brackets.first()
        if row is None:
            return df.sparkSession.createDataFrame([], f"`{name}` double")
        joined = base
        for c in ("_n", "_lo", "_hi", "_r0", "_r1", "_frac"):
            joined = joined.withColumn(c, F.lit(row[c]))
    else:
        brackets = materialise(brackets)
        joined = null_safe_join(base, brackets, by, hint=is_small(brackets))
    # percentile_approx counts ranks to n, the definition here to n - 1: the value next to the bracket may be wanted
    v = F.col("_v")
    below = joined.groupBy(*by).agg(F.count_if(v < F.col("_lo")).alias("_below"), F.max(F.when(v < F.col("_lo"), v)).alias("_prev"),
                                    F.min(F.when(v > F.col("_hi"), v)).alias("_next"))
    inside = joined.where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
    # equal values count once, with how many they are: ties at the bracket stay one row
    values = inside.groupBy(*by, "_v", "_r0", "_r1", "_frac").agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*by).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    values = null_safe_join(values.withColumn("_upto", upto), below, by)
    last = F.col("_below") + F.col("_upto") - 1  # ranks of the value: first .. last
    first = last - F.col("_c") + 1
    has = lambda r: (F.col(r) >= first) & (F.col(r) <= last)
    picked = values.groupBy(*by).agg(F.max(F.when(has("_r0"), F.col("_v"))).alias("_v0"),
                                     F.max(F.when(has("_r1"), F.col("_v"))).alias("_v1"),
                                     *[F.first(c).alias(c) for c in ("_frac", "_r0", "_r1", "_below", "_prev", "_next")])
    near = lambda v, r: F.coalesce(F.col(v), F.when(F.col(r) < F.col("_below"), F.col("_prev")).otherwise(F.col("_next")))
    picked = picked.withColumn("_v0", near("_v0", "_r0")).withColumn("_v1", near("_v1", "_r1"))
    out = picked.select(*by, (F.col("_v0") + F.col("_frac") * (F.col("_v1") - F.col("_v0"))).alias(name))
    return out.drop("_g") if whole else out
