"""Corpus profiling: overview, class shares, length statistics, histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corpuslens.functions.text import col, word_count
from corpuslens.operators.quantiles import exact_percentile
from corpuslens.session import null_safe_join

QUARTILES = (0.25, 0.5, 0.75)


def corpus_overview(df: DataFrame) -> DataFrame:
    """(column_name, data_type, null_count, row_count): one aggregate pass;
    the types come from the schema."""
    aggs = [F.count(F.lit(1)).alias("_rows")] + [F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]
    wide = df.agg(*aggs)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(types[c]).alias("data_type"),
                               F.col(c).alias("null_count")) for c in df.columns])
    return wide.select(F.explode(cells).alias("c"), F.col("_rows").alias("row_count")) \
               .select("c.column_name", "c.data_type", "c.null_count", "row_count")


def text_lengths(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn("text_length", F.length(col(text))).withColumn("word_count", word_count(col(text)))


def describe(df: DataFrame, value: str, by: Sequence[str] = (), exact: bool = True) -> DataFrame:
    """count, mean, sample std, min, quartiles, max (pandas ``describe``).

    Integer columns use Spark's exact ``percentile`` (its value -> count map is
    bounded by the number of distinct values, small for lengths); fractional
    columns use the bracketed exact percentile, which never holds a group's
    values in one buffer.  ``exact=False`` switches to mergeable sketches."""
    v = F.col(value)
    frac = isinstance(df.schema[value].dataType, (T.DoubleType, T.FloatType, T.DecimalType))
    base = [F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
            F.min(v).cast("double").alias("min"), F.max(v).cast("double").alias("max")]
    names = [f"p{int(q * 100)}" for q in QUARTILES]
    if not exact:
        qs = [F.percentile_approx(v, q, 10000).cast("double").alias(n) for q, n in zip(QUARTILES, names)]
    elif not frac:
        qs = [F.percentile(v, q).alias(n) for q, n in zip(QUARTILES, names)]
    else:
        out = df.groupBy(*by).agg(*base) if by else df.agg(*base)
        for q, n in zip(QUARTILES, names):
            p = exact_percentile(df, list(by), value, q, n)
            out = null_safe_join(out, p, list(by), "left") if by else _with_scalar(out, p, n)
        return out.select(*by, "count", "mean", "std", "min", *names, "max")
    g = df.groupBy(*by).agg(*base, *qs) if by else df.agg(*base, *qs)
    return g.select(*by, "count", "mean", "std", "min", *names, "max")


def describe_columns(df: DataFrame, values: Sequence[str]) -> DataFrame:
    """``describe`` of several integer columns, one row each (``measure``), from one aggregate."""
    def stats(c: str) -> Column:
        v = F.col(c)
        return F.struct(F.lit(c).alias("measure"), F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
                        F.min(v).cast("double").alias("min"), *[F.percentile(v, q).alias(f"p{int(q * 100)}") for q in QUARTILES],
                        F.max(v).cast("double").alias("max"))

    return df.agg(F.array(*[stats(c) for c in values]).alias("rows")).select(F.inline("rows"))


def _with_scalar(one_row: DataFrame, scalar: DataFrame, name: str) -> DataFrame:
    """Attach the single value of a one-row frame as a literal column."""
    row = scalar.first()
    return one_row.withColumn(name, F.lit(row[name] if row is not None else None).cast("double"))


def histogram(df: DataFrame, value: str, bins: int, lo: float | None = None, hi: float | None = None,
              spark=None) -> DataFrame:
    """Equal-width bins between the minimum and maximum, last bin closed;
    empty bins kept.

    Integer values (lengths, counts) go through their frequency table first:
    one pass over the data, a pre-aggregated shuffle bounded by the number of
    distinct values, and min / max / binning on that small table, all in one
    job.  For fractional values the bounds come from a one-row aggregate first.
    """
    v = F.col(value)
    if lo is None and isinstance(df.schema[value].dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
        ends = df.agg(F.min(v).cast("double").alias("lo"), F.max(v).cast("double").alias("hi")).first()
        lo, hi = (0.0, 0.0) if ends["lo"] is None else (ends["lo"], ends["hi"])
    if lo is None or hi is None:
        freq = df.where(v.isNotNull()).groupBy(v.alias("v")).agg(F.count(F.lit(1)).alias("c"))
        everything = Window.partitionBy(F.lit(0))  # one row per distinct value
        lo_c, hi_c = F.min("v").over(everything).cast("double"), F.max("v").over(everything).cast("double")
        freq = freq.withColumn("lo", lo_c).withColumn("hi", hi_c)
    else:
        freq = df.where(v.isNotNull()).select(v.alias("v"), F.lit(1).alias("c"),
                                              F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi"))
    width = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / F.lit(float(bins))).otherwise(F.lit(1.0))
    idx = F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1)).cast("int")
    counts = freq.groupBy(idx.alias("bin")).agg(F.sum("c").alias("count"), F.first("lo").alias("lo"),
                                                F.first("hi").alias("hi"))
    # one row with at most `bins` counts, opened up again with the empty bins
    row = counts.agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"),
                     F.map_from_entries(F.collect_list(F.struct("bin", "count"))).alias("c")).where("lo is not null")
    out = row.select("lo", "hi", "c", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    w = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / F.lit(float(bins))).otherwise(F.lit(1.0))
    return out.select("bin", (F.col("lo") + F.col("bin") * w).alias("bin_start"),
                      (F.col("lo") + (F.col("bin") + 1) * w).alias("bin_end"),
                      F.coalesce(F.col("c")[F.col("bin")], F.lit(0)).cast("long").alias("count"))


def share_by(df: DataFrame, count: str, by: Sequence[str], name: str = "pct") -> DataFrame:
    """count / sum(count) over ``by`` * 100 on a small aggregated table."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return df.withColumn(name, F.col(count) / F.sum(count).over(w) * 100.0)


def fmt1(c: Column) -> Column:
    """One-decimal text, half-even on the exact binary value."""
    return F.regexp_replace(F.format_number(c, 1), ",", "")
