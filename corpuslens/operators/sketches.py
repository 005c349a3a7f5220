"""Length statistics that grow file by file: mergeable quantile sketches in a store.

A store holds one row per file and measure: count, mean, squared deviations, minimum,
maximum and a KLL sketch.  A new split of a corpus costs a scan of its own files; the
description of the whole is a merge of small rows.  With ``k`` = 400 the rank of a quartile
is off by at most 0.8 % of the rows with 99 % confidence; everything else is exact.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.operators.profile import QUARTILES

SKETCH_K = 400
SCHEMA = "file string, bytes long, changed timestamp, measure string, n long, mean double, m2 double, min long, max long, sketch binary"


def file_sketches(rows: DataFrame, values: Sequence[str], k: int = SKETCH_K) -> DataFrame:
    """One row per file and measure from rows with ``file``, ``bytes``, ``changed`` and the integer columns ``values``."""
    def stats(c: str):
        v = F.col(c).cast("long")
        return F.struct(F.lit(c).alias("measure"), F.count(v).alias("n"), F.avg(v).alias("mean"),
                        (F.var_pop(v) * F.count(v)).alias("m2"), F.min(v).alias("min"), F.max(v).alias("max"),
                        F.kll_sketch_agg_bigint(v, k).alias("sketch"))

    return rows.groupBy("file", "bytes", "changed").agg(F.array(*[stats(c) for c in values]).alias("s")) \
               .select("file", "bytes", "changed", F.inline("s"))


def update_store(spark: SparkSession, store: str, source: str, measure: Callable[[DataFrame], DataFrame], values: Sequence[str]) -> DataFrame:
    """The store after the Parquet files of ``source`` are in it; files that it holds unchanged are not read again.

    ``measure`` adds the integer columns ``values``.  A file that was replaced counts as a new
    one, and its old row is left out.
    """
    meta = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"),
            F.col("_metadata.file_modification_time").alias("changed")]
    try:
        held = spark.read.schema(SCHEMA).parquet(store)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        spark.createDataFrame([], SCHEMA).write.parquet(store)
        held = spark.read.schema(SCHEMA).parquet(store)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(source)  # the content is not read
    listed = listed.select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.col("modificationTime").alias("changed"))
    key = ["file", "bytes", "changed"]
    new = [r["file"] for r in listed.join(held.select(*key).distinct(), key, "left_anti").select("file").collect()]
    if new:
        rows = measure(spark.read.option("recursiveFileLookup", "true").parquet(*new).select("*", *meta))
        file_sketches(rows, values).write.mode("append").parquet(store)
    return spark.read.schema(SCHEMA).parquet(store).join(listed, key, "left_semi")


def describe_sketches(store: DataFrame, k: int = SKETCH_K) -> DataFrame:
    """measure, count, mean, std, min, quartiles, max of all files together."""
    n, mean = F.sum("n"), F.sum(F.col("n") * F.col("mean")) / F.sum("n")
    m2 = F.sum(F.col("m2") + F.col("n") * F.col("mean") * F.col("mean")) - n * mean * mean
    g = store.where("n > 0").groupBy("measure").agg(
        n.alias("count"), mean.alias("mean"), F.when(n > 1, F.sqrt(F.greatest(m2, F.lit(0.0)) / (n - 1))).alias("std"),
        F.min("min").cast("double").alias("min"), F.max("max").cast("double").alias("max"), F.kll_merge_agg_bigint("sketch", k).alias("_s"))
    quartiles = [F.kll_sketch_get_quantile_bigint("_s", F.lit(q)).cast("double").alias(f"p{int(q * 100)}") for q in QUARTILES]
    return g.select("measure", "count", "mean", "std", "min", *quartiles, "max")
