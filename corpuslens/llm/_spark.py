"""Helpers for the operators: intermediate tables, table paths, components of a link graph."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpuslens.session import checkpoint_dir

ARROW_ROWS = 500  # rows of an Arrow batch: texts can be 100 kB and more


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of texts bounded, unless the session already asks for smaller ones."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of up to ``rows`` narrow rows for the jobs run meanwhile."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    had = spark.conf.get(key, None)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.unset(key) if had is None else spark.conf.set(key, had)


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back: a cut of the
    lineage that survives lost executors and is not kept in their memory."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int, limit: int = 500_000) -> DataFrame:
    """Broadcast a narrow table whose counted rows are within ``limit``; else leave the join to the planner."""
    return F.broadcast(df) if rows <= limit else df


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of the undirected ``edges``; the component is its smallest node.

    Alternates the large-star and the small-star step: every node sends its
    smallest neighbour to its larger neighbours, then to its smaller ones.
    Both are grouped minima with map-side combine and one join; a hot node is
    never gathered.  Every round is written to the shared checkpoint folder.
    Ends when every node is a centre or has one edge, to a centre.
    """
    e = written(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull())
                .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    while not _stars(e):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(low, "u")
        e = written(pairs.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                    .union(low.select("u", F.col("m").alias("v")))
                    .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    return (e.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))


def _stars(e: DataFrame) -> bool:
    """True when no node of the edges u -> v has two edges or is both an end and a centre."""
    ends = e.select(F.col("u").alias("node"), F.col("v"), F.lit(False).alias("centre"))
    centres = e.select(F.col("v").alias("node"), F.lit(None).cast(e.schema["v"].dataType).alias("v"), F.lit(True).alias("centre"))
    n = ends.union(centres).groupBy("node").agg(F.min("v").alias("least"), F.max("v").alias("most"), F.max("centre").alias("centre"))
    return n.agg(F.count_if(F.expr("least <> most or (centre and least is not null)"))).first()[0] == 0


def spread(*cols: str | Column, buckets: int) -> Column:
    """A bucket number from a hash of ``cols``."""
    return F.pmod(F.xxhash64(*cols), F.lit(buckets)).cast("int")
