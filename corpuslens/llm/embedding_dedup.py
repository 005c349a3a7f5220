"""Embedding near-dedup: spherical k-means cells, blocked cosine products, one representative per group.

1. Equal vectors of one label are one node with a multiplicity.
2. Centroids come from spherical k-means over a bounded hash sample
   (``256 * cells`` rows, at most ``sample_rows``); there are sqrt(n) / 16 cells.
3. Every node has a home cell and is a guest of each cell that could be the home
   of a partner: a partner lies within the chord of ``threshold``, so a node
   farther than that from the plane between its own centroid and the cell's has
   none there.  No pair is lost to a cell border.
4. Inside (label, cell) home rows meet home and guest rows in blocks of at most
   about ``block`` rows a side; one task computes one product of two blocks in double
   precision, counts the links of its home rows, and returns a spanning star of
   each linked group, never the pairs.
5. Components over the stars; the smallest vec_id names and represents a group.

Defined results: rows whose vector is null, zero or holds null or non-finite
components, and rows with a null label, have no links and are their own
component (``kept`` is vec_id = component_id, null-safe).  Repeated rows are linked with each other
like any equal vectors.  A shorter vector counts as padded with zeros.  An
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._spark import connected_components, written
from ._vectors import hash_sample, kmeans, matrix, unit, usable


def _cells(centroids: np.ndarray, threshold: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node once per cell: its home and the cells it is a guest of."""
    chord = math.sqrt(2 - 2 * threshold) + 1e-9
    gap = np.sqrt(np.maximum(2 - 2 * centroids @ centroids.T, 0))
    for batch in batches:
        x = unit(matrix(batch.column(3), centroids.shape[1]))
        for i in range(0, len(x), 2000):
            s = x[i: i + 2000] @ centroids.T
            home = s.argmax(axis=1)
            near = s.max(axis=1, keepdims=True) - s <= gap[home] * chord
            row, cell = np.nonzero(near)
            rows = batch.take(pa.array(i + row))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(cell), pa.array(home[row] == cell)],
                                             [*rows.schema.names, "cell", "home"])


def product(home: np.ndarray, other: np.ndarray, home_id: np.ndarray, other_id: np.ndarray, times: np.ndarray,
            threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(links per home row, weighted by ``times`` of the others; ids and star centres of the linked rows)."""
    link = home @ other.T >= threshold
    link &= home_id[:, None] != other_id[None, :]
    count = link @ times
    i, j = np.nonzero(link.any(axis=1))[0], np.nonzero(link.any(axis=0))[0]
    link = link[np.ix_(i, j)]
    a, b = home_id[i].copy(), other_id[j].copy()
    none = np.iinfo(np.int64).max
    while len(i):
        a2 = np.minimum(a, np.where(link, b[None, :], none).min(axis=1))
        b2 = np.minimum(b, np.where(link, a2[:, None], none).min(axis=0))
        if (a2 == a).all() and (b2 == b).all():
            break
        a, b = a2, b2
    return count, np.concatenate([home_id[i], other_id[j]]), np.concatenate([a, b])


def links(nodes: DataFrame, centroids: np.ndarray, threshold: float, block: int) -> DataFrame:
    """node, n, other: parts of link counts (n) and star edges (other) of (label, node, times, v)."""
    kind = nodes.schema["v"].dataType.simpleString()
    at = written(nodes.select("label", "node", "times", "v").mapInArrow(
        partial(_cells, centroids, threshold),
        f"label {nodes.schema['label'].dataType.simpleString()}, node long, times long, v {kind}, cell long, home boolean"))
    sizes = at.groupBy("label", "cell").agg(
        F.ceil(F.count_if("home") / block).cast("int").alias("hb"), F.ceil(F.count("*") / block).cast("int").alias("mb")).where("hb > 0")
    at = at.join(sizes, ["label", "cell"])
    own = F.pmod(F.xxhash64("node"), F.col("hb")).cast("int")
    other = F.pmod(F.xxhash64("node", F.lit(1)), F.col("mb")).cast("int")
    home = at.where("home").select("label", "cell", own.alias("i"), F.explode(F.sequence(F.lit(0), F.col("mb") - 1)).alias("j"),
                                   "node", "times", "v", F.lit(True).alias("home"))
    member = at.select("label", "cell", F.explode(F.sequence(F.lit(0), F.col("hb") - 1)).alias("i"), other.alias("j"),
                       "node", "times", "v", F.lit(False).alias("home"))
    dim = centroids.shape[1]

    def compare(group: pa.Table) -> pa.Table:
        is_home = group["home"].to_numpy()
        node, times = group["node"].to_numpy(), group["times"].to_numpy()
        x = unit(matrix(group["v"], dim))
        a, b = np.flatnonzero(is_home), np.flatnonzero(~is_home)
        count, id_, centre = product(x[a], x[b], node[a], node[b], times[b], threshold)
        some = count > 0
        away = id_ != centre
        return pa.table({"node": np.concatenate([node[a][some], id_[away]]),
                         "n": np.concatenate([count[some], np.zeros(away.sum(), np.int64)]).astype(np.int64),
                         "other": pa.array(np.concatenate([np.zeros(some.sum(), np.int64), centre[away]]),
                                           mask=np.arange(some.sum() + away.sum()) < some.sum())})

    parts = home.union(member).repartition("label", "cell", "i", "j")  # not by label and cell alone, as the join left it
    return parts.groupBy("label", "cell", "i", "j").applyInArrow(compare, "node long, n long, other long")


def near_duplicates(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
                    threshold: float = 0.93, block: int = 1024, sample_rows: int = 100_000) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    rows = rows.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v"), F.col(label).alias("label"))
    takes_part = usable("v") & F.col("label").isNotNull()
    nodes = (rows.where(takes_part).groupBy("label", "v").agg(F.count("*").alias("times"), F.min("vec_id").alias("low"))
             .withColumn("node", F.monotonically_increasing_id()))
    nodes = written(nodes)  # fixes the numbers
    n, dim = nodes.agg(F.count("*"), F.max(F.size("v"))).first()
    alone = rows.where(~takes_part).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if n:
        cells = math.ceil(math.sqrt(n) / 16)
        sample = unit(hash_sample(nodes, "v", n, min(256 * cells, sample_rows), dim))
        found = written(links(nodes, kmeans(sample, cells), threshold, block))
        component = connected_components(found.where("other is not null"), "node", "other")
        counts = found.where("n > 0").groupBy("node").agg(F.sum("n").alias("n"))
        named = written(nodes.join(component, "node", "left").join(counts, "node", "left")
                        .select("label", "v", "low", "times", F.coalesce("component", "node").alias("component"),
                                (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links")))
        least = named.groupBy("component").agg(F.min("low").alias("component_id"))
        named = named.join(least, "component").select("label", "v", "n_links", "component_id")
        linked = rows.where(takes_part).join(named, ["label", "v"]).select("vec_id", "n_links", "component_id")
        alone = linked.union(alone)
    return alone.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
