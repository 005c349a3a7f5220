"""Nearest neighbours by learned partitions of a neighbour graph.

1. Sample: at most ``sample_rows`` distinct vectors by hash.  Its ``neighbours``-nearest-
   neighbour graph (inner product) is cut into balanced parts: k-means cells
   with a capacity start it, then vertices move to the part that holds most of
   their neighbours, as far as capacities allow.  There are sqrt(n) / 4 parts.
2. Classifier: one hidden layer, trained to predict the share of a vector's
   neighbours in each part (cross-entropy, Adam).
3. Index: every row goes to its most probable part.
4. Probes: for ``trial_queries`` distinct vectors by hash the exact neighbours among all
   rows are found in blocks, and the number of parts to search is the smallest
   whose recall on them reaches ``recall``.  A vector counts once however many copies it
   has: copies find one another in one part and say nothing of the other queries.
5. Search: each query goes to that many most probable parts and meets their rows in
   blocks of bounded size; the best of each block are re-scored one by one in
   double precision and merged.

Model, sample and trial queries are bounded by parameters; the rows of the
index and the queries never leave the executors.

Defined results: vectors that are null, zero or hold null or non-finite
components are neither queries nor candidates.  A shorter vector counts as
padded with zeros.  A query never finds a row with its own id; repeated rows are
separate candidates, repeated queries separate queries (each with its ranks).  Ties go to the smaller
id, null ids last.  Empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ._spark import written
from ._vectors import hash_sample, kmeans, matrix, unit, usable


def knn_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k rows with the largest inner product of each row, itself left out."""
    k = min(k, len(x) - 1)
    out = np.zeros((len(x), k), np.int64)
    for i in range(0, len(x), 1000):
        s = x[i: i + 1000] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        out[i: i + 1000] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, passes: int = 8, slack: float = 1.1) -> np.ndarray:
    """A part for each vertex: few edges cut, no part above ``slack`` times the mean size."""
    n = len(x)
    most = math.ceil(n / parts * slack)
    score = unit(x) @ kmeans(unit(x), parts).T
    parts = score.shape[1]
    part, size = np.full(n, -1), np.zeros(parts, np.int64)
    for v in np.argsort(-score.max(axis=1)):
        for p in np.argsort(-score[v]):
            if size[p] < most:
                part[v] = p
                size[p] += 1
                break
    back = [[] for _ in range(n)]
    for v in range(n):
        for u in graph[v]:
            back[u].append(v)
    rng = np.random.default_rng(5)
    for _ in range(passes):
        moved = 0
        for v in rng.permutation(n):
            votes = np.bincount(part[np.concatenate([graph[v], back[v]]).astype(np.int64)], minlength=parts)
            votes = np.where(size < most, votes, -1)
            votes[part[v]] = max(votes[part[v]], np.count_nonzero(part[graph[v]] == part[v]))
            p = int(votes.argmax())
            if votes[p] > votes[part[v]]:
                size[part[v]] -= 1
                size[p] += 1
                part[v] = p
                moved += 1
        if moved < n // 200:
            break
    return part


class Classifier:
    """Probabilities of the parts: a hidden layer of ``width`` rectified units."""

    def __init__(self, x: np.ndarray, target: np.ndarray, width: int = 128, epochs: int = 25, rate: float = 3e-3):
        rng = np.random.default_rng(11)
        self.scale = 1 / max(np.sqrt((x * x).mean()), 1e-300)
        d, k = x.shape[1], target.shape[1]
        self.w = [rng.normal(0, np.sqrt(2 / d), (d, width)), np.zeros(width), rng.normal(0, np.sqrt(1 / width), (width, k)), np.zeros(k)]
        m, v, step = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), 256):
                rows = order[i: i + 256]
                a, t = x[rows] * self.scale, target[rows]
                h = np.maximum(a @ self.w[0] + self.w[1], 0)
                g = (self._softmax(h @ self.w[2] + self.w[3]) - t) / len(rows)
                gh = (g @ self.w[2].T) * (h > 0)
                step += 1
                for j, grad in enumerate((a.T @ gh, gh.sum(axis=0), h.T @ g, g.sum(axis=0))):
                    m[j] = 0.9 * m[j] + 0.1 * grad
                    v[j] = 0.999 * v[j] + 0.001 * grad * grad
                    self.w[j] = self.w[j] - rate * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.999**step)) + 1e-8)

    @staticmethod
    def _softmax(s: np.ndarray) -> np.ndarray:
        e = np.exp(s - s.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return self._softmax(np.maximum(x * self.scale @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3])

    def ranked(self, x: np.ndarray) -> np.ndarray:
        """Parts of each row, most probable first."""
        return np.argsort(-self.probabilities(x), axis=1, kind="stable")


def train(sample: np.ndarray, parts: int, neighbours: int) -> Classifier:
    graph = knn_graph(sample, neighbours)
    part = balanced_parts(sample, graph, parts)
    parts = int(part.max()) + 1
    target = np.zeros((len(sample), parts))
    np.add.at(target, (np.repeat(np.arange(len(sample)), graph.shape[1] + 1), part[np.column_stack([np.arange(len(sample)), graph])].ravel()), 1.0)
    return Classifier(sample, target / target.sum(axis=1, keepdims=True))


def _route(model: Classifier, dim: int, probes: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row once for each of its ``probes`` most probable parts."""
    for batch in batches:
        best = model.ranked(matrix(batch.column(2), dim))[:, :probes]
        rows = batch.take(pa.array(np.repeat(np.arange(batch.num_rows), best.shape[1])))
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(best.ravel().astype(np.int64))], [*rows.schema.names, "part"])


def best_rows(queries: np.ndarray, own: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int):
    """(query row, row, score) of each query's k best rows with another id, ties included before the cut.

    The product finds them; scores are summed afresh, in one order, so equal vectors have equal scores.
    """
    s = queries @ rows.T
    s[own[:, None] == ids[None, :]] = -np.inf
    if s.shape[1] > k:
        floor = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        q, r = np.nonzero((s >= (floor - 1e-9 * np.maximum(1, np.abs(floor)))[:, None]) & (s > -np.inf))
    else:
        q, r = np.nonzero(s > -np.inf)
    score = np.concatenate([(queries[q[i: i + 50_000]] * rows[r[i: i + 50_000]]).sum(axis=1)
                            for i in range(0, len(q), 50_000)] or [np.zeros(0)])
    order = np.lexsort((ids[r], -score, q))
    q, r, score = q[order], r[order], score[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    keep = place < k
    return q[keep], r[keep], score[keep]


NO_ID = np.iinfo(np.int64).max  # stands for a null id inside tasks


def _ids(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return column.fill_null(NO_ID).to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.combine_chunks().fill_null(NO_ID).to_numpy(zero_copy_only=False)


def _trial(queries: np.ndarray, own: np.ndarray, dim: int, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The k best rows of this task for each trial query."""
    q, ids, parts, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    for batch in batches:
        x, i, p = matrix(batch.column(2), dim), _ids(batch.column(1)), batch.column(3).to_numpy()
        for at in range(0, len(x), 20_000):
            a, r, s = best_rows(queries, own, x[at: at + 20_000], i[at: at + 20_000], k)
            q, ids, parts, score = (np.concatenate(z) for z in ((q, a), (ids, i[at + r]), (parts, p[at + r]), (score, s)))
            order = np.lexsort((ids, -score, q))
            q, ids, parts, score = q[order], ids[order], parts[order], score[order]
            keep = np.arange(len(q)) - np.searchsorted(q, q) < k
            q, ids, parts, score = q[keep], ids[keep], parts[keep], score[keep]
    yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(ids), pa.array(parts), pa.array(score)], ["q", "vec_id", "part", "score"])


def _probes(index: DataFrame, model: Classifier, dim: int, different: int, k: int, trial_queries: int, recall: float) -> int:
    few = (index.where(F.expr(f"pmod(xxhash64(v, 1), 1000000) < {1e6 * min(1.0, 4.0 * trial_queries / different)}"))
           .groupBy("v").agg(F.min("vec_id").alias("vec_id"))
           .orderBy(F.xxhash64("v", F.lit(1)), "v").limit(trial_queries).select("vec_id", "v").toArrow())
    x, own = matrix(few["v"], dim), _ids(few["vec_id"])
    near = index.select("row", "vec_id", "v", "part").mapInArrow(partial(_trial, x, own, dim, k), "q long, vec_id long, part long, score double")
    w = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    near = near.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("q", "part").toArrow()  # trial_queries * k rows
    if not near.num_rows:
        return 1
    place = np.argsort(model.ranked(x), axis=1)  # of each part, in each query's order
    needed = np.sort(place[near["q"].to_numpy(), near["part"].to_numpy()])
    return int(needed[min(len(needed) - 1, math.ceil(recall * len(needed)) - 1)]) + 1


SAMPLE_PER_PART = 64  # sample rows behind a part, at least: 256 parts with the default sample, however many rows


def search(base: DataFrame, queries: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = 20,
           sample_rows: int = 16_384, neighbours: int = 10, trial_queries: int = 256, recall: float = 0.96,
           row_block: int = 4096, query_block: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each query."""
    empty = base.select(F.col(vec_id).alias("query_id"), F.lit(1).alias("rank"), F.col(vec_id).alias("vec_id"), F.lit(0.0).alias("score")).where("1 = 0")
    pick = [F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v")]
    base, queries = (t.select(F.col(vec_id), F.col(vector)).where(usable(vector)).select(*pick) for t in (base, queries))
    n, dim, different = base.agg(F.count("*"), F.max(F.size("v")), F.approx_count_distinct(F.xxhash64("v"))).first()
    asked, dim2 = queries.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n or not asked:
        return empty
    dim = max(dim, dim2)
    parts = min(math.ceil(math.sqrt(n) / 4), max(sample_rows // SAMPLE_PER_PART, 1))  # each part is learned from enough rows
    sample = hash_sample(base, "v", different, min(max(256 * parts, 2048), sample_rows), dim, distinct=True)
    kind = base.schema["v"].dataType.simpleString()
    schema = f"row long, vec_id long, v {kind}, part long"
    if len(sample) < 3:
        sample = np.concatenate([sample] * 3)
    model = train(sample, min(parts, len(sample)), neighbours)
    index = written(base.mapInArrow(partial(_route, model, dim, 1), schema))
    probes = _probes(index, model, dim, different, k, trial_queries, recall)
    routed = written(queries.mapInArrow(partial(_route, model, dim, probes), schema))
    sizes = (index.groupBy("part").agg(F.ceil(F.count("*") / row_block).cast("int").alias("rb"))
             .join(routed.groupBy("part").agg(F.ceil(F.count("*") / query_block).cast("int").alias("qb")), "part"))
    cut = lambda c, name, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.col(c)).cast("int").alias(name)
    every = lambda c, name: F.explode(F.sequence(F.lit(0), F.col(c) - 1)).alias(name)
    asks = routed.join(sizes, "part").select("part", cut("qb", "i", 0), every("rb", "j"), "row", "vec_id", "v", F.lit(True).alias("query"))
    rows = index.join(sizes, "part").select("part", every("qb", "i"), cut("rb", "j", 1), "row", "vec_id", "v", F.lit(False).alias("query"))

    def compare(group: pa.Table) -> pa.Table:
        is_query = group["query"].to_numpy()
        x, ids, number = matrix(group["v"], dim), _ids(group["vec_id"]), group["row"].to_numpy()
        a, b = np.flatnonzero(is_query), np.flatnonzero(~is_query)
        q, r, score = best_rows(x[a], ids[a], x[b], ids[b], k)
        found, asked = ids[b][r], ids[a][q]
        return pa.table({"query_row": number[a][q], "query_id": pa.array(asked, mask=asked == NO_ID),
                         "vec_id": pa.array(found, mask=found == NO_ID), "score": score})

    both = asks.union(rows).repartition("part", "i", "j")  # not by part alone, as the joins left it
    found = both.groupBy("part", "i", "j").applyInArrow(compare, "query_row long, query_id long, vec_id long, score double")
    w = Window.partitionBy("query_row").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
