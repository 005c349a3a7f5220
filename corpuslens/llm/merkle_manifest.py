"""Merkle manifest of a dataset: leaf, root and inclusion proof of every document, by a butterfly exchange.

``H`` is the lowercase hex SHA-256 of its concatenated inputs, digests as hex text.
A leaf hashes doc_id, source, lang, n_chars and text (``-`` if null, else UTF-8
byte count, ``:``, value).  Per source, leaves ascend by doc_id and every three
consecutive nodes become one until one is left; the sources' nodes, ordered by
source (null first, bytewise), likewise give the root.

* Places of leaves come from `_places.numbered`: no source is gathered.
* An aligned run of 3**``levels`` leaves of one source is a partition; one task
  hashes it to the root of its subtree.
* Butterfly: in round r the three aligned groups of 3**r partitions swap their
  subtree roots.  Every partition holds its own group's root, asks one partition
  of each other group for theirs and hashes the three into the parent, as its
  neighbours do (redundantly).  After ceil(log3(partitions)) rounds each has all
  upper siblings and the root; nothing is handed down.  Askers of a short last
  group are dealt over its partitions.  A round is two shuffles of rows that
  stand for 3**``levels`` leaves each, and is written to the shared folder.
* The tree over the sources is built by the same steps, with subroots as leaves.
* A last pass meets each partition's leaves with its upper siblings and hashes
  proofs and the recomputed roots of (possibly altered) leaves.

Defined results: rows with one doc_id in a source are leaves of their own,
ordered by their hash, and a null doc_id stands first.  Equal rows give equal
leaves, each with its own proof.  A null or empty text is a value like any
other.  An empty table gives no row.  Only the five columns are read; others
are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ._places import numbered
from ._spark import written

FANOUT = 3
LEVELS = 6  # of a partition: 729 leaves
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEPS = "array<struct<at: int, sib: array<string>>>"  # level by level: own place in the run, the run's others


def leaf_hash(**changed: Column) -> Column:
    """The leaf of a row; ``changed`` gives other values for some fields."""
    parts = []
    for name in FIELDS:
        v = changed.get(name, F.col(name)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def manifest(docs: DataFrame, altered: Column | None = None, altered_text: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every document.

    ``folded_root`` is recomputed from the leaf with ``altered_text`` where ``altered`` is
    true (never, by default) and the original siblings; ``verified`` compares it with the root.
    """
    leaf, folded = leaf_hash(), F.lit(None).cast("string")
    if altered is not None:
        folded = F.when(altered, leaf_hash(text=altered_text))
    rows = docs.select(F.col("source").alias("g"), F.col("doc_id").alias("id"), leaf.alias("leaf"), folded.alias("folded"))
    rows = written(numbered(rows, "g", ["id", "leaf", "folded"]).withColumn("b", F.expr(f"pos div {FANOUT ** levels}")))
    parts = _butterfly(_subtrees(rows, levels))
    return written(_proofs(rows, _with_sources(parts, levels), levels))


def _with_sources(parts: DataFrame, levels: int) -> DataFrame:
    """Partitions with subroot, root and the steps from their node up to the root."""
    tops = parts.where("b = 0").select(F.lit("").alias("g"), F.col("g").alias("id"), F.col("node").alias("leaf"))
    tops = written(numbered(tops, "g", ["id"]).withColumn("b", F.expr(f"pos div {FANOUT ** levels}")))
    upper = _butterfly(_subtrees(tops, levels))
    header = upper.select("g", "b", F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("string").alias("id"),
                          F.lit(None).cast("string").alias("leaf"), "steps", F.col("node").alias("root"))
    body = tops.select("g", "b", "pos", "id", "leaf", F.lit(None).cast(STEPS).alias("steps"), F.lit(None).cast("string").alias("root"))
    paths = written(header.union(body).repartition("g", "b").sortWithinPartitions("g", "b", "pos")
                    .mapInArrow(partial(_source_steps, levels), f"source string, up {STEPS}, root string"))
    on = F.col("g").eqNullSafe(F.col("source"))
    return parts.join(paths, on, "left").select("g", "b", F.concat("steps", "up").alias("steps"), F.col("node").alias("subroot"), "root")


def _subtrees(rows: DataFrame, levels: int) -> DataFrame:
    """g, b, node: the root of each partition's subtree."""
    dealt = rows.select("g", "b", "pos", "leaf").repartition("g", "b").sortWithinPartitions("g", "b", "pos")
    return dealt.mapInArrow(partial(_subtree_roots, levels), "g string, b long, node string")


def _butterfly(parts: DataFrame) -> DataFrame:
    """g, b, node, steps: after the exchange every partition holds its source's node and the steps up to it."""
    parts = written(parts)
    sizes = parts.groupBy("g").agg((F.max("b") + 1).alias("m"))
    most = sizes.agg(F.max("m")).first()[0] or 0
    on = F.col("g").eqNullSafe(F.col("h"))
    state = written(parts.join(sizes.withColumnRenamed("g", "h"), on).select("g", "b", "node", "m", F.array().cast(STEPS).alias("steps")))
    width = 1
    while width < most:
        state, width = written(_round(state, width)), width * FANOUT
    return state.select("g", "b", "node", "steps")


def _round(state: DataFrame, width: int) -> DataFrame:
    """One swap among the aligned groups of ``width`` partitions below each parent."""
    own = F.expr(f"cast(b div {width} % {FANOUT} as int)").alias("j")
    others = F.explode(F.array(*[F.lit(j) for j in range(FANOUT)])).alias("j")
    start = F.expr(f"(b div {width * FANOUT} * {FANOUT} + j) * {width}")
    asked = state.where(F.col("m") > width).select("g", "b", "m", own.alias("own"), others).where("j <> own").withColumn("start", start)
    asked = asked.where("start < m").select(
        F.col("g").alias("h"), F.col("b").alias("asker"), "j", F.expr(f"start + b % {width} % least({width}, m - start)").alias("target"))
    on = F.col("g").eqNullSafe(F.col("h")) & (F.col("b") == F.col("target"))
    nothing = F.lit(None)
    told = asked.join(state, on).select("g", F.col("asker").alias("b"), F.struct("j", "node").alias("n"), nothing.cast("int").alias("j"),
                                        nothing.cast("long").alias("m"), nothing.cast(STEPS).alias("steps"))
    kept = state.select("g", "b", F.struct(own, "node").alias("n"), own, "m", "steps")
    met = told.union(kept).groupBy("g", "b").agg(F.array_sort(F.collect_list("n")).alias("run"), F.max("j").alias("j"),
                                                 F.max("m").alias("m"), F.first("steps", ignorenulls=True).alias("steps"))
    step = F.struct(F.expr("cast(size(filter(run, n -> n.j < j)) as int)").alias("at"),
                    F.expr("transform(filter(run, n -> n.j <> j), n -> n.node)").alias("sib"))
    up = F.col("m") > width
    return met.select("g", "b", F.when(up, F.sha2(F.array_join("run.node", ""), 256)).otherwise(F.expr("run[0].node")).alias("node"),
                      "m", F.when(up, F.concat("steps", F.array(step))).otherwise(F.col("steps")).alias("steps"))


def _proofs(rows: DataFrame, parts: DataFrame, levels: int) -> DataFrame:
    none = F.lit(None).cast("string")
    header = parts.select("g", "b", F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("long").alias("id"), none.alias("leaf"),
                          none.alias("folded"), "steps", "subroot", "root")
    body = rows.select("g", "b", "pos", "id", "leaf", "folded", F.lit(None).cast(STEPS).alias("steps"), none.alias("subroot"), none.alias("root"))
    dealt = header.union(body).repartition("g", "b").sortWithinPartitions("g", "b", "pos")
    return dealt.mapInArrow(partial(_document_proofs, levels), "doc_id long, leaf string, subroot string, root string, "
                            "proof_sha256 string, folded_root string, verified boolean")


# inside tasks -------------------------------------------------------------
def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """(b, rows) of each partition of the tree; at most one header and 3**levels leaves."""
    key, rows = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if rows and (r["g"], r["b"]) != key:
                yield key[1], rows
                rows = []
            key = (r["g"], r["b"])
            rows.append(r)
    if rows:
        yield key[1], rows


def _climb(leaves: list[str], alone: bool, levels: int) -> list[list[str]]:
    """Nodes of a partition level by level; a partition that is its whole tree (``alone``) ends at one node."""
    up = [leaves]
    while len(up) <= levels and not (alone and len(up[-1]) == 1):
        low = up[-1]
        up.append([digest("".join(low[i: i + FANOUT])) for i in range(0, len(low), FANOUT)])
    return up


def _alone(b: int, n: int, levels: int) -> bool:
    return b == 0 and n < FANOUT ** levels  # a full first partition climbs all levels either way


def _subtree_roots(levels: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = []
    for b, rows in _grouped(batches):
        up = _climb([r["leaf"] for r in rows], _alone(b, len(rows), levels), levels)
        out.append({"g": rows[0]["g"], "b": b, "node": up[-1][0]})
        if len(out) == 1000:
            yield pa.RecordBatch.from_pylist(out)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, pa.schema([("g", pa.string()), ("b", pa.int64()), ("node", pa.string())]))


def _steps(up: list[list[str]], i: int) -> list[tuple[int, list[str]]]:
    """From leaf ``i`` to the partition's node: own place in each run and the run's others."""
    out = []
    for nodes in up[:-1]:
        at = i % FANOUT
        run = nodes[i - at: i - at + FANOUT]
        out.append((at, run[:at] + run[at + 1:]))
        i //= FANOUT
    return out


def _source_steps(levels: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("source", pa.string()), ("up", pa.list_(pa.struct([("at", pa.int32()), ("sib", pa.list_(pa.string()))]))), ("root", pa.string())])
    for b, (head, *rows) in _grouped(batches):
        up = _climb([r["leaf"] for r in rows], _alone(b, len(rows), levels), levels)
        out = [{"source": r["id"], "up": [{"at": at, "sib": sib} for at, sib in _steps(up, i)] + head["steps"], "root": head["root"]}
               for i, r in enumerate(rows)]
        yield pa.RecordBatch.from_pylist(out, schema)


def _document_proofs(levels: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    text = [(c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")]
    schema = pa.schema([("doc_id", pa.int64()), *text, ("verified", pa.bool_())])
    for b, (head, *rows) in _grouped(batches):
        up = _climb([r["leaf"] for r in rows], _alone(b, len(rows), levels), levels)
        above = [(s["at"], s["sib"]) for s in head["steps"]]
        upper = "".join("".join(sib) for _, sib in above)
        out = []
        for i, r in enumerate(rows):
            steps = _steps(up, i)
            node = r["folded"] or r["leaf"]
            for at, sib in [*steps, *above]:
                node = digest("".join([*sib[:at], node, *sib[at:]]))
            out.append({"doc_id": r["id"], "leaf": r["leaf"], "subroot": head["subroot"], "root": head["root"],
                        "proof_sha256": digest("".join("".join(sib) for _, sib in steps) + upper),
                        "folded_root": node, "verified": node == head["root"]})
        yield pa.RecordBatch.from_pylist(out, schema)
