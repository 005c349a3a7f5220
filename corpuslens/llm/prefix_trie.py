"""Prefix trie of conversations: nodes counted exactly, singletons screened off by a count-min sketch.

A node of depth d is a distinct sequence of the first d (role, text) turns; its
members are the conversations that start with it.  ``rebuild`` gives the turns of
the registered query's conversations, ``trie`` works on any numbered turns.

* A turn is two 64-bit hashes of (role, text) and its code points; texts travel no
  further.  A prefix is a pair of polynomial sums of turn hashes, computed by range
  and offset (`_places.numbered`), so no conversation is gathered in one task.
  Prefixes are told apart by depth and both sums, 128 bits.
* Screening: every task adds its prefix digests to a count-min sketch of
  ``rows`` x ``width`` counters that stop at 2; sketches are merged block by block in
  two steps.  The width follows the number of turns up to ``max_width`` (the bound
  of what is sent to the driver and the tasks); beyond it estimates rise and more
  prefixes are shuffled, with the same result.
* An estimate of one proves that a prefix has a single member: its node is emitted
  where its row is.  The other prefixes are grouped exactly, with partial sums.
* The smallest member owns a node.  It owns all deeper nodes of its path, too, so a
  conversation's nodes are cut once: above, others own them, and the tokens there are
  what the trie saves for it.  Children, leaves and saved tokens of a shared node
  are therefore plain sums over its members: no walk of the tree.
* Ids that end at a shared node are sorted by range, joined in chunks by the tasks that
  hold them, and the chunks of a node are hashed in order as a stream.

Defined results: rows without conv_id belong to no conversation.  Null role or
text is empty.  Turns with equal turn numbers stand in the order of their hashes;
repeated rows are turns of their own.  Turn numbers need not be consecutive; a null
one comes first.  Conversations without turns are members of the root and end there.
An empty table has no conversation and no node.  Only conv_id, turn, role and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._batches import U, mix
from ._places import STEP, numbered, power
from ._spark import written

BLOCK = 1 << 14  # counters of a sketch block, at most
ROWS = 2
MAX_WIDTH = 1 << 24
CHUNK = 1 << 16  # bytes of joined ids


def turns(conversations: DataFrame) -> DataFrame:
    """c, t1, t2, cp, pos: the turns in order, as hashes and code points."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("turn"), F.xxhash64(F.lit(1), role, text).alias("t1"),
        F.xxhash64(F.lit(2), text, role).alias("t2"), F.char_length(text).cast("long").alias("cp"))
    return numbered(rows, "c", ["turn", "t1", "t2", "cp"]).select("c", "t1", "t2", "cp", "pos")


def rebuild(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, their turns): the first h turns of conversation c - c % 100, then c's own
    turns after its first h; h is crc32 of the decimal c, modulo 6."""
    own = written(turns(conversations))
    ids = written(own.select("c").distinct().select("c", F.expr("c - c % 100").alias("base"), (F.crc32(F.col("c").cast("string")) % 6).alias("h")))
    base = own.where("pos < 5 and c % 100 = 0").withColumnRenamed("c", "base")
    first = ids.where("h > 0").join(base, "base").where("pos < h")
    h = F.crc32(F.col("c").cast("string")) % 6
    rest = own.where(F.col("pos") >= h)
    cols = ("c", "t1", "t2", "cp", "pos")
    return ids.select("c"), first.select(*cols).union(rest.select(*cols))


def trie(ids: DataFrame, rows: DataFrame, max_width: int = MAX_WIDTH) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``ids`` holds every conversation once (c); ``rows`` their turns (c, t1, t2, cp, pos), pos ascending.
    """
    seen = ids.agg(F.count("*").alias("n"), F.min("c").alias("least")).first()
    if not seen["n"]:
        return ids.sparkSession.createDataFrame([], _SCHEMA)
    placed = rows.select("c", F.col("pos").alias("at"), "t1", "t2", F.col("t1").alias("p1"), F.col("t2").alias("p2"), "cp", F.col("cp").alias("upto"))
    placed = written(numbered(placed, "c", ["at", "t1", "t2"], {"p1": "poly", "p2": "poly", "upto": "sum"}))
    width = 64
    while width < min(max_width, 8 * placed.count()):
        width *= 2
    sketch = _sketch(placed, width)
    marked = written(placed.mapInArrow(partial(_screen, sketch), "c long, d long, p1 long, p2 long, q1 long, q2 long, cp long, "
                                       "before long, last boolean, proven boolean, head boolean"))
    shared = marked.where("not proven")
    nodes = written(shared.groupBy("d", "p1", "p2").agg(
        F.min("c").alias("c"), F.count("*").alias("n"), F.count_if("last").alias("n_ends"), F.first("q1").alias("q1"), F.first("q2").alias("q2"),
        F.first("cp").alias("cp"), F.first("before").alias("before")))
    return _assemble(ids, marked, shared, nodes, seen)


_SCHEMA = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
           "ends_sha256 string")


def _assemble(ids: DataFrame, marked: DataFrame, shared: DataFrame, nodes: DataFrame, seen) -> DataFrame:
    # where a conversation's own nodes begin (r), the code points before them, and whether its end is its own leaf
    heads = marked.where("head")
    cuts = (nodes.select("c", "d", "before", (F.col("n") == F.col("n_ends")).alias("leaf"))
            .union(heads.where("d > 1").select("c", "d", "before", F.lit(True)))
            .union(shared.where("last").select("c", F.col("d") + 1, F.col("before") + F.col("cp"), F.lit(False))))
    cuts = cuts.groupBy("c").agg(F.min(F.struct("d", "before")).alias("cut"), F.max("leaf").alias("leaf"))
    cuts = cuts.select("c", F.col("cut.d").alias("r"), F.col("cut.before").alias("upto"), "leaf")
    sums = shared.join(cuts, "c").groupBy("d", "p1", "p2").agg(
        F.count_if(F.expr("r <= d + 1 and not last")).alias("n_children"), F.count_if("leaf").alias("n_leaves"),
        F.sum(F.greatest(F.col("upto") - F.col("before"), F.lit(0))).alias("saved"))
    key = ["d", "p1", "p2"]
    full = written(nodes.join(sums, key).join(_ends(shared, nodes), key, "left"))
    nothing = hashlib.sha256(b"").hexdigest()
    # parents: a shared prefix's owner; a proven parent has the child's only member; depth 1 hangs on the root
    low = (full.select("c", "d", "q1", "q2", "n", "n_children", "n_leaves", "saved", F.coalesce("ends", F.lit(nothing)).alias("ends"))
           .union(heads.select("c", "d", "q1", "q2", F.lit(1), F.expr("if(last, 0, 1)"), F.lit(1), F.lit(0),
                               F.when(F.col("last"), F.sha2(F.col("c").cast("string"), 256)).otherwise(nothing))))
    above = nodes.select((F.col("d") + 1).alias("d"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("c").alias("parent"))
    deep = low.where("d > 1").join(above, ["d", "q1", "q2"], "left")
    cols = [F.col("n").alias("n_convs"), "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256")]
    out = deep.select(F.col("c").alias("conv_id"), F.col("d").alias("depth"), F.coalesce("parent", "c").alias("parent_conv_id"), *cols)
    out = out.union(low.where("d = 1").select("c", "d", F.lit(seen["least"]), *cols))
    tail = marked.where("proven and not head")
    out = out.union(tail.select("c", "d", "c", F.lit(1), F.expr("if(last, 0, 1)"), F.lit(1), F.lit(0),
                                F.when(F.col("last"), F.sha2(F.col("c").cast("string"), 256)).otherwise(nothing)))
    return out.union(_root(ids, marked, full, seen)).select(*[F.col(f.split()[0]).cast(f.split()[1]) for f in _SCHEMA.split(", ")])


def _root(ids: DataFrame, marked: DataFrame, full: DataFrame, seen) -> DataFrame:
    """The root, from sums over the nodes below it."""
    a = full.agg(F.count_if(F.expr("d = 1")).alias("children"), F.count_if(F.expr("n = n_ends")).alias("leaves"), F.sum((F.col("n") - 1) * F.col("cp")).alias("saved")).first()
    b = marked.agg(F.count_if(F.expr("proven and d = 1")).alias("children"), F.count_if(F.expr("proven and last")).alias("leaves")).first()
    children = a["children"] + b["children"]
    turnless = ids.join(marked.where("d = 1").select("c"), "c", "left_anti").select(
        F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("p1"), F.lit(0).cast("long").alias("p2"), "c")
    root = ids.sparkSession.createDataFrame(
        [(seen["least"], 0, None, seen["n"], children, a["leaves"] + b["leaves"] if children else 1, a["saved"] or 0)],
        "c long, d long, parent long, n long, n_children long, n_leaves long, saved long")
    ends = _joined(turnless).select(F.col("d"), F.col("ends"))
    return root.join(ends, "d", "left").select("c", "d", "parent", "n", "n_children", "n_leaves", "saved",
                                              F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())))


def _ends(shared: DataFrame, nodes: DataFrame) -> DataFrame:
    """d, p1, p2, ends of the shared nodes at which conversations end."""
    return _joined(shared.where("last").select("d", "p1", "p2", "c"))


def _joined(ends: DataFrame) -> DataFrame:
    key = ["d", "p1", "p2"]
    schema = "d long, p1 long, p2 long, c long, ids binary"
    chunks = ends.repartitionByRange(*key, "c").sortWithinPartitions(*key, "c").mapInArrow(_chunks, schema)
    return (chunks.repartition(*key).sortWithinPartitions(*key, "c")
            .mapInArrow(_hashes, "d long, p1 long, p2 long, ends string"))


# inside tasks -------------------------------------------------------------
def _slots(width: int, d: np.ndarray, p1: np.ndarray, p2: np.ndarray) -> list[np.ndarray]:
    """Counter of each digest in each row of the sketch."""
    x = mix(p1 ^ mix(p2 + d.astype(np.uint64) * U(STEP)))
    return [(mix(x + U((2 * k + 1) * 0xD1B54A32D192ED03 % (1 << 64))) & U(width - 1)).astype(np.int64) for k in range(ROWS)]


def _unsigned(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in names]


def _count(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sketch = np.zeros((ROWS, width), np.uint8)
    for batch in batches:
        p1, p2 = _unsigned(batch, "p1", "p2")
        d = batch.column("pos").to_numpy() + 1
        for k, at in enumerate(_slots(width, d, p1, p2)):
            at, n = np.unique(at, return_counts=True)
            sketch[k, at] = np.minimum(sketch[k, at] + n, 2)
    flat = sketch.reshape(-1, min(BLOCK, width))
    used = np.flatnonzero(flat.any(axis=1))
    for b in used:
        yield pa.RecordBatch.from_pydict({"block": pa.array([int(b)]), "counts": pa.array([flat[b].tobytes()], pa.binary())})


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the sketches of equal blocks, one after the other (rows are sorted by block)."""
    block, total = None, np.zeros(0, np.uint8)
    for batch in batches:
        for b, counts in zip(batch.column("block").to_pylist(), batch.column("counts"), strict=True):
            if b != block:
                if block is not None:
                    yield pa.RecordBatch.from_pydict({"block": pa.array([block]), "counts": pa.array([total.tobytes()], pa.binary())})
                block, total = b, np.zeros(len(counts.as_buffer()), np.uint8)
            total = np.minimum(total + np.frombuffer(counts.as_buffer(), np.uint8), 2)
    if block is not None:
        yield pa.RecordBatch.from_pydict({"block": pa.array([block]), "counts": pa.array([total.tobytes()], pa.binary())})


def _sketch(placed: DataFrame, width: int) -> np.ndarray:
    schema = "block long, counts binary"
    parts = placed.select("pos", "p1", "p2").mapInArrow(partial(_count, width), schema).withColumn("salt", F.spark_partition_id() % 32)
    once = parts.repartition("block", "salt").sortWithinPartitions("block").select("block", "counts").mapInArrow(_merge, schema)
    merged = once.repartition("block").sortWithinPartitions("block").mapInArrow(_merge, schema).toArrow()
    block = min(BLOCK, width)
    sketch = np.zeros((ROWS * width // block, block), np.uint8)
    for b, counts in zip(merged["block"].to_pylist(), merged["counts"], strict=True):
        sketch[b] = np.frombuffer(counts.as_buffer(), np.uint8)
    return sketch.reshape(ROWS, width)


def _screen(sketch: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    width = sketch.shape[1]

    def estimate(d: np.ndarray, p1: np.ndarray, p2: np.ndarray) -> np.ndarray:
        return np.minimum.reduce([sketch[k, at] for k, at in enumerate(_slots(width, d, p1, p2))])

    for batch in batches:
        p1, p2, t1, t2 = _unsigned(batch, "p1", "p2", "t1", "t2")
        pos, cp, upto = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("pos", "cp", "upto"))
        step = power(pos)
        q1, q2 = p1 - t1 * step, p2 - t2 * step  # the prefix before this turn
        proven = estimate(pos + 1, p1, p2) == 1
        head = proven & ((pos == 0) | (estimate(pos, q1, q2) != 1))
        yield pa.RecordBatch.from_pydict({
            "c": batch.column("c"), "d": pa.array(pos + 1), "p1": batch.column("p1"), "p2": batch.column("p2"), "q1": pa.array(q1.view(np.int64)),
            "q2": pa.array(q2.view(np.int64)), "cp": batch.column("cp"), "before": pa.array(upto - cp), "last": batch.column("last"),
            "proven": pa.array(proven), "head": pa.array(head)})


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of one node joined by commas, up to ``CHUNK`` bytes in a row; rows come sorted by node and id."""
    key, least, part, size = None, 0, [], 0

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({n: pa.array([v]) for n, v in zip(("d", "p1", "p2", "c"), (*key, least), strict=True)}
                                          | {"ids": pa.array([",".join(part).encode()], pa.binary())})

    for batch in batches:
        for d, p1, p2, c in zip(*[batch.column(n).to_pylist() for n in ("d", "p1", "p2", "c")], strict=True):
            if part and ((d, p1, p2) != key or size > CHUNK):
                yield row()
                part, size = [], 0
            if not part:
                key, least = (d, p1, p2), c
            part.append(str(c))
            size += len(part[-1]) + 1
    if part:
        yield row()


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over a node's chunks in order, as a stream."""
    key, state, out = None, None, []

    def batch_of(rows: list) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_pydict({n: pa.array(list(v)) for n, v in zip(("d", "p1", "p2", "ends"), cols, strict=True)})

    for batch in batches:
        for d, p1, p2, ids in zip(*[batch.column(n).to_pylist() for n in ("d", "p1", "p2", "ids")], strict=True):
            if (d, p1, p2) == key:
                state.update(b",")
            else:
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = (d, p1, p2), hashlib.sha256()
            state.update(ids)
        if len(out) > 1000:
            yield batch_of(out)
            out = []
    if key is not None:
        out.append((*key, state.hexdigest()))
    if out:
        yield batch_of(out)
