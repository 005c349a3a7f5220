"""MinHash near-dedup by an inverted join on signature coordinates.

Texts are lower-cased (A-Z), cut into words at space and 09-0D, and become the
set of their distinct ``shingle``-word shingles (64-bit hashes; fewer words:
the whole sequence is the one shingle).  Two documents are linked when
100 * |A and B| >= percent * |A or B|; links are confirmed on the full sets.

1. Equal sets are one node from here on (copies are never paired).  Sets are told apart
   by a 64-bit hash: among 10^9 different sets the chance that any two share one is 3 %.
2. Each node has a signature of ``coordinates`` minima and is posted under each
   (coordinate, value) pair.  A pair of nodes that agree on ``matches``
   coordinates must meet in a list that is among the ``coordinates - matches
   + 1`` rarest of either (prefix filter over a global order by list length), so
   the ``matches - 1`` longest lists of each node are skipped, and so are nodes
   whose values are shared on fewer coordinates, and lists of one.
3. Inside a list every node meets the most central one (a star, not all pairs);
   collisions are counted on the whole signatures and pairs with ``matches``
   or more are merged into clusters.  After ``rounds`` of that, the pairs of nodes
   in one list that are still in different clusters and may be similar by size are
   all counted, so no candidate is lost to the stars.
4. Sets of clustered nodes are compared exactly in blocks of ``block`` nodes:
   each block with itself and with the cluster's first block, then every node
   outside the cluster's largest component with all blocks.  A task returns a
   spanning star per group of linked nodes, never the pairs.
5. Components over the links name the smallest doc_id.

At similarity 0.8 exactly, a pair misses step 2 with probability 1e-5 (48
coordinates, 26 matches); it then has to be reachable by no other link to
matter.

Defined results: null texts and texts without words have an empty set, no link
and themselves as component; ``kept`` is doc_id = component_id (null-safe).  Rows that share a
doc_id are judged by their own texts.  An empty table gives an empty result.  Only doc_id and
text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._batches import U, lower_ascii, mix, shingles, text_blocks, word_hashes, word_spans
from ._spark import connected_components, small, small_batches, written

COORDINATES, MATCHES, BLOCK, ROUNDS = 48, 26, 256, 1


def row_sets(texts: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, data, offs in text_blocks(texts):
        data = lower_ascii(data)
        start, end, counts = word_spans(data, offs)
        h, n = shingles(word_hashes(data, start, end), counts, shingle)
        ends = np.cumsum(n)
        for r in range(len(n)):
            yield np.unique(h[ends[r] - n[r]: ends[r]])


def _keys(sets: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of each set; empty sets give that of no element."""
    n = np.array([len(s) for s in sets], np.int64)
    a = np.zeros(len(sets), np.uint64)
    if n.sum():
        x = np.concatenate(sets)
        at = (np.cumsum(n) - n)[n > 0]
        a[n > 0] = np.add.reduceat(mix(x ^ U(0x5851F42D4C957F2D)), at)
    return mix(a + n.astype(np.uint64)).view(np.int64)


def _features(shingle: int, coordinates: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns behind doc_id and text are passed on."""
    rng = np.random.default_rng(7)
    mult = rng.integers(1, 1 << 63, coordinates, dtype=np.uint64) | U(1)
    plus = rng.integers(1, 1 << 63, coordinates, dtype=np.uint64)
    for batch in batches:
        sets = list(row_sets(batch.column(1), shingle))
        n = np.array([len(s) for s in sets], np.int64)
        full = np.flatnonzero(n)
        sig = np.zeros((len(sets), coordinates), np.uint32)
        step = 200_000
        i = 0
        while i < len(full):  # some rows at a time: about `step` shingles
            upto = np.cumsum(n[full[i:]])
            j = i + max(1, int(np.searchsorted(upto, step, "right")))
            rows = full[i:j]
            x = np.concatenate([sets[r] for r in rows])
            at = np.cumsum(n[rows]) - n[rows]
            for c in range(coordinates):
                sig[rows, c] = np.minimum.reduceat(((x * mult[c] + plus[c]) >> U(32)).astype(np.uint32), at)
            i = j
        empty = n == 0
        flat = pa.array(sig.view(np.int32).ravel())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * coordinates), flat)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(_keys(sets), mask=empty), lists,
                                          *batch.columns[2:]], ["doc_id", "n_shingles", "node", "sig", *batch.schema.names[2:]])


def features(docs: DataFrame, shingle: int, coordinates: int, text_hash: bool = False) -> DataFrame:
    """doc_id, n_shingles, node (set hash), sig per row; with ``text_hash``, a hash of its text."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    more = [F.xxhash64("text").alias("text_hash")] if text_hash else []
    return docs.select("doc_id", "text", *more).mapInArrow(
        partial(_features, shingle, coordinates),
        f"doc_id {kind}, n_shingles long, node long, sig array<int>" + ", text_hash long" * text_hash)


def posting_lists(nodes: DataFrame, matches: int) -> DataFrame:
    """key, node, n, pop: each node under its rarest shared (coordinate, value) pairs; ``pop`` is how
    many postings share a pair with the node, largest for the text that others are copies of."""
    post = nodes.select("node", "n", F.posexplode("sig").alias("c", "v"))
    post = post.select("node", "n", (F.col("c") * F.lit(1 << 32) + F.col("v").cast("long") + F.lit(1 << 31)).alias("key"))
    shared = post.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    own = (post.join(shared, "key").groupBy("node", "n")
           .agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("own")))  # at most `coordinates` of them
    own = own.where(F.size("own") >= matches)
    pop = F.aggregate("own", F.lit(0).cast("long"), lambda total, p: total + p["df"])
    return own.select("node", "n", pop.alias("pop"), F.explode(F.expr(f"slice(own, 1, size(own) - {matches - 1})")).alias("p")).select(
        F.col("p.key").alias("key"), "node", "n", "pop")


def _agreeing(pairs: DataFrame, sigs: DataFrame, matches: int) -> DataFrame:
    """The pairs (a, b) whose signatures agree on ``matches`` coordinates."""
    p = (pairs.join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a")
         .join(sigs.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b"))
    same = F.size(F.filter(F.arrays_zip("sa", "sb"), lambda z: z["sa"] == z["sb"]))
    return p.where(same >= matches).select("a", "b")


def clusters(nodes: DataFrame, matches: int, percent: int, rounds: int) -> DataFrame:
    """node, cluster for the nodes that agree with another node on ``matches`` coordinates."""
    lists = written(posting_lists(nodes, matches))
    sigs = nodes.join(lists.select("node").distinct(), "node", "left_semi").select("node", "sig")
    sigs = written(sigs)
    edges = found = None
    at = lists.withColumn("cluster", F.col("node"))
    for k in range(rounds + 1):
        if k < rounds:
            # the most central node leads, so a node meets the same leader in most of its lists
            lead = at.groupBy("key").agg(F.max(F.struct("pop", "node", "cluster", "n")).alias("lead"),
                                         F.count("*").alias("m")).where("m > 1").drop("m")
            met = at.join(lead, "key").where(F.col("cluster") != F.col("lead.cluster"))
            met = met.where(F.least("n", "lead.n") * 100 >= F.greatest("n", "lead.n") * percent)
            pairs = met.select(F.least("node", "lead.node").alias("a"), F.greatest("node", "lead.node").alias("b")).distinct()
        else:
            mixed = at.groupBy("key").agg((F.min("cluster") < F.max("cluster")).alias("open")).where("open").select("key")
            left = at.join(mixed, "key")
            right = left.select("key", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("cluster").alias("cb"))
            pairs = (left.join(right, "key")
                     .where((F.col("cluster") < F.col("cb")) & (F.least("n", "nb") * 100 >= F.greatest("n", "nb") * percent))
                     .select(F.col("node").alias("a"), "b").distinct())
        more = written(_agreeing(pairs, sigs, matches))
        if found is None or more.count():
            edges = more if edges is None else edges.union(more)
            found = written(connected_components(edges))
        if k < rounds:
            at = (lists.join(found, "node", "left")
                  .select("key", "node", "n", "pop", F.coalesce("component", "node").alias("cluster")))
    return found.select("node", F.col("component").alias("cluster"))


def _set_rows(shingle: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = list(row_sets(batch.column(0), shingle))
        yield pa.RecordBatch.from_arrays([pa.array(_keys(sets)), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "items"])


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Local component number of each set: linked when 100 * |A and B| >= percent * |A or B|."""
    r = len(sets)
    n = np.array([len(s) for s in sets], np.int64)
    items, col = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(r), n)
    often = np.bincount(col, minlength=len(items)) > 1  # others are in one set only
    keep = often[col]
    row, col = row[keep], (np.cumsum(often) - 1)[col[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    common = np.zeros((r, r), np.float32)  # counts are below 2^24 for texts of up to 16 million shingles
    width = 4096
    for c in range(0, int(often.sum()), width):
        i, j = np.searchsorted(col, [c, c + width])
        m = np.zeros((r, min(width, int(often.sum()) - c)), np.float32)
        m[row[i:j], col[i:j] - c] = 1
        common += m @ m.T
    common = common.astype(np.int64)
    link = 100 * common >= percent * (n[:, None] + n[None, :] - common)
    np.fill_diagonal(link, True)
    label = np.arange(r)
    while True:
        low = np.where(link, label[None, :], r).min(axis=1)
        low = low[low]
        if (low == label).all():
            return label
        label = np.minimum(label, low)


def _links(percent: int, group: pa.Table) -> pa.Table:
    node = group["node"].to_numpy()
    order = np.argsort(node)
    node = node[order]
    items = group["items"].to_pylist()
    label = linked([np.frombuffer(items[i], np.uint64) for i in order], percent)
    a, b = node, node[label]
    return pa.table({"a": pa.array(a[a != b]), "b": pa.array(b[a != b])})


def confirmed(sets: DataFrame, percent: int, block: int) -> DataFrame:
    """node, component of the exact links inside each cluster of (cluster, node, items)."""
    sizes = sets.groupBy("cluster").agg(F.count("*").alias("m"))
    blocks = F.ceil(F.col("m") / block).cast("long")
    at = written(sets.join(sizes, "cluster").withColumn("blocks", blocks)
                 .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))))

    def compare(group: pa.Table) -> pa.Table:
        return _links(percent, group)

    # every block with the first one; a cluster of one block just with itself
    first = F.when(F.col("block") == 0, F.sequence(F.least(F.lit(1), F.col("blocks") - 1), F.col("blocks") - 1))
    first = at.withColumn("part", F.explode(F.coalesce(first, F.array("block"))))
    edges = written(first.repartition("cluster", "part").groupBy("cluster", "part").applyInArrow(compare, "a long, b long"))
    wide = at.where("blocks > 2")
    found = connected_components(edges)
    if not wide.count():
        return found
    found = written(found)
    of = (wide.select("cluster", "node", "m", "blocks").join(found, "node", "left")
          .withColumn("component", F.coalesce("component", "node")))
    by = of.groupBy("cluster", "component").agg(F.count("*").alias("n"))
    main = by.groupBy("cluster").agg(F.max(F.struct("n", "component")).alias("main"), F.sum("n").alias("m"))
    main = main.select("cluster", F.col("main.component").alias("main"),
                       F.ceil((F.col("m") - F.col("main.n")) / block).cast("long").alias("strays")).where("strays > 0")
    stray = of.join(main, "cluster").where("component <> main").select("node", "strays")
    stray = stray.withColumn("stray", F.pmod(F.xxhash64("node", F.lit(1)), F.col("strays"))).select("node", "stray")
    rest = wide.join(main, "cluster").join(stray, "node", "left")
    as_stray = rest.where("stray is not null").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    as_stray = as_stray.select("cluster", "node", "items", "part", "stray")
    as_member = rest.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("strays") - 1)))
    as_member = (as_member.where("stray is null or stray <> with")
                 .select("cluster", "node", "items", F.col("block").alias("part"), F.col("with").alias("stray")))
    second = as_stray.union(as_member).repartition("cluster", "part", "stray").groupBy("cluster", "part", "stray").applyInArrow(compare, "a long, b long")
    more = written(second)
    if not more.count():
        return found
    return connected_components(edges.union(more))


def _judged(docs: DataFrame, shingle: int, percent: int, coordinates: int, matches: int, block: int, rounds: int,
            text_hash: bool = False) -> tuple[DataFrame, DataFrame]:
    """The ``features`` of every row; node, component (a node), component_id of every set."""
    rows = written(features(docs, shingle, coordinates, text_hash))
    nodes = (rows.where("n_shingles > 0").groupBy("node").agg(
        F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.min("doc_id").alias("low")))
    nodes = written(nodes)
    group = written(clusters(nodes, matches, percent, rounds))
    found = group.count()
    low = written(group.join(nodes.select("node", "low"), "node"))
    ids = small(low.select("low").distinct(), found)
    text = docs.select("doc_id", "text").join(ids, docs["doc_id"].eqNullSafe(F.col("low")), "left_semi")
    sets = text.select("text").mapInArrow(partial(_set_rows, shingle), "node long, items binary")
    sets = sets.join(small(group, found), "node").dropDuplicates(["node"]).select("cluster", "node", "items")
    component = confirmed(written(sets), percent, block)
    names = nodes.select("node", "low").join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = written(names)
    least = names.groupBy("component").agg(F.min("low").alias("component_id"))
    return rows, names.join(least, "component").select("node", "component", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, coordinates: int = COORDINATES,
                    matches: int = MATCHES, block: int = BLOCK, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    rows, names = _judged(docs, shingle, percent, coordinates, matches, block, rounds)
    filled = (rows.where("n_shingles > 0").select("doc_id", "n_shingles", "node").join(names.drop("component"), "node")
              .select("doc_id", "n_shingles", "component_id"))
    out = filled.union(rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(docs: DataFrame, shingle: int = 5, percent: int = 80, coordinates: int = COORDINATES,
                     matches: int = MATCHES, block: int = BLOCK, rounds: int = ROUNDS) -> DataFrame:
    """The rows, one of each group of near duplicates; columns as they are.

    A row goes only if its own text is in the group of a row that stays, whatever other
    rows share its doc_id: of a group, the row with the smallest doc_id stays (null ids
    last, then by hash of the text; of equal rows the first in the order of their columns).
    Rows without words all stay.
    """
    rows, names = _judged(docs, shingle, percent, coordinates, matches, block, rounds, text_hash=True)
    key = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    sets = rows.where("n_shingles > 0").groupBy("node", "doc_id", "text_hash").agg(F.count("*").alias("rows"))
    sets = written(sets.join(names.select("node", "component"), "node").select("component", key.alias("key"), "rows"))
    stays = sets.groupBy("component").agg(F.min("key").alias("stays"), F.sum("rows").alias("all")).where("all > 1")
    stays = written(stays.drop("all"))  # a table of its own: the join is by broadcast, or one that can be split
    sets = written(sets.join(small(stays, stays.count()), "component").select("key.doc_id", "key.text_hash", "rows", (F.col("key") == F.col("stays")).alias("kept")))
    doc_id, text_hash = (_free(docs, c) for c in ("own_id", "own_hash"))
    named = [F.col("doc_id").alias(doc_id), F.col("text_hash").alias(text_hash)]
    same = docs["doc_id"].eqNullSafe(F.col(doc_id)) & (F.xxhash64(docs["text"]) == F.col(text_hash))
    gone, again = sets.where("not kept").select(*named), sets.where("kept and rows > 1").select(*named)
    out = docs.join(small(gone, gone.count()), same, "left_anti")
    n = again.count()
    if not n:
        return out
    again = small(again, n)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    first = (out.join(again, same, "left_semi").groupBy("doc_id", F.xxhash64("text"))
             .agg(F.min_by(row, F.to_json(row, {"ignoreNullFields": "false"})).alias("_row")).select("_row.*"))
    return out.join(again, same, "left_anti").union(first)


def _free(df: DataFrame, name: str) -> str:
    """``name``, longer where ``df`` has such a column."""
    while name in df.columns:
        name += "_"
    return name
