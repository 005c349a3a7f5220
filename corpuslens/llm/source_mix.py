"""Mix sources to target weights with a low-discrepancy schedule of equal-token blocks.

Words are runs of characters other than space and 09-0D; the mix is counted in words.

1. Targets: sources in code-point order (null last) weigh 3, 1, 2, repeating,
   and share ``share`` times all words; a target stops at ``cap`` times its
   source's words and the excess goes to the others by weight.
2. Blocks: each source's documents are shuffled (order of a hash), laid end to
   end, once per pass, and cut into blocks of ``block`` words up to the target.
   Offsets come from sums per (source, hash bucket), running sums over that
   small table and a window inside one bucket, so no task holds a source.
3. Schedule: slot ``j`` goes to the source whose share of the cumulative
   targets holds the golden-ratio point frac((j + 1/2) / phi).  The r-th slot of a source takes
   its r-th block.  Ranks come from counts per (source, run of slots) in the
   same way.  Slots past a source's last block are dropped, and the few blocks
   that got no slot (at most the discrepancy, O(log slots)) close the schedule.
4. Slots are joined with the blocks' document pieces on (source, block).

Every source gets exactly its target, rounded to whole words; a document is
taken at most ``ceil(cap)`` times.  Hashes of the rows decide everything, so
reruns and other partitionings agree.

Defined results: null texts have size 0 and are taken 0 times; a null source is
a source; equal rows share one place in the shuffle, one after the other; an
empty table gives an empty result.  Only doc_id, source and text are read.

The table of sources (one row each) passes through one task.
"""

from __future__ import annotations

import itertools
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ._spark import small_batches, spread, written

WORD = r"[^\x20\x09-\x0D]+"
GOLDEN = 0.6180339887498949
BUCKETS = 4096
COPIES = 4096
RUN = 65536  # slots counted together


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(rows: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """source, source_no, source_size, target, low, high (cumulative share) per source of (source, size, copies)."""
    s = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    s = s.withColumn("source_no", F.row_number().over(by_name) - 1)
    s = s.withColumn("weight", F.array(*map(F.lit, weights))[F.col("source_no") % len(weights)].cast("double"))
    s = s.withColumn("most", F.col("source_size") * F.lit(float(cap)))
    # if the i-1 sources with the smallest most/weight are full, the rest share level_i per weight;
    # the level that holds is the largest one
    by_fill = Window.orderBy(F.col("most") / F.col("weight"), "source_no")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    left = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = s.withColumn("budget", F.sum("source_size").over(whole) * F.lit(float(share)))
    s = s.withColumn("level", (F.col("budget") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(left))
    s = s.withColumn("target", F.least("most", F.col("weight") * F.max("level").over(whole)))
    total = F.sum("target").over(whole)
    upto = F.sum("target").over(by_name.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    s = s.withColumn("high", F.when(total > 0, upto / total).otherwise(0.0))
    s = s.withColumn("low", F.coalesce(F.lag("high").over(by_name), F.lit(0.0)))
    return s.select("source", "source_no", "source_size", "target", "low", "high",
                    F.round("target").cast("long").alias("goal"))


def schedule(sources: DataFrame, block: int) -> DataFrame:
    """slot, source_no, block_no: which block of which source each slot takes."""
    spark = sources.sparkSession
    got = sources.agg(F.sum("goal"), F.max("source_no")).first()
    slots = -(-(got[0] or 0) // block)
    cells = 1024
    j = spark.range(slots).select(F.col("id").alias("slot"), ((F.col("id") + 0.5) * GOLDEN % 1.0).alias("point"))
    j = j.withColumn("cell", F.floor(F.col("point") * cells).cast("long"))
    quota = sources.select("source_no", F.ceil(F.col("goal") / block).alias("blocks"), "low", "high")
    cover = (quota.where("high > low")
             .select("source_no", "low", "high",
                     F.explode(F.sequence(F.floor(F.col("low") * cells), F.floor(F.col("high") * cells))).alias("cell")))
    j = (j.join(cover, "cell").where("point >= low and point < high")
         .select("slot", "source_no", F.floor(F.col("slot") / RUN).alias("run")))
    counts = j.groupBy("source_no", "run").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source_no").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    inside = Window.partitionBy("source_no", "run").orderBy("slot")
    ranked = (j.withColumn("r", F.row_number().over(inside) - 1).join(counts.select("source_no", "run", "base"), ["source_no", "run"])
              .select("slot", "source_no", (F.col("base") + F.col("r")).alias("block_no"))
              .join(quota.select("source_no", "blocks"), "source_no").where("block_no < blocks").drop("blocks"))
    # blocks without a slot, at the end, source by source
    have = counts.groupBy("source_no").agg(F.sum("n").alias("n"))
    closing = (quota.join(have, "source_no", "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n < blocks")
               .select("source_no", F.explode(F.sequence(F.col("n"), F.col("blocks") - 1)).alias("block_no")))
    closing = closing.select((F.lit(slots) + F.row_number().over(Window.orderBy("source_no", "block_no")) - 1).alias("slot"),
                             "source_no", "block_no")
    return ranked.unionByName(closing)


def pieces(rows: DataFrame, sources: DataFrame, block: int, cap: float) -> DataFrame:
    """Document pieces of every block: key, copy, source columns, block_no, start, length (null and 0 if never taken).

    ``rows`` has key, source, size, copies; equal rows are ``copies`` and stand next to each other.
    """
    rows = rows.join(F.broadcast(sources.select("source", "source_no", "source_size", "target", "goal"))
                     if sources.limit(100_001).count() <= 100_000 else sources.drop("low", "high"),
                     rows["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    rows = rows.withColumn("bucket", spread("key", F.lit("order"), buckets=BUCKETS))
    sums = rows.groupBy("source_no", "bucket").agg(F.sum(F.col("size") * F.col("copies")).alias("n"))
    over = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source_no", "bucket", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("base"))
    inside = (Window.partitionBy("source_no", "bucket").orderBy(F.xxhash64("key", F.lit("place")), "key", "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("before", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(inside), F.lit(0)))
    rows = rows.join(sums, ["source_no", "bucket"])
    some = F.lit(COPIES).cast("long")  # copies are numbered in two steps, so that no row holds a list of all
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, some)))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.col("copy"), F.least(F.col("copy") + some, F.col("copies")) - 1)))
    rows = rows.withColumn("offset", F.col("base") + F.col("before") + F.col("copy") * F.col("size"))
    passes = range(-int(-cap // 1))
    rows = rows.withColumn("begin", F.explode(F.array(*[F.col("offset") + F.col("source_size") * i for i in passes])))
    rows = rows.withColumn("end", F.least(F.col("begin") + F.col("size"), F.col("goal")))
    first, last = F.floor(F.col("begin") / block), F.floor((F.col("end") - 1) / block)
    rows = rows.withColumn("block_no", F.explode_outer(F.when(F.col("end") > F.col("begin"), F.sequence(first, last))))
    lo, hi = F.greatest("begin", F.col("block_no") * block), F.least("end", (F.col("block_no") + 1) * block)
    return rows.select("key", "copy", "source", "source_no", "size", "source_size", "target", "block_no",
                       F.coalesce(lo - F.col("begin"), F.lit(0)).alias("start"), F.coalesce(hi - lo, F.lit(0)).alias("length"))


def mix(rows: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0,
        block: int = 64) -> DataFrame:
    """The scheduled mix of (key, source, size): slot, key, copy, ..., start, length of each taken piece,
    and one row with a null slot for every row and pass of which nothing is taken."""
    rows = written(rows.groupBy("key", "source", "size").agg(F.count("*").alias("copies")))
    sources = written(source_targets(rows, weights, share, cap))
    parts = pieces(rows, sources, block, cap)
    return parts.join(schedule(sources, block), ["source_no", "block_no"], "left")


def sized(docs: DataFrame) -> DataFrame:
    return docs.select(F.struct("doc_id").alias("key"), "source", words(F.col("text")).alias("size"))


def taken(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and the words that the mix takes, per document."""
    got = mix(sized(docs)).groupBy("key", "source_no", "size", "copy").agg(
        F.first("source_size").alias("source_size"), F.first("target").alias("target"),
        F.sum(F.when(F.col("slot").isNotNull(), F.col("length")).otherwise(0)).alias("taken"))
    return got.select("key.doc_id", "size", "source_size", "target", "taken")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""

    @F.arrow_udf("string")
    def cut(texts: pa.Array, counts: pa.Array) -> pa.Array:
        word = re.compile(r"[^\x20\x09-\x0D]+")
        out = []
        for text, n in zip(texts, counts.to_pylist(), strict=True):
            text = text.as_py()
            if text is not None:
                m = next(itertools.islice(word.finditer(text), n - 1, None), None)
                text = text[: m.end()] if m else text
            out.append(text)
        return pa.array(out, pa.string())

    return cut.asNondeterministic()(text, n)


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents: each row as often as it is wholly taken, and once cut after the words
    that are taken of it in part (``n_chars`` follows where it gave the text's length).

    Rows equal in every column count as copies of one row.  Columns stay as they are.
    """
    small_batches(docs.sparkSession)
    names = docs.columns
    doc = F.struct(*[F.col(f"`{c}`") for c in names])
    keyed = docs.select(doc.alias("doc"), F.sha2(F.to_json(doc, {"ignoreNullFields": "false"}), 256).alias("id"))
    rows = keyed.select(F.col("id").alias("key"), F.col("doc.source").alias("source"), words(F.col("doc.text")).alias("size"))
    got = mix(rows).groupBy("key", "size").agg(
        F.sum(F.when(F.col("slot").isNotNull(), F.col("length")).otherwise(0)).alias("n"))
    got = got.where("n > 0").select(F.col("key").alias("id"), "size", F.expr("n div size").alias("whole"), (F.col("n") % F.col("size")).alias("rest"))
    out = keyed.dropDuplicates(["id"]).join(got, "id")
    out = out.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("whole") + F.when(F.col("rest") > 0, 1).otherwise(0))))
    part = F.col("i") > F.col("whole")
    out = out.withColumn("cut", first_words(F.when(part, F.col("doc.text")), F.col("rest").cast("int")))
    text = F.when(part, F.col("cut")).otherwise(F.col("doc.text"))
    length = F.when(part & (F.col("doc.n_chars") == F.length("doc.text")), F.length("cut").cast("long")).otherwise(F.col("doc.n_chars"))
    return out.select(*[text.alias(c) if c == "text" else length.alias(c) if c == "n_chars" else F.col("doc").getField(c).alias(c)
                        for c in names])
