"""Records that span lines, read by many tasks: a JSON array document, quoted multi-line CSV.

Spark's text reader cuts a file at byte ranges and at a separator; whether a piece of
text lies inside quotes, and how deeply nested, depends on everything before it in the
file.  Both compose, so three steps find the records without reading a file in one task:

1. every split (byte range) says what it does to the state: whether it flips the quotes,
   and how it changes the depth if it starts outside or inside quotes;
2. the states at the splits' starts follow in file order.  One small row per split passes
   the driver, which holds the list of splits anyway;
3. every split cuts its own records.  What reaches over its edges is given out as
   fragments, at most two a split, which are put together by file order.

Parsing stays with ``from_json`` and ``from_csv``.  A record is one text value, so it has
to fit in memory; a file, or a row of a file, of any size does not.  Files are told apart
by a 64-bit hash of path and size.  Compressed files are one split each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslens.session import materialise


@dataclass(frozen=True)
class Dialect:
    """How pieces between separators change the state.

    ``quotes`` counts unescaped quotes; ``outside`` and ``inside`` are the changes of depth of a
    piece that starts outside or inside quotes; a separator outside quotes adds ``step`` to the depth.
    A record ends at a separator outside quotes at a depth of at most ``base``, or of 1 where the file
    starts with ``opener``.
    """
    separator: str
    quotes: Callable[[Column], Column]
    outside: Callable[[Column], Column]
    inside: Callable[[Column], Column]
    step: int = 0
    opener: str = ""


def _occurrences(c: Column, chars: str) -> Column:
    return F.length(c) - F.length(F.translate(c, chars, ""))


def _unescaped(c: Column) -> Column:
    return F.regexp_replace(c, r"\\[\s\S]", "")


def _nesting(c: Column) -> Column:
    bare = F.regexp_replace(c, r'"[^"]*("|$)', "")
    return _occurrences(bare, "{[") - _occurrences(bare, "}]")


CSV = Dialect("\n", lambda c: _occurrences(c, '"'), lambda c: F.lit(0), lambda c: F.lit(0))
JSON = Dialect("}", lambda c: _occurrences(_unescaped(c), '"'), lambda c: _nesting(_unescaped(c)),
               lambda c: _nesting(F.regexp_replace(_unescaped(c), r'^[^"]*("|$)', "")), step=-1, opener="[")


def records(spark: SparkSession, path: str | list[str], dialect: Dialect) -> DataFrame:
    """record (without its last separator), first (the file's first record), and the partition columns of ``path``."""
    text = spark.read.option("lineSep", dialect.separator).text(path)
    extra = [c for c in text.columns if c != "value"]
    v = F.col("value")
    pieces = text.select(
        "value", F.xxhash64("_metadata.file_path", "_metadata.file_size").alias("file_"), F.col("_metadata.file_block_start").alias("start_"),
        (dialect.quotes(v) % 2).cast("int").alias("flip_"), dialect.outside(v).cast("int").alias("out_"), dialect.inside(v).cast("int").alias("in_"),
        *[F.col(c) for c in extra])
    heads = pieces.select("file_", "start_", "flip_", "out_", "in_", F.substring(F.regexp_replace("value", r"^\s+", ""), 1, 1).alias("value"))
    effects = heads.mapInArrow(partial(_effects, dialect.step), "file_ long, start_ long, flip int, outside int, inside int, opener string")
    states = _states(sorted(effects.collect(), key=lambda e: (e["file_"], e["start_"])), dialect)
    kinds = ", ".join(f"`{c}` {text.schema[c].dataType.simpleString()}" for c in extra)
    schema = "record string, first boolean, kind_ int, file_ long, start_ long" + (", " + kinds if kinds else "")
    cut = materialise(pieces.mapInArrow(partial(_cut, states, dialect.separator, dialect.step, extra), schema))
    whole = cut.where(f"kind_ = {WHOLE}").select("record", "first", *extra)
    return whole.union(_joined(cut.where(f"kind_ <> {WHOLE}"), dialect.separator, extra))


WHOLE, HEAD, MIDDLE, TAIL = range(4)
FLUSH = 4 << 20  # characters of records that a task gathers for one Arrow batch


def _joined(fragments: DataFrame, separator: str, extra: list[str]) -> DataFrame:
    """Records that reach over splits: a tail, any middles and the next head."""
    order = Window.partitionBy("file_").orderBy("start_", "kind_").rowsBetween(Window.unboundedPreceding, 0)
    numbered = fragments.withColumn("n", F.sum(F.when(F.col("kind_") == TAIL, 1).otherwise(0)).over(order))
    part = F.struct("start_", "kind_", "record")
    return numbered.groupBy("file_", "n").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["record"]), separator).alias("record"),
        F.max("first").alias("first"), *[F.first(c).alias(c) for c in extra]).select("record", "first", *extra)


def _states(effects: list, dialect: Dialect) -> dict[tuple[int, int], tuple[int, int, int]]:
    """(inside quotes, depth, depth at which records end) at the start of every split."""
    out: dict[tuple[int, int], tuple[int, int, int]] = {}
    file, inside, depth, base = None, 0, 0, 0
    for e in effects:
        if e["file_"] != file:
            file, inside, depth = e["file_"], 0, 0
            base = int(bool(dialect.opener) and e["opener"] == dialect.opener)
        out[e["file_"], e["start_"]] = (inside, depth, base)
        depth += e["inside"] if inside else e["outside"]
        inside ^= e["flip"]
    return out


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, tuple[int, int]]]:
    """(first row, end row, split) of the splits in a batch."""
    file, start = (batch.column(c).to_numpy() for c in ("file_", "start_"))
    edge = np.flatnonzero((file[1:] != file[:-1]) | (start[1:] != start[:-1])) + 1
    for a, b in zip([0, *edge], [*edge, len(file)], strict=True):
        if b > a:
            yield int(a), int(b), (int(file[a]), int(start[a]))


def _walk(batch: pa.RecordBatch, a: int, b: int, inside: int, depth: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether each piece's end is inside quotes, and the depth after its separator."""
    flip, out, inn = (batch.column(c).to_numpy()[a:b] for c in ("flip_", "out_", "in_"))
    end = (inside + np.cumsum(flip)) & 1
    begin = np.concatenate([[inside], end[:-1]])
    return end, depth + np.cumsum(np.where(begin == 1, inn, out) + np.where(end == 0, step, 0))


def _effects(step: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    split, flip, depths, opener = None, 0, [0, 0], ""

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({
            "file_": pa.array([split[0]]), "start_": pa.array([split[1]]), "flip": pa.array([flip], pa.int32()),
            "outside": pa.array([depths[0]], pa.int32()), "inside": pa.array([depths[1]], pa.int32()), "opener": pa.array([opener])})

    for batch in batches:
        for a, b, now in _runs(batch):
            if now != split:
                if split is not None:
                    yield row()
                split, flip, depths, opener = now, 0, [0, 0], batch.column("value")[a].as_py()
            for s in (0, 1):
                end, depth = _walk(batch, a, b, s ^ flip, depths[s], step)
                depths[s] = int(depth[-1])
            flip = int(end[-1]) ^ 1
    if split is not None:
        yield row()


def _cut(states: dict, separator: str, step: int, extra: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    split, inside, depth, base, open_, ends, more, fresh = None, 0, 0, 0, [], 0, {}, True
    out: list[tuple[str, bool, int]] = []  # records of the split that were put together: text, first, kind
    size = 0

    def rows(texts: pa.Array, first: list[bool], kind: list[int]) -> pa.RecordBatch:
        n = len(texts)
        return pa.RecordBatch.from_pydict({
            "record": texts, "first": pa.array(first, pa.bool_()), "kind_": pa.array(kind, pa.int32()),
            "file_": pa.array(np.full(n, split[0])), "start_": pa.array(np.full(n, split[1])),
            **{c: v.take(pa.array(np.zeros(n, int))) for c, v in more.items()}})

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal out, size
        if out:
            texts, first, kind = zip(*out, strict=True)
            yield rows(pa.array(texts, pa.string()), list(first), list(kind))
            out, size = [], 0

    def rest() -> Iterator[pa.RecordBatch]:
        """What the split leaves open."""
        if open_:
            out.append((separator.join(open_), split[1] == 0 and not ends, TAIL if ends or fresh else MIDDLE))
        yield from flush()

    for batch in batches:
        value = batch.column("value")
        for a, b, now in _runs(batch):
            if now != split:
                if split is not None:
                    yield from rest()
                split, open_, ends = now, [], 0
                inside, depth, base = states[now]
                fresh = now[1] == 0 or (not inside and depth == base)  # a record starts where the split does
                more = {c: batch.column(c).slice(a, 1) for c in extra}
            quoted, depths = _walk(batch, a, b, inside, depth, step)
            inside, depth = int(quoted[-1]), int(depths[-1])
            stop = np.flatnonzero((quoted == 0) & (depths <= base))
            if not len(stop):
                open_ += value.slice(a, b - a).to_pylist()
                continue
            begin = np.concatenate([[0], stop[:-1] + 1])
            single = stop == begin
            if open_ or (not ends and not fresh):
                single[0] = False
            at = stop[single]
            if len(at):
                lead = bool(split[1] == 0 and not ends and single[0])
                yield rows(value.take(pa.array(at + a)), [lead] + [False] * (len(at) - 1), [WHOLE] * len(at))
            for i in np.flatnonzero(~single):
                text = separator.join([*open_, *value.slice(a + int(begin[i]), int(stop[i] - begin[i]) + 1).to_pylist()])
                open_ = []
                edge = not ends and i == 0
                out.append((text, bool(edge and split[1] == 0), HEAD if edge and not fresh else WHOLE))
                size += len(text)
                if size > FLUSH:
                    yield from flush()
            ends += len(stop)
            open_ = value.slice(a + int(stop[-1]) + 1, b - a - int(stop[-1]) - 1).to_pylist()
    if split is not None:
        yield from rest()


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def read_csv_records(spark: SparkSession, path: str | list[str], schema: T.StructType, header: bool = True) -> DataFrame:
    """CSV whose quoted values may hold line feeds (quotes doubled), columns by place as in ``schema``;
    partition columns follow.  Blank lines are no rows."""
    found = records(spark, path, CSV)
    extra = [c for c in found.columns if c not in ("record", "first")]
    line = F.regexp_replace("record", r"\r$", "")
    rows = found.where(~F.col("first")) if header else found
    rows = rows.where(F.trim(line) != "").select(F.from_csv(line, _ddl(schema), {"quote": '"', "escape": '"'}).alias("row"), *extra)
    return rows.select("row.*", *extra)


def read_json_array(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """The objects of JSON array documents, one row each (also of files that hold objects one after the other).
    An element that is no object, or malformed, is a row of nulls."""
    found = records(spark, path, JSON).select(F.regexp_replace("record", r"^[\s,\[\]]+", "").alias("record"))
    found = found.where("record <> ''")
    row = F.from_json(F.concat("record", F.lit(JSON.separator)), _ddl(schema)).alias("row")
    return found.select(row).select("row.*")
