"""Exact places and running sums within a key, without gathering a key in one task.

Rows are dealt by range of (key, order), so a hot key is spread over many tasks.
Each task numbers its own runs of equal keys; only a task's first run can be the
continuation of an earlier one, so one small row per task (first and last run)
is folded on the driver and added back.  What the driver holds grows with the
number of tasks, not with keys or rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ._spark import written

STEP = 0x9E3779B97F4A7C15  # odd: base of the polynomial sums
U = np.uint64


def power(exponents: np.ndarray) -> np.ndarray:
    """``STEP`` to the given powers, modulo 2**64."""
    return np.power(U(STEP), exponents.astype(np.uint64))


def numbered(df: DataFrame, key: str, order: list[str], running: dict[str, str] | None = None) -> DataFrame:
    """``df`` with ``pos`` (0-based place within ``key``, by ``order``) and ``last`` (the key's final row).

    ``running`` names long columns of ``df`` that become running totals within the key, this row
    included: ``sum`` adds the values, ``poly`` adds value * STEP ** pos, both modulo 2**64.
    Rows whose order is tied are told apart by nothing: the caller's order must be total up to equal rows.
    """
    running = running or {}
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    dealt = df.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    local = written(dealt.mapInArrow(partial(_number, key, running), f"{schema}, pos long, last boolean, part_ int, run_ long"))
    state = ["run_", "pos", *running, key]
    ends = (local.where("last").groupBy("part_")
            .agg(F.min(F.struct(*state)).alias("first"), F.max(F.struct(*state)).alias("final")).orderBy("part_").collect())
    return local.mapInArrow(partial(_carry, running, _offsets(ends, key, running)), f"{schema}, pos long, last boolean")


def _offsets(ends: list, key: str, running: dict[str, str]) -> dict[int, tuple[int, bool, int, dict[str, int]]]:
    """For each task: rows and totals that its first run continues, and whether a later task continues its last run."""
    out: dict[int, tuple[int, bool, int, dict[str, int]]] = {}
    mask = (1 << 64) - 1
    open_key, rows, totals = object(), 0, dict.fromkeys(running, 0)
    for i, e in enumerate(ends):
        if e["first"][key] != open_key or i == 0:
            rows, totals = 0, dict.fromkeys(running, 0)
        before, had = rows, totals
        if e["first"]["run_"] == e["final"]["run_"]:
            step = pow(STEP, rows, 1 << 64)
            totals = {c: (had[c] + (step if how == "poly" else 1) * (e["first"][c] & mask)) & mask for c, how in running.items()}
            rows = before + e["first"]["pos"] + 1
        else:
            totals = {c: e["final"][c] & mask for c in running}
            rows = e["final"]["pos"] + 1
        open_key = e["final"][key]
        goes_on = i + 1 < len(ends) and ends[i + 1]["first"][key] == open_key
        out[e["part_"]] = (before, goes_on, e["final"]["run_"], had)
    return out


def changes(column: pa.Array) -> np.ndarray:
    """True where a row differs from the row before it (the first row: True); null equals null."""
    out = np.ones(len(column), bool)
    if len(column) > 1:
        a, b = column.slice(1), column.slice(0, len(column) - 1)
        differ = pc.fill_null(pc.not_equal(a, b), False)
        out[1:] = pc.or_(differ, pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)
    return out


def _number(key: str, running: dict[str, str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    run, rows, totals = -1, 0, dict.fromkeys(running, U(0))
    held: pa.RecordBatch | None = None  # the row before the next batch: its `last` is not known yet
    before: pa.Array | None = None  # key of the row before it

    def numbers(batch: pa.RecordBatch, ends: np.ndarray) -> pa.RecordBatch:
        nonlocal run, rows, totals, before
        n = batch.num_rows
        column = batch.column(key)
        new = changes(column)
        if before is not None:
            new[0] = changes(pa.concat_arrays([before, column.slice(0, 1)]))[1]
        before = column.slice(n - 1)
        nth = np.cumsum(new)  # 0: the run that is open
        begin = np.concatenate([[0], np.flatnonzero(new)])[nth]
        pos = np.arange(n) - begin + np.where(nth == 0, rows, 0)
        cols = {name: batch.column(name) for name in batch.schema.names}
        for c, how in running.items():
            v = cols[c].to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            v = np.cumsum(v * power(pos) if how == "poly" else v, dtype=np.uint64)
            v = v - np.concatenate([np.zeros(1, np.uint64), v])[begin] + np.where(nth == 0, totals[c], U(0))
            totals[c] = v[-1]
            cols[c] = pa.array(v.view(np.int64))
        cols |= {"pos": pa.array(pos), "last": pa.array(ends), "part_": pa.array(np.full(n, part, np.int32)), "run_": pa.array(run + nth)}
        run, rows = int(run + nth[-1]), int(pos[-1]) + 1
        return pa.RecordBatch.from_pydict(cols)

    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([held, batch] if held is not None else [batch]).combine_chunks().to_batches()[0]
        held = now.slice(now.num_rows - 1)
        if now.num_rows > 1:
            yield numbers(now.slice(0, now.num_rows - 1), changes(now.column(key))[1:])
    if held is not None:
        yield numbers(held, np.ones(1, bool))


def _carry(running: dict[str, str], offsets: dict, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols = {name: batch.column(name) for name in batch.schema.names}
        part, run = (cols.pop(c).to_numpy() for c in ("part_", "run_"))
        pos, last = (cols[c].to_numpy(zero_copy_only=False).copy() for c in ("pos", "last"))
        sums = {c: cols[c].to_numpy(zero_copy_only=False).view(np.uint64).copy() for c in running}
        for p in np.unique(part):
            rows, goes_on, final, had = offsets[int(p)]
            if goes_on:
                last[(part == p) & (run == final)] = False
            if rows:
                at = (part == p) & (run == 0)
                step = power(np.array([rows]))[0]
                for c, how in running.items():
                    sums[c][at] = sums[c][at] * (step if how == "poly" else U(1)) + U(had[c])
                pos[at] += rows
        cols |= {c: pa.array(v.view(np.int64)) for c, v in sums.items()} | {"pos": pa.array(pos), "last": pa.array(last)}
        yield pa.RecordBatch.from_pydict(cols)
