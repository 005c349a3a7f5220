"""Pack tokenised documents into fixed-length sequences: bin completion with branch and bound.

1. Each document is its token ids, as the tokenizer file gives them, and an end id (strings of
   special tokens are ordinary text on demand); only a document longer than ``capacity`` is cut, into full pieces, the first of which may be shorter.
2. Sequences depend on piece lengths only, so the search runs on the histogram
   of lengths (at most ``capacity`` numbers, whatever the corpus).  A bin is
   built around the largest remaining length; undominated fillings of its gap
   are enumerated largest lengths first (a filling that another one beats with
   a longer item in its place, or that leaves room for an item, is skipped),
   and the chosen filling is repeated as often as the histogram allows.
   Best-fit decreasing gives the first incumbent; a branch is cut when its
   waste so far rules out using fewer bins than the incumbent.  The search ends at the
   lower bound ceil(tokens / capacity) or after ``nodes`` bins.
3. Pieces of one length are interchangeable: their ranks (`_places.numbered`: by range,
   so that a length that most pieces have is no task of its own) are mapped to the bins
   and places that the search gave to that length.

Defined results: null and empty texts are the end id alone.  Rows are packed
one by one, so repeated rows are packed again.  An empty table gives an empty
result.  Only doc_id and text are read.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._places import numbered
from ._spark import small_batches, written

END_ID = 0
CAPACITY = 2048
#: Runs that the byte-level pre-tokenizer never joins with their neighbours, in Latin text.
CHUNK = re.compile(r" ?[^\W_]+| ?(?:[^\w\s]|_)+(?:(?<=')[^\W_]+)?|\s+(?!\S)|\s+")
OTHER = re.compile(r"[^\t\n\r\x20-\x7e\xa1-ɏ]")
LETTERS = re.compile(r" ?[^\W\d_]+")
CACHED = 500_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Ids(dict):
    """Chunk -> its ids as little-endian bytes, worked out by the tokenizer at first use."""

    def __init__(self, tokenizer, special: re.Pattern | None):
        self.tokenizer = tokenizer
        self.special = special  # strings that the tokenizer takes as one id

    def __missing__(self, chunk: str) -> bytes:
        ids = np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self) < CACHED:
            self[chunk] = ids
        return ids


@lru_cache(maxsize=2)
def _ids(path: str, plain_special: bool = False) -> _Ids:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = plain_special
    added = [] if plain_special else [re.escape(t.content) for t in tokenizer.get_added_tokens_decoder().values()]
    return _Ids(tokenizer, re.compile("|".join(added)) if added else None)


def encode(ids: _Ids, text: str) -> bytes:
    """Token ids of a whole text as little-endian unsigned 32-bit numbers.

    Latin text is looked up chunk by chunk, any other text goes to the tokenizer as a whole.
    """
    if OTHER.search(text) or (ids.special and ids.special.search(text)):
        return np.array(ids.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    return b"".join(map(ids.__getitem__, CHUNK.findall(text)))


def _cut(path: str, plain_special: bool, capacity: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids = _ids(path, plain_special)
    end = END_ID.to_bytes(4, "little")
    for batch in batches:
        row, piece, start, length, crc = [], [], [], [], []
        for i, text in enumerate(batch.column(1)):
            data = memoryview(encode(ids, text.as_py() or "") + end)
            n = len(data) // 4
            at = 0
            for k in range(-(-n // capacity)):
                size = (n - 1) % capacity + 1 if k == 0 else capacity
                row.append(i)
                piece.append(k)
                start.append(at)
                length.append(size)
                crc.append(zlib.crc32(data[4 * at: 4 * (at + size)]))
                at += size
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
             pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, plain_special: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document.

    ``plain_special`` takes strings of special tokens in a text as ordinary text.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        partial(_cut, tokenizer or default_tokenizer(), plain_special, capacity),
        f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def _fillings(gap: int, counts: list[int], lengths: list[int], keep: int, limit: int) -> list[tuple[int, tuple[int, ...]]]:
    """Up to ``keep`` undominated fillings (waste, lengths in descending order) of a gap, best first.

    ``lengths`` ascend and have counts; the first filling found is the best-fit one.
    """
    found: list[tuple[int, tuple[int, ...]]] = []
    left = limit

    def fits(room: int, top: int) -> int:
        return min(bisect_right(lengths, room), top) - 1

    def go(room: int, top: int, chosen: tuple[int, ...]) -> bool:
        """True when the search can stop."""
        nonlocal left
        i = fits(room, top)
        used = {}
        for c in chosen:
            used[c] = used.get(c, 0) + 1
        any_fit = False
        while i >= 0:
            n = lengths[i]
            if counts[n] > used.get(n, 0):
                any_fit = True
                left -= 1
                if n == room:
                    found.append((0, (*chosen, n)))
                    return sum(w == 0 for w, _ in found) >= keep
                if go(room - n, i + 1, (*chosen, n)):
                    return True
                if left <= 0:
                    return bool(found)
            i -= 1
        if not any_fit:  # nothing up to the last length taken fits; a longer one would dominate
            found.append((room, chosen))
        return left <= 0

    go(gap, len(lengths), ())
    best = sorted(set(found), key=lambda f: (f[0], tuple(-n for n in f[1])))[:keep]
    return best or [(gap, ())]


def search(histogram: dict[int, int], capacity: int, nodes: int = 4000, keep: int = 3, limit: int = 300):
    """(bin as lengths, how many such bins) for all items of the histogram {length: count}."""
    total = sum(n * c for n, c in histogram.items())
    bound = max(-(-total // capacity), sum(c for n, c in histogram.items() if 2 * n > capacity))

    def descend(counts, lengths, plan, bins, waste, best_bins, keep, limit, stack):
        """Complete the bins from a state; alternatives go on the stack.  None when bounded."""
        steps = 0
        while lengths:
            n = lengths[-1]
            if best_bins is not None and bins * capacity + sum(m * counts[m] for m in lengths) > (best_bins - 1) * capacity:
                return None, steps
            counts[n] -= 1
            options = _fillings(capacity - n, counts, [m for m in lengths if counts[m]], keep, limit)
            counts[n] += 1
            if stack is not None:
                for w, fill in options[1:]:
                    stack.append((counts.copy(), lengths.copy(), list(plan), bins, waste, fill))
            _apply(counts, lengths, plan, n, options[0][1])
            bins = sum(t for _, t in plan[-1:]) + bins
            waste += options[0][0] * plan[-1][1]
            steps += 1
        return plan, steps

    counts = [0] * (capacity + 1)
    for n, c in histogram.items():
        counts[n] = c
    lengths = sorted(n for n, c in histogram.items() if c)
    size = lambda plan: sum(t for _, t in plan)
    best, _ = descend(counts.copy(), lengths.copy(), [], 0, 0, None, 1, 1, None)  # best-fit decreasing
    if size(best) > bound:
        stack: list = []
        plan, steps = descend(counts.copy(), lengths.copy(), [], 0, 0, size(best), keep, limit, stack)
        if plan is not None and size(plan) < size(best):
            best = plan
        while stack and steps < nodes and size(best) > bound:
            c, ls, plan, bins, waste, fill = stack.pop()
            if bins * capacity + sum(m * c[m] for m in ls) > (size(best) - 1) * capacity:
                continue
            _apply(c, ls, plan, ls[-1], fill)
            plan, more = descend(c, ls, plan, bins + plan[-1][1], waste, size(best), keep, limit, stack)
            steps += more + 1
            if plan is not None and size(plan) < size(best):
                best = plan
    return best


def _apply(counts: list[int], lengths: list[int], plan: list, n: int, fill: tuple[int, ...]) -> None:
    """Use the bin (n, *fill) as often as the counts allow."""
    need: dict[int, int] = {}
    for m in (n, *fill):
        need[m] = need.get(m, 0) + 1
    times = min(counts[m] // k for m, k in need.items())
    for m, k in need.items():
        counts[m] -= k * times
    lengths[:] = [m for m in lengths if counts[m]]
    plan.append(((n, *fill), times))


def _place(capacity: int, layout: dict[str, np.ndarray], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sequence and offset from (length, rank): the last layout row of the length that starts at or before the rank."""
    for batch in batches:
        length, rank = (batch.column(i).to_numpy() for i in (3, 5))
        at = np.searchsorted(layout["key"], _key(length, rank), "right") - 1
        q = rank - layout["rank"][at]
        per = layout["per_bin"][at]
        sequence = layout["bin"][at] + q // per
        offset = layout["offset"][at] + q % per * length
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                                         [*batch.schema.names[:5], "sequence_id", "offset"])


def _key(length: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Sorts by length, then rank (ranks below 2^50, lengths below 2^13)."""
    return (length.astype(np.int64) << 50) + rank


def _layout(plan: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    rows, used, bins = [], {}, 0
    for items, times in plan:
        offset = 0
        for n in dict.fromkeys(items):
            k = items.count(n)
            rows.append((n, used.get(n, 0), k, bins, offset))
            used[n] = used.get(n, 0) + k * times
            offset += k * n
        bins += times
    table = np.array(sorted(rows) or [(0, 0, 1, 0, 0)], np.int64)
    return {"key": _key(table[:, 0], table[:, 1]), "rank": table[:, 1], "per_bin": table[:, 2], "bin": table[:, 3],
            "offset": table[:, 4]}


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32)."""
    histogram = cut.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most `capacity` rows
    layout = _layout(search({r["length"]: r["n"] for r in histogram}, capacity))
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ranked = numbered(cut.select(*cols), "length", ["doc_id", "piece", "ids_crc32", "start"])
    ranked = ranked.select(*cols, F.col("pos").alias("rank"))
    kind = cut.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(partial(_place, capacity, layout),
                             f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, plain_special: bool = False) -> DataFrame:
    """Every piece of every document with its sequence and place there (``plain_special``: see ``pieces``)."""
    return pack(written(pieces(docs, tokenizer, capacity, plain_special)), capacity)
