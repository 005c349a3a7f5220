"""Helpers that run inside tasks: word spans and 64-bit word hashes of Arrow text batches.

Everything works on whole texts in blocks of bounded size, so what a batch of
long texts needs beside the texts does not grow with their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20  # text bytes worked on at a time
_POSITIONS = 1 << 12

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACE = _rng.integers(1, 1 << 63, _POSITIONS, dtype=np.uint64) | np.uint64(1)
M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: spreads every input bit over the word."""
    x = (x ^ (x >> U(30))) * M2
    x = (x ^ (x >> U(27))) * M3
    return x ^ (x >> U(31))


def text_blocks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, UTF-8 bytes, row offsets) of consecutive rows; null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = texts.cast(pa.large_binary()).fill_null(b"") if texts.null_count else texts.cast(pa.large_binary())
    if not len(texts):
        return
    _, ob, db = texts.buffers()
    offs = np.frombuffer(ob, np.int64)[texts.offset: texts.offset + len(texts) + 1]
    data = np.frombuffer(db, np.uint8) if db is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + BLOCK_BYTES, "right")) - 1)
        yield i, data[offs[i]: offs[j]], offs[i: j + 1] - offs[i]
        i = j


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data | 32, data)


def word_spans(data: np.ndarray, offs: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, words per row): words are runs of bytes other than space and 09-0D, cut at rows.

    ``inside`` replaces that rule by a mask of the bytes that make up words.
    """
    if inside is None:
        inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = offs[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    counts = np.diff(np.searchsorted(start, offs))
    return start, end, counts


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes: sum of byte code times place code, mixed with the length."""
    if not len(start):
        return np.zeros(0, np.uint64)
    length = end - start
    ends = np.cumsum(length)
    if ends[-1] > 2 * BLOCK_BYTES and len(start) > 1:  # one very long text: some words at a time
        cuts = np.unique(np.searchsorted(ends, np.arange(BLOCK_BYTES, ends[-1], BLOCK_BYTES)) + 1)
        parts = zip([0, *cuts], [*cuts, len(start)], strict=True)
        return np.concatenate([word_hashes(data, start[i:j], end[i:j]) for i, j in parts if i < j])
    total = int(ends[-1])
    place = np.arange(total) - np.repeat(ends - length, length)
    at = np.repeat(start, length) + place
    code = _PLACE[place & (_POSITIONS - 1)]
    if int(length.max()) > _POSITIONS:
        code = code * (mix((place // _POSITIONS).astype(np.uint64) + U(1)) | U(1))
    return mix(np.add.reduceat(_BYTE[data[at]] * code, ends - length) + length.astype(np.uint64) * M1)


def shingles(h: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words of one row, and how many each row has.

    A row with 1 to k-1 words has one shingle: all of its words.
    """
    n = len(h)
    acc = np.zeros(n, np.uint64)
    for i in range(k):
        acc[: n - i] = mix(acc[: n - i] * M1 + h[i:] + U(i + 1)) if i < n else acc[: n - i]
    ends = np.cumsum(counts)
    left = np.repeat(ends, counts) - np.arange(n)  # words of the row from here on
    keep = left >= k
    short = np.flatnonzero((counts > 0) & (counts < k))
    for r in short:
        s = ends[r] - counts[r]
        a = np.zeros(1, np.uint64)
        for i in range(int(counts[r])):
            a = mix(a * M1 + h[s + i: s + i + 1] + U(i + 1))
        acc[s] = a[0] ^ M2
        keep[s] = True
    per_row = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    return acc[keep], per_row


def sorted_runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[list[np.ndarray | pa.Array], np.ndarray]]:
    """(columns, bounds) of whole groups from batches sorted by their first ``keys`` integer columns.

    Group ``g`` is rows ``bounds[g]:bounds[g + 1]``; the last group of a batch waits for the next batch.
    """
    rest: pa.Table | None = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        now = pa.concat_tables([rest, now]) if rest is not None else now
        if not now.num_rows:
            continue
        new = np.zeros(now.num_rows, bool)
        for c in range(keys):
            k = now.column(c).to_numpy()
            new[1:] |= k[1:] != k[:-1]
        starts = np.flatnonzero(new)
        cut = int(starts[-1]) if len(starts) else 0
        rest = now.slice(cut)
        if cut:
            yield _columns(now.slice(0, cut)), np.concatenate([[0], starts])
    if rest is not None and rest.num_rows:
        yield _columns(rest), np.array([0, rest.num_rows])


def _columns(t: pa.Table) -> list[np.ndarray | pa.Array]:
    out = []
    for c in t.columns:
        c = c.combine_chunks()
        out.append(c if pa.types.is_binary(c.type) else c.to_numpy(zero_copy_only=False))
    return out
