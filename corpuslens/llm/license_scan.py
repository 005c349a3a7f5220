"""License scan: winnowed template fingerprints, an inverted index, banded alignment.

1. Words are runs of ASCII letters, digits and non-ASCII bytes, lower-cased
   (A-Z); punctuation and layout do not count.
2. Index: hashes of runs of words of every template, as an inverted index
   hash -> (template, position).  Changes and omissions that ``coverage`` allows leave one
   run of the template's words whole (``whole_run``): fingerprints are that long, ``k`` words at
   most, and winnowed over ``window`` neighbours as far as such a run still holds one (at 0.8
   not at all).  Words put in at many places can leave no whole run.  The index is cut
   into slices of at most ``slice_size`` fingerprints, whole templates each, so what
   a task holds is bounded; each slice is one pass over the documents.
3. Candidates: the same hashes of every text (all of them) are looked up; hits of
   one template whose starts differ by at most ``band`` words (half the template's words, if
   that is less; as many as ``coverage`` lets go, if that is more) form a candidate.
4. Alignment: the words around a candidate are aligned with the template in a
   band of so many words (local alignment: +1 equal, -1 other, -1 skipped, of equal scores
   more equal words; where that falls short, the most equal words with the fewest others), and the
   match is kept when ``coverage`` of the template's words are matched; the words before and
   behind a match are aligned again.  Of overlapping matches the one with the most equal words stays,
   less the template's words that are missing and the text's that were put in: so a licence whose
   notice differs from another's by a word is told apart (ties: the first template by name).

``TEMPLATES`` holds notices; ``read_templates`` takes a folder of whole licence texts, one file each.

Whole texts are scanned; nothing is shuffled.

Defined results: null, empty and wordless texts and templates match nothing.
Rows are judged one by one (repeated rows repeat their matches); an empty table
or no templates give an empty result.  Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ._batches import lower_ascii, shingles, text_blocks, word_hashes, word_spans
from ._spark import small_batches
from .passage_chains import thinned

K, WINDOW, BAND, COVERAGE, SLICE = 4, 4, 6, 0.8, 200_000

# Notices of public licences, as their stewards ask to put them in files, and the granting
# paragraphs of the short ones.
TEMPLATES = {
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "AGPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version."),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
        "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
        "with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to "
        "endorse or promote products derived from this software without specific prior written permission."),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
        "accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, "
        "execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to "
        "whom the Software is furnished to do so, all subject to the following:"),
    "CC-BY-NC-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC0-1.0": "has waived all copyright and related or neighboring rights to this work",
    "EPL-2.0-header": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
        "which is available at https://www.eclipse.org/legal/epl-2.0/"),
    "GPL-2.0-header": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any "
        "later version."),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "LGPL-2.1-header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) "
        "any later version."),
    "LGPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version."),
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
        "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
        "purpose, commercial or non-commercial, and by any means."),
    "Zlib": (
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to "
        "alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not "
        "be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an "
        "acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must "
        "be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be "
        "removed or altered from any source distribution."),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
        "specific language governing permissions and limitations under the License."),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
        "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
        "with the distribution."),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version."),
    "MIT": "Released under the MIT License",
    "MIT-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software."),
}


def _words(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets, word hashes, word starts, word ends, words per row)."""
    for first, data, offs in text_blocks(texts):
        data = lower_ascii(data)
        inside = ((data >= 48) & (data <= 57)) | ((data >= 97) & (data <= 122)) | (data >= 128)
        start, end, counts = word_spans(data, offs, inside)
        yield first, data, offs, word_hashes(data, start, end), start, end, counts


def least_equal(n: int, coverage: float) -> int:
    """The smallest number of equal words that is ``coverage`` of ``n``."""
    return next(m for m in range(max(int(coverage * n) - 1, 0), n + 2) if m >= coverage * n)


def whole_run(n: int, coverage: float) -> int:
    """Words of the longest run that is whole in any match of ``n`` words with as many changed or left out as ``coverage`` allows."""
    gone = max(n - least_equal(n, coverage), 0)
    return max(1, -(-(n - gone) // (gone + 1)))


class Index:
    """Inverted index of the fingerprints of some templates."""

    def __init__(self, templates: list[tuple[str, str]], k: int, window: int, band: int, coverage: float):
        self.names = [name for name, _ in templates]
        self.words: list[np.ndarray] = []
        self.need: list[int] = []  # equal words of a match
        self.side: list[int] = []  # how far starts of one match may differ
        self.sizes: set[int] = set()  # words of the fingerprints
        keys, owner, place = [], [], []
        for i, (_, text) in enumerate(templates):
            words = np.concatenate([w[3] for w in _words(pa.array([text], pa.string()))] or [np.zeros(0, np.uint64)])
            self.words.append(words)
            self.need.append(max(least_equal(len(words), coverage), 1))
            self.side.append(max(min(band, len(words) // 2), len(words) - self.need[-1]))
            if not len(words):
                continue
            run = whole_run(len(words), coverage)
            size = min(k, run)
            h, n = shingles(words, np.array([len(words)]), size)
            at = thinned(h, n, min(window, run - size + 1))
            keys.append(h[at])
            owner.append(np.full(len(at), i))
            place.append(at)
            self.sizes.add(size)
        none = np.zeros(0, np.int64)
        key = np.concatenate(keys or [np.zeros(0, np.uint64)])
        order = np.argsort(key, kind="stable")
        self.key = key[order]
        self.owner, self.place = np.concatenate(owner or [none])[order], np.concatenate(place or [none])[order]


def candidates(index: Index, words: np.ndarray, counts: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(row, template, first hit, last hit as template starts) in word positions of the block."""
    hits_at, hits_i = [], []
    for size in sorted(index.sizes):
        h, n = shingles(words, counts, size)
        full = np.repeat(counts >= size, n)
        per = np.where(counts >= size, n, 0)
        at = np.arange(full.sum()) + np.repeat(np.cumsum(counts) - counts - (np.cumsum(per) - per), per)
        lo, hi = np.searchsorted(index.key, h[full], "left"), np.searchsorted(index.key, h[full], "right")
        found = np.flatnonzero(hi > lo)
        times = (hi - lo)[found]
        hits_at.append(np.repeat(at[found], times))
        hits_i.append(np.repeat(lo[found], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times))
    if not sum(map(len, hits_at)):
        return []
    at, i = np.concatenate(hits_at), np.concatenate(hits_i)
    template, begin = index.owner[i], at - index.place[i]  # where the template would start
    row = np.searchsorted(np.cumsum(counts), at, "right")
    order = np.lexsort((begin, template, row))
    row, template, begin = row[order], template[order], begin[order]
    apart = np.array(index.side)  # matches of one short template can follow closely
    new = np.ones(len(row), bool)
    new[1:] = (np.diff(row) != 0) | (np.diff(template) != 0) | (np.diff(begin) > apart[template[1:]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1
    return list(zip(row[first].tolist(), template[first].tolist(), begin[first].tolist(), begin[last].tolist(), strict=True))


def local_alignment(text: np.ndarray, template: np.ndarray, diagonal: int, band: int,
                    gain: int = 1, cost: int = 1) -> tuple[int, int, int, int, int]:
    """(start, end in the text, start, end in the template, equal words) of the best local alignment (``gain`` per
    equal word less ``cost`` per other one) whose text position less template position stays within ``band`` of ``diagonal``."""
    width = 2 * band + 1
    score = np.zeros((len(template) + 1, width + 1), np.int64)
    move = np.zeros((len(template) + 1, width), np.int8)  # 0 start, 1 both, 2 skips a template word, 3 skips a text word
    best = (0, 0, 0)
    offsets = np.arange(width) + diagonal - band
    for i in range(1, len(template) + 1):
        j = offsets + i  # text words used, per band column
        ok = (j >= 1) & (j <= len(text))
        same = np.zeros(width, bool)
        same[ok] = text[j[ok] - 1] == template[i - 1]
        both = score[i - 1, :width] + np.where(same, gain, -cost)
        both[~ok] = -(1 << 30)
        skip = score[i - 1, 1:] - cost
        skip[(j < 0) | (j > len(text))] = -(1 << 30)
        s = np.maximum(np.maximum(both, skip), 0)
        m = np.where(s == 0, 0, np.where(both >= skip, 1, 2))
        for c in range(1, width):  # a skipped text word stays in the same row
            if ok[c] and s[c - 1] - cost > s[c]:
                s[c], m[c] = s[c - 1] - cost, 3
        score[i, :width], move[i] = s, m
        c = int(s.argmax())
        if s[c] > best[0]:
            best = (int(s[c]), i, c)
    _, i, c = best
    if not best[0]:
        return 0, 0, 0, 0, 0
    end_i, end_j, equal = i, int(offsets[c]) + i, 0
    while i > 0 and move[i, c]:
        j = int(offsets[c]) + i
        if move[i, c] == 1:
            equal += int(text[j - 1] == template[i - 1])
            i -= 1
        elif move[i, c] == 2:
            i, c = i - 1, c + 1
        else:
            c -= 1
    return int(offsets[c]) + i, end_j, i, end_i, equal


def matches(text: np.ndarray, template: np.ndarray, diagonal: int, band: int, need: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, equal words) of the alignments with ``need`` equal words, none inside another."""
    todo = [(0, len(text))]
    while todo:
        a, b = todo.pop()
        part = text[a:b]
        if len(part) < need or np.isin(template, part).sum() < need:
            continue
        much = len(part) + len(template) + 1
        x0, x1, _, _, equal = local_alignment(part, template, diagonal - a, band, much + 1, much)
        if equal < need:  # a changed word near an end costs more there than the words behind it bring
            x0, x1, _, _, equal = local_alignment(part, template, diagonal - a, band, much, 1)
        if equal < need:
            continue  # there is none: the second one has the most equal words that the band allows
        yield a + x0, a + x1, equal
        todo += [(a, a + x0), (a + x1, b)]


def _scan(index: Index, alone: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All matches of each row; with ``alone`` (the only slice of the index) without those that overlap a better one."""
    for batch in batches:
        rows, out, counted, chars = [], [], -1, None
        for first, data, offs, words, start, end, counts in _words(batch.column(1)):
            ends = np.cumsum(counts)
            for row, t, lo, hi in candidates(index, words, counts):
                begin, stop = int(ends[row] - counts[row]), int(ends[row])
                template, side = index.words[t], index.side[t]
                a = max(begin, lo - side)
                part = words[a: min(stop, hi + len(template) + side)]
                reach = side + (hi - lo + 1) // 2
                for x0, x1, equal in matches(part, template, (lo + hi) // 2 - a, reach, index.need[t]):
                    x0, x1 = x0 + a, x1 + a
                    base = int(offs[row])
                    if counted != first + row:  # code points up to each byte of the text, once for all its matches
                        counted, chars = first + row, np.cumsum((data[base: int(offs[row + 1])] & 0xC0) != 0x80, dtype=np.int32)
                    s = int(chars[start[x0] - base]) - 1
                    rows.append(first + row)
                    out.append((index.names[t], x0 - begin, x1 - begin, s, int(chars[end[x1 - 1] - 1 - base]), equal, len(template), equal / len(template)))
        cols = list(zip(*out)) if out else [[]] * 8
        found = pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(rows, pa.int64())), batch.column(2).take(pa.array(rows, pa.int64())), pa.array(cols[0], pa.string()),
             *(pa.array(c, pa.int64()) for c in cols[1:7]), pa.array(cols[7], pa.float64())],
            ["doc_id", "row", "template", "start_word", "end_word", "start", "end", "matched", "template_words", "coverage"])
        yield _best(found) if alone else found


def _best(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Drop matches that overlap a better one of the same row; the batch holds all matches of its rows."""
    row, name = batch.column(1).to_pylist(), batch.column(2).to_pylist()
    first, last, s, e, n, size = (batch.column(i).to_pylist() for i in (3, 4, 5, 6, 7, 8))
    worth = [3 * n[i] - size[i] - (last[i] - first[i]) for i in range(len(row))]
    keep, taken, own = [], [], None
    for i in sorted(range(len(row)), key=lambda i: (row[i], -worth[i], -n[i], name[i], s[i])):
        if row[i] != own:
            own, taken = row[i], []
        if all(e[i] <= a or b <= s[i] for a, b in taken):
            taken.append((s[i], e[i]))
            keep.append(i)
    return batch.take(pa.array(sorted(keep, key=lambda i: (row[i], s[i])), pa.int64()))


def read_templates(spark: SparkSession, folder: str, most_bytes: int = 64 << 20) -> dict[str, str]:
    """{file name without its ending: text} of a folder of licence texts; raises where they are over ``most_bytes``."""
    files = spark.read.option("recursiveFileLookup", "true").text(folder, wholetext=True).select(
        F.regexp_extract(F.col("_metadata.file_name"), r"^(.+?)(\.[A-Za-z]+)?$", 1).alias("name"), "value", F.octet_length("value").alias("n"))
    size = files.agg(F.sum("n")).first()[0] or 0
    if size > most_bytes:
        raise ValueError(f"{size} bytes of templates; the bound is {most_bytes}")
    return {r["name"]: r["value"] for r in files.collect()}


def scan(docs: DataFrame, templates: dict[str, str] | None = None, k: int = K, window: int = WINDOW, band: int = BAND,
         coverage: float = COVERAGE, slice_size: int = SLICE) -> DataFrame:
    """doc_id, template, start_word, end_word, start, end (code points), matched, template_words, coverage per match."""
    small_batches(docs.sparkSession)
    parts, size = [[]], 0
    for name, text in sorted((TEMPLATES if templates is None else templates).items()):
        n = len((text or "").split()) + 1
        if parts[-1] and size + n > slice_size:
            parts.append([])
            size = 0
        parts[-1].append((name, text or ""))
        size += n
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (f"doc_id {kind}, row long, template string, start_word long, end_word long, start long, end long, matched long, "
              "template_words long, coverage double")
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    found = [rows.mapInArrow(partial(_scan, Index(p, k, window, band, coverage), len(parts) == 1), schema) for p in parts]
    if len(found) == 1:
        best = found[0]
    else:
        best = (reduce(DataFrame.union, found).groupBy("row")
                .applyInArrow(lambda group: pa.Table.from_batches([_best(b) for b in group.combine_chunks().to_batches()], group.schema), schema))
    return best.drop("row")
