"""Sub-word encoding to a fixed length with a given tokenizer file.

The tokenizer (a ``tokenizers`` JSON file) is read once on the driver and travels with the
tasks, so executors need no file.  Ids beyond ``max_length`` cannot reach the output and
every word gives at least one id, so only the first ``max_length`` words of a text are encoded,
with the white space around them; byte-level and word-piece vocabularies split there anyway.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAD_ID = 0


@lru_cache(maxsize=2)
def _tokenizer(definition: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(definition)
    t.no_truncation()
    t.no_padding()
    return t


def _encode(definition: str, max_length: int, pad: int, special: bool, n_keep: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tokenizer = _tokenizer(definition)
    tokenizer.enable_truncation(max_length)
    for batch in batches:
        texts = [t or "" for t in batch.column(n_keep).to_pylist()]
        ids = np.full((len(texts), max_length), pad, np.int32)
        mask = np.zeros((len(texts), max_length), np.int32)
        for i, e in enumerate(tokenizer.encode_batch(texts, add_special_tokens=special)):
            ids[i, : len(e.ids)] = e.ids
            mask[i, : len(e.ids)] = 1
        ends = pa.array(np.arange(0, ids.size + 1, max_length, dtype=np.int32))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:n_keep], *[pa.ListArray.from_arrays(ends, pa.array(x.ravel())) for x in (ids, mask)]],
            [*batch.schema.names[:n_keep], "input_ids", "attention_mask"])


def encode_subwords(docs: DataFrame, tokenizer: str, keep: Sequence[str] = ("doc_id",), text: str = "text",
                    max_length: int = 128, pad: int = PAD_ID, special_tokens: bool = True) -> DataFrame:
    """``keep``, input_ids and attention_mask, one row per row: cut and padded to ``max_length``.

    ``special_tokens`` adds those of the tokenizer's own template, inside the length.  A null
    text is an empty one.  Rows are encoded one by one: repeated ids or texts do not matter.
    """
    from tokenizers import Tokenizer

    definition = Tokenizer.from_file(tokenizer).to_str()
    head = F.regexp_extract(F.col(text), r"^(?U)(?:\s*+\S++){0,%d}+\s*+" % max_length, 0)
    rows = docs.select(*[F.col(c) for c in keep], head.alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(partial(_encode, definition, max_length, pad, special_tokens, len(keep)),
                           f"{schema}, input_ids array<int>, attention_mask array<int>")
