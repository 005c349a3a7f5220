"""Sketch store against exact statistics; sub-word ids against the tokenizer on whole texts."""

import numpy as np
import pytest

from corpuslens.operators import sketches as SK
from corpuslens.operators.subwords import encode_subwords

pytest.importorskip("tokenizers")


def test_store_grows_by_new_files_only(spark, tmp_path):
    rng = np.random.default_rng(1)
    data = [np.round(rng.lognormal(5, 1.5, 20_000)).astype(int) for _ in range(3)]
    read = []

    def measure(df):
        read.append(sorted(r.file.rsplit("/", 1)[1] for r in df.select("file").distinct().collect()))
        return df

    def put(name, values):
        import pyarrow as pa
        import pyarrow.parquet as pq
        pq.write_table(pa.table({"v": pa.array(values)}), tmp_path / "data" / name)

    (tmp_path / "data").mkdir()
    store, source = str(tmp_path / "store"), str(tmp_path / "data")
    put("a.parquet", data[0])
    put("b.parquet", data[1])
    SK.update_store(spark, store, source, measure, ["v"])
    put("c.parquet", data[2])
    put("none.parquet", np.array([], int))
    held = SK.update_store(spark, store, source, measure, ["v"])
    assert read[0] == ["a.parquet", "b.parquet"] and "a.parquet" not in read[1]
    (got,) = SK.describe_sketches(held).collect()
    everything = np.sort(np.concatenate(data))
    assert got["count"] == len(everything) and got["min"] == everything[0] and got["max"] == everything[-1]
    np.testing.assert_allclose([got["mean"], got["std"]], [everything.mean(), everything.std(ddof=1)], rtol=1e-9)
    for q in (25, 50, 75):
        low, high = (np.searchsorted(everything, got[f"p{q}"], side) / len(everything) for side in ("left", "right"))
        assert low - 0.008 <= q / 100 <= high + 0.008
    put("a.parquet", data[0][:100])  # replaced
    (got,) = SK.describe_sketches(SK.update_store(spark, store, source, measure, ["v"])).collect()
    assert got["count"] == 100 + 40_000


@pytest.mark.parametrize("name,special", [("byte_bpe_50k.json", False), ("byte_bpe_50k.json", True), ("word_bpe_49k.json", True)])
def test_subwords_equal_the_tokenizer_on_whole_texts(spark, name, special):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    texts = ["", None, "  leading  and   inner\n\n space ", "word " * 300, "x" * 3000, "été　ñandú   \t end ", "a b" * 100, "\n" * 400,
             "one two three four five six seven eight nine ten", "12 34! don't " * 40]
    rows = [(i % 4 or None, t) for i, t in enumerate(texts * 2)]
    got = encode_subwords(spark.createDataFrame(rows, "doc_id long, text string"), path, max_length=16, special_tokens=special, pad=7).collect()
    t = Tokenizer.from_file(path)
    t.enable_truncation(16)
    want = []
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=special).ids
        want.append((i, ids + [7] * (16 - len(ids)), [1] * len(ids) + [0] * (16 - len(ids))))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
