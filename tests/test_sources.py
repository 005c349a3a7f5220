"""CSV dialect of the corpora: quoted multi-line text with doubled quotes."""

import uuid

import pandas as pd

from corpuslens.session import checkpoint_dir
from corpuslens.sources import io


def test_multiline_csv_reads_whole_rows(spark):
    texts = ['plain', 'two\nlines', 'a "quoted" word', 'ends with newline\n', 'comma, inside', '"\n"\n""']
    pdf = pd.DataFrame({"doc_id": range(len(texts)), "class": ["sarc", "notsarc"] * 3, "text": texts})
    path = f"{checkpoint_dir(spark)}/csv-{uuid.uuid4().hex[:8]}.csv"
    pdf.to_csv(path, index=False)
    df = io.read_corpus_csv(spark, path)
    got = {r["doc_id"]: r["text"] for r in df.collect()}
    assert got == dict(enumerate(texts))
    naive = spark.read.option("header", "true").csv(path)  # without multiLine: rows split at newlines
    assert naive.count() > len(texts)


def test_indexed_csv_names_the_index(spark):
    pdf = pd.DataFrame({"tweet": ["a", "b\nc"], **{f: [0, 1] for f in io.CORPUS_C_FLAGS}})
    path = f"{checkpoint_dir(spark)}/csv-{uuid.uuid4().hex[:8]}.csv"
    pdf.to_csv(path)  # pandas writes the index as an unnamed first column
    df = io.read_indexed_csv(spark, path)
    assert df.columns[0] == "row_id"
    assert sorted((r["row_id"], r["tweet"]) for r in df.collect()) == [(0, "a"), (1, "b\nc")]


def test_head_opens_no_more_files_than_it_needs(spark, tmp_path):
    text = "line one\n\"quoted\" line two"
    rows = [(i, "a", text) for i in range(40)]
    io.write_csv(spark.createDataFrame(rows, io.CORPUS_A).orderBy("doc_id").coalesce(1), str(tmp_path / "x"))
    (tmp_path / "x" / "part-9.csv.gz").write_text("this is no gzip file")  # reading it raises
    assert [tuple(r) for r in io.scan_head(spark, str(tmp_path / "x"), io.CORPUS_A, 40).collect()] == rows
    assert io.scan_head(spark, str(tmp_path / "x"), io.CORPUS_A, 0).count() == 0
    (tmp_path / "x" / "part-9.csv.gz").unlink()
    io.write_csv(spark.createDataFrame([(99, "b", "z")], io.CORPUS_A).coalesce(1), str(tmp_path / "y"))
    for f in (tmp_path / "y").glob("part-*"):
        f.rename(tmp_path / "x" / "part-zz.csv")
    got = io.scan_head(spark, str(tmp_path / "x"), io.CORPUS_A, 100).collect()  # goes on with the next file
    assert [r.doc_id for r in got] == [*range(40), 99]


def test_pairs_array_documents_are_bounded(spark, tmp_path):
    rows = [(None if i % 3 else i, "p", "c", "r", 1, 0, None, False, f"é{i}\n\"{'x' * 3000}") for i in range(4000)]
    pairs = spark.createDataFrame(rows, io.PAIRS).repartition(3)
    io.write_pairs_array(pairs, str(tmp_path / "pairs"))
    sizes = [p.stat().st_size for p in (tmp_path / "pairs").rglob("part-*")]
    assert max(sizes) <= (8 << 20) + 2 and len(sizes) == 3
    wide = pairs.union(pairs).union(pairs).coalesce(1)
    io.write_pairs_array(wide, str(tmp_path / "wide"))  # three times the rows: more documents, none larger
    sizes = [p.stat().st_size for p in (tmp_path / "wide").rglob("part-*")]
    assert max(sizes) <= (8 << 20) + 2 and len(sizes) > 3
    back = io.read_pairs_json(spark, str(tmp_path / "wide"), array_file=True)
    assert sorted(map(str, back.collect())) == sorted(map(str, wide.collect()))
    io.write_pairs_array(pairs.limit(0), str(tmp_path / "none"))
    assert io.read_pairs_json(spark, str(tmp_path / "none"), array_file=True).collect() == []


def test_inventory_sizes_are_those_of_the_files(spark, tmp_path):
    import os

    spark.range(1000).repartition(3).write.parquet(str(tmp_path / "t"))
    spark.createDataFrame([], "a int, b string").coalesce(1).write.parquet(str(tmp_path / "none"))
    got = io.source_inventory(spark, {"t": str(tmp_path / "t"), "none": str(tmp_path / "none"), "absent": str(tmp_path / "absent")}).collect()
    files = {str(p): os.path.getsize(p) / (1 << 20) for p in (tmp_path / "t").glob("part-*")}
    found = {"/" + r.file_path.removeprefix("file:").lstrip("/"): r.size_mb for r in got if r.table_name == "t"}
    assert set(found) == set(files) and all(abs(found[p] - files[p]) < 1e-6 for p in files)
    assert sum(r.rows for r in got if r.table_name == "t") == 1000
    assert [(r.present, r.rows) for r in got if r.table_name == "absent"] == [(False, None)]


def test_label_rates_of_empty_and_null_labels(spark):
    a = spark.createDataFrame([(1,), (0,), (None,)], "y int")
    got = {r.table_name: tuple(r)[1:] for r in io.label_rates({"a": (a, "y"), "b": (a.limit(0), "y")}).collect()}
    assert got == {"a": ("y", 2, 1, 0.5), "b": ("y", 0, 0, 0.0)}
