"""Records that span lines: the same rows as a one-task reader, with splits of a few kilobytes."""

import csv
import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslens.sources import io
from corpuslens.sources.records import CSV, JSON, read_csv_records, read_json_array, records

NASTY = ['plain', 'quote " inside', '"', '""', '\\', 'ends with \\', '\\"', '{', '}', '[{"a": "}"}]', 'line\nfeed', '\n', 'a\r\nb', ',', '],[', 'é ü', '']


@pytest.fixture(params=[256, 4096, 1 << 27], ids=lambda n: f"splits-{n}")
def split_bytes(spark, request):
    keys = {"spark.sql.files.maxPartitionBytes": str(request.param), "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield request.param
    for k, v in before.items():
        spark.conf.set(k, v)


def texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(NASTY) for _ in range(rng.choice([1, 1, 3, 30, 300 if i % 20 == 0 else 2]))) for i in range(n)]


ELEMENT = T.StructType([T.StructField("i", T.LongType()), T.StructField("text", T.StringType()),
                        T.StructField("deep", T.ArrayType(T.MapType(T.StringType(), T.StringType())))])


@pytest.mark.parametrize("indent", [None, 2])
def test_json_array_document(spark, tmp_path, split_bytes, indent):
    want = [{"i": i, "text": t, "deep": [{t[:3]: "}{"}, {}] if i % 3 else None} for i, t in enumerate(texts(120, 1))]
    (tmp_path / "one.json").write_text(json.dumps(want, indent=indent, ensure_ascii=False))
    got = read_json_array(spark, str(tmp_path / "one.json"), ELEMENT).collect()
    assert sorted([r.asDict() for r in got], key=lambda r: r["i"]) == want
    if split_bytes == 4096:
        tasks = records(spark, str(tmp_path / "one.json"), JSON).select(F.spark_partition_id()).distinct().count()
        assert tasks > 2  # not one task for the file


def test_json_documents_of_several_kinds(spark, tmp_path, split_bytes):
    (tmp_path / "none.json").write_text("[]")
    (tmp_path / "blank.json").write_text(" \n")
    (tmp_path / "spaced.json").write_text('\n [ {"i": 1} ,\n\n{"i": 2, "text": "]}"}\n]\n\n')
    (tmp_path / "lines.json").write_text('{"i": 3}\n{"i": 4, "deep": [{"a": "b"}]}\n')
    (tmp_path / "odd.json").write_text('[{"i": 5}, 17, {"i": 6}, {"i": oops}]')
    got = [r.i for r in read_json_array(spark, str(tmp_path), ELEMENT).collect()]
    assert sorted(x for x in got if x is not None) == [1, 2, 3, 4, 5]
    assert got.count(None) == 2  # 17 with the object after it, and the malformed one


ROW = T.StructType([T.StructField("i", T.LongType()), T.StructField("text", T.StringType()), T.StructField("more", T.StringType())])


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_csv_with_line_feeds_in_quotes(spark, tmp_path, split_bytes, ending):
    rows = [(i, t, "x" if i % 2 else 'say "hi"\n') for i, t in enumerate(texts(120, 2))]
    with open(tmp_path / "one.csv", "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f, lineterminator=ending, quoting=csv.QUOTE_NONNUMERIC)
        w.writerow(["i", "a long\nheader", "more"])
        w.writerows(rows)
    df = read_csv_records(spark, str(tmp_path / "one.csv"), ROW)
    rows = [(i, t or None, m) for i, t, m in rows]  # an empty value is null, as for Spark's own reader
    assert sorted(map(tuple, df.collect())) == rows
    whole = spark.read.schema(ROW).options(header="true", multiLine="true", quote='"', escape='"').csv(str(tmp_path / "one.csv"))
    assert sorted(map(tuple, whole.collect())) == rows


def test_csv_as_spark_writes_it_with_folders(spark, tmp_path, split_bytes):
    rows = [(i, None if i % 7 == 0 else t, "x") for i, t in enumerate(texts(200, 3))]
    df = spark.createDataFrame(rows, ROW).withColumn("part", F.col("i") % 3).repartition(4)
    io.write_csv(df, str(tmp_path / "out"), ["part"])
    back = read_csv_records(spark, str(tmp_path / "out"), ROW)
    assert back.columns == ["i", "text", "more", "part"]
    assert sorted([(r.i, r.text, r.more, r.part) for r in back.collect()], key=str) == sorted([(r[0], r[1] or None, r[2], r[0] % 3) for r in rows], key=str)


def test_csv_of_nothing(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "header.csv").write_text("i,text,more\n")
    (tmp_path / "open.csv").write_text('i,text,more\n1,"never closed\n\n2,x,y')
    assert read_csv_records(spark, str(tmp_path / "empty.csv"), ROW).collect() == []
    assert read_csv_records(spark, str(tmp_path / "header.csv"), ROW).collect() == []
    assert [r.i for r in read_csv_records(spark, str(tmp_path / "open.csv"), ROW).collect()] == [1]
    assert records(spark, str(tmp_path / "header.csv"), CSV).where("first").count() == 1
