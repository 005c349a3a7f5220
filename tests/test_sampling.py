"""Properties of the exact-n core: exact counts, disjoint and complete splits,
the same rows for a seed under any partitioning, and a hot class."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpuslens.operators import sampling as S


def _data(spark, n=5000, hot_share=0.9):
    df = spark.range(n).withColumnRenamed("id", "doc_id")
    return df.withColumn("class", F.when(F.col("doc_id") % 100 < hot_share * 100, "hot").otherwise("cold"))


def _brute(df, by, quota_of, seed=42):
    key = S.seed_key(seed, "doc_id")
    w = Window.partitionBy(*by).orderBy(key, "doc_id")
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    return df.withColumn("_rn", F.row_number().over(w)).withColumn("_n", n) \
             .where(F.col("_rn") <= quota_of(F.col("_n"))).select("doc_id")


def test_balanced_sample_is_exact_and_matches_brute_force(spark):
    df = _data(spark)
    got = S.sample_balanced(df, "class", "doc_id", 800, seed=42)
    counts = {r["class"]: r["count"] for r in got.groupBy("class").count().collect()}
    assert counts == {"hot": 400, "cold": 400}
    want = _brute(df, ["class"], lambda n: F.least(F.lit(400), n))
    assert sorted(r[0] for r in got.select("doc_id").collect()) == sorted(r[0] for r in want.collect())


def test_split_is_disjoint_complete_and_partition_invariant(spark):
    df = _data(spark)
    a = S.split_per_class(df, "class", "doc_id", 7, 0.8)
    b = S.split_per_class(df.repartition(13), "class", "doc_id", 7, 0.8)
    ra = {r["doc_id"]: r["split"] for r in a.collect()}
    rb = {r["doc_id"]: r["split"] for r in b.collect()}
    assert len(ra) == 5000 and ra == rb
    hot_train = sum(1 for k, v in ra.items() if v == "train" and k % 100 < 90)
    assert hot_train == round(0.8 * 4500)


def test_stratified_shares_the_global_total(spark):
    df = _data(spark, 1003, 0.7)
    out = S.split_stratified(df, "class", "doc_id", 42, test_size=0.2)
    n_test = out.where(F.col("split") == "test").count()
    import math
    assert n_test == math.ceil(0.2 * 1003)


def test_multi_seed_runs_differ_and_are_exact(spark):
    df = _data(spark, 2000)
    out = S.sample_multi_seed(df, "doc_id", 50, runs=3)
    per = {r["run"]: r["count"] for r in out.groupBy("run").count().collect()}
    assert per == {0: 50, 1: 50, 2: 50}
    ids = [set(r[0] for r in out.where(F.col("run") == k).select("doc_id").collect()) for k in range(3)]
    assert ids[0] != ids[1]


def test_shuffle_positions_are_a_permutation(spark):
    df = _data(spark, 3000)
    pos = S.shuffle_seeded(df, "doc_id", 3).select("position").collect()
    assert sorted(r[0] for r in pos) == list(range(1, 3001))


def test_quota_larger_than_group_takes_all(spark):
    df = _data(spark, 100, 0.5)
    out = S.sample_balanced(df, "class", "doc_id", 1000)
    assert out.count() == 100


def test_small_samples_from_one_scan_equal_the_exact_core(spark, monkeypatch):
    rows = [(i if i % 3 else 42, f"t{i}") for i in range(3000)]  # a third of the rows share one id
    df = spark.createDataFrame(rows, "doc_id long, t string").repartition(7)
    for n in (0, 1, 10, 500, 5000):
        small = S.sample_random(df, "doc_id", n, seed=5)
        many = S.sample_multi_seed(df, "doc_id", n, 3)
        monkeypatch.setattr(S, "SMALL_SAMPLE", -1)
        assert small.columns == df.columns
        assert sorted(map(tuple, small.collect())) == sorted(map(tuple, S.sample_random(df, "doc_id", n, seed=5).collect()))
        core = S.sample_multi_seed(df, "doc_id", n, 3)
        key = lambda d: sorted((r.run, r.seed, r.doc_id, r.t) for r in d.collect())
        assert key(many) == key(core)
        monkeypatch.undo()
    assert S.sample_random(df.limit(0), "doc_id", 5).collect() == []
