"""Queries: sampling, splitting and shuffling (2.3) on corpus A.

The oracle states each rule the plain way (``row_number()`` over the whole
class); the Spark side uses the bucketed exact-n core and must give the
same rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.operators import sampling as S
from corpuslens.plans import fixtures as fx
from corpuslens.plans.fixtures import with_ctes
from corpuslens.plans.registry import query

SEED = 42


def _corpus(spark, sf_dir):
    return fx.corpus_a(spark, sf_dir).select("doc_id", "class")


def _key(seed=SEED, id_sql="doc_id"):
    return S.seed_key_sql(seed, id_sql)


@query("split_per_class", with_ctes(["corpus_a"], f"""
SELECT doc_id, class,
       CASE WHEN row_number() OVER (PARTITION BY class ORDER BY {_key()}, doc_id)
                 <= round_even(count(*) OVER (PARTITION BY class) * CAST(0.8 AS DOUBLE), 0)
            THEN 'train' ELSE 'test' END AS split
FROM corpus_a"""))
def split_per_class_q(spark, sf_dir):
    return S.split_per_class(_corpus(spark, sf_dir), "class", "doc_id", SEED, 0.8)


_STRAT_SQL = f"""
g AS (SELECT class, count(*) AS n FROM corpus_a GROUP BY class),
t AS (SELECT class, n, {{total}} AS total, n / sum(n) OVER () * ({{total}}) AS cont FROM g),
f AS (SELECT class, n, total, cont, floor(cont) AS fl FROM t),
q AS (SELECT class, CAST(fl + CASE WHEN row_number() OVER (ORDER BY cont - fl DESC, class ASC)
                                   <= total - sum(fl) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota FROM f)"""


@query("split_stratified", with_ctes(["corpus_a"], f"""
SELECT c.doc_id, c.class,
       CASE WHEN row_number() OVER (PARTITION BY c.class ORDER BY {_key(id_sql='c.doc_id')}, c.doc_id) <= q.quota
            THEN 'train' ELSE 'test' END AS split
FROM corpus_a c JOIN q ON c.class = q.class""",
    [_STRAT_SQL.format(total="(sum(n) OVER () - ceil(sum(n) OVER () * CAST(0.2 AS DOUBLE)))")]))
def split_stratified_q(spark, sf_dir):
    return S.split_stratified(_corpus(spark, sf_dir), "class", "doc_id", SEED, test_size=0.2)


@query("split_stratified_train_size", with_ctes(["corpus_a"], f"""
SELECT c.doc_id, c.class,
       CASE WHEN row_number() OVER (PARTITION BY c.class ORDER BY {_key(id_sql='c.doc_id')}, c.doc_id) <= q.quota
            THEN 'train' ELSE 'test' END AS split
FROM corpus_a c JOIN q ON c.class = q.class""",
    [_STRAT_SQL.format(total="floor(sum(n) OVER () * CAST(0.8 AS DOUBLE))")]))
def split_stratified_train_size_q(spark, sf_dir):
    return S.split_stratified(_corpus(spark, sf_dir), "class", "doc_id", SEED, test_size=None, train_size=0.8)


@query("split_random", with_ctes(["corpus_a"], f"""
SELECT doc_id, class,
       CASE WHEN row_number() OVER (ORDER BY {_key()}, doc_id)
                 <= round_even(count(*) OVER () * CAST(0.8 AS DOUBLE), 0)
            THEN 'train' ELSE 'test' END AS split
FROM corpus_a"""))
def split_random_q(spark, sf_dir):
    return S.split_random(_corpus(spark, sf_dir), "doc_id", SEED, 0.8)


@query("split_ordinal", with_ctes(["corpus_a"], """
SELECT doc_id, class,
       CASE WHEN row_number() OVER (ORDER BY doc_id) <= floor(count(*) OVER () * CAST(0.9 AS DOUBLE))
            THEN 'train' ELSE 'validation' END AS split
FROM corpus_a"""))
def split_ordinal_q(spark, sf_dir):
    return S.split_ordinal(_corpus(spark, sf_dir), "doc_id", 0.9)


@query("sample_balanced", with_ctes(["corpus_a"], f"""
SELECT doc_id, class FROM corpus_a
QUALIFY row_number() OVER (PARTITION BY class ORDER BY {_key()}, doc_id) <= 200 // 2"""))
def sample_balanced_q(spark, sf_dir):
    return S.sample_balanced(_corpus(spark, sf_dir), "class", "doc_id", 200, SEED)


@query("balance_to_minority", with_ctes(["corpus_a"], f"""
SELECT doc_id, class FROM corpus_a
QUALIFY row_number() OVER (PARTITION BY class ORDER BY {_key()}, doc_id)
        <= least((SELECT min(n) FROM (SELECT count(*) AS n FROM corpus_a GROUP BY class)), 1000 // 2)"""))
def balance_to_minority_q(spark, sf_dir):
    return S.balance_to_minority(_corpus(spark, sf_dir), "class", "doc_id", 1000, SEED)


@query("sample_random", with_ctes(["corpus_a"], f"""
SELECT doc_id, class FROM corpus_a
QUALIFY row_number() OVER (ORDER BY {_key()}, doc_id) <= 100"""))
def sample_random_q(spark, sf_dir):
    return S.sample_random(_corpus(spark, sf_dir), "doc_id", 100, SEED)


@query("sample_multi_seed", with_ctes(["corpus_a"], f"""
SELECT doc_id, class, CAST(run AS INTEGER) AS run, CAST(run * 100 AS INTEGER) AS seed
FROM corpus_a CROSS JOIN range(5) AS r(run)
QUALIFY row_number() OVER (PARTITION BY run ORDER BY {_key('run * 100')}, doc_id) <= 50"""))
def sample_multi_seed_q(spark, sf_dir):
    return S.sample_multi_seed(_corpus(spark, sf_dir), "doc_id", 50, runs=5, seed_step=100)


@query("shuffle_seeded", with_ctes(["corpus_a"], f"""
SELECT doc_id, class, row_number() OVER (ORDER BY {_key()}, doc_id) AS position FROM corpus_a"""))
def shuffle_seeded_q(spark, sf_dir):
    return S.shuffle_seeded(_corpus(spark, sf_dir), "doc_id", SEED)


@query("head_n", with_ctes(["corpus_a"], """
SELECT doc_id, class FROM corpus_a ORDER BY doc_id LIMIT 5"""))
def head_n_q(spark, sf_dir):
    return S.head_n(_corpus(spark, sf_dir), [F.col("doc_id")], 5)


@query("tail_n", with_ctes(["corpus_a"], """
SELECT doc_id, class FROM corpus_a ORDER BY doc_id DESC LIMIT 5"""))
def tail_n_q(spark, sf_dir):
    return S.tail_n(_corpus(spark, sf_dir), [F.col("doc_id")], 5)


@query("union_splits", with_ctes(["corpus_a"], f"""
SELECT doc_id, class, split,
       row_number() OVER (ORDER BY CASE split WHEN 'train' THEN 0 ELSE 1 END, {_key(7)}, doc_id) AS row_id
FROM (SELECT doc_id, class,
             CASE WHEN row_number() OVER (PARTITION BY class ORDER BY {_key()}, doc_id)
                       <= round_even(count(*) OVER (PARTITION BY class) * CAST(0.8 AS DOUBLE), 0)
                  THEN 'train' ELSE 'test' END AS split
      FROM corpus_a)"""))
def union_splits_q(spark, sf_dir):
    """Train and test appended (train first), renumbered in a seed-7 shuffle
    order inside each part."""
    both = S.split_per_class(_corpus(spark, sf_dir), "class", "doc_id", SEED, 0.8)
    flag = F.when(F.col("split") == "train", F.lit("0")).otherwise(F.lit("1"))
    key = F.concat(flag, S.seed_key(7, "doc_id"))
    out = S.global_position(both, [], key, "doc_id", bucket=F.substring(key, 1, 1 + S.BUCKET_HEX_DIGITS))
    return out.withColumnRenamed("_pos", "row_id").drop("_k")


@query("split_complement", with_ctes(["corpus_a"], f"""
SELECT doc_id, class FROM corpus_a
WHERE doc_id NOT IN (SELECT doc_id FROM corpus_a QUALIFY row_number() OVER (ORDER BY {_key()}, doc_id) <= 100)"""))
def split_complement_q(spark, sf_dir):
    corpus = _corpus(spark, sf_dir)
    first = S.sample_random(corpus, "doc_id", 100, SEED)
    return S.split_complement(corpus, first, "doc_id")
