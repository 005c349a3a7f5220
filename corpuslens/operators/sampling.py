"""Exact-count sampling, splitting and shuffling with repeatable seeds.

Contract: the same counts, disjoint and complete splits, and the same rows for
a seed under any partitioning.  Rows are ordered by ``md5('<seed>:<id>')``
(ties by id); a sample of n from a group is the n rows first in that order.
Ids identify rows: rows that share an id are taken or left together.

A null group value is a group like any other in the splits (they stay
complete); the balancing samples, which compare classes with each other, leave
rows without a class out.

How it scales (no group is ever collected into one task):

1. on narrow columns (group, key, id) every row gets a bucket, the first three
   hex digits of its key (4,096 buckets, monotone in the key);
2. a histogram ``(group, bucket) -> rows`` is aggregated map-side: each map
   task forwards at most 4,096 counts per group, so the histogram shuffle
   stays a small fraction of the input even with millions of rows per task;
3. running sums over the histogram give, per group, the *cut* bucket where the
   running count reaches the quota; the same is done once more with the next
   three digits inside it, and the few rows of the second cut (about one in 16
   million of a group) are ranked for the exact last (key, id) taken;
4. one pass over the wide rows compares (key, id) with the group's last one:
   a filter behind one join with a table of one row per group.

That table is broadcast when its measured bytes are few (``session.is_small``);
otherwise the join is left to a shuffle join with AQE skew splitting.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuslens.session import is_small, materialise, null_safe_join

BUCKET_HEX_DIGITS = 3
SMALL_SAMPLE = 100_000
SHUFFLE_HEX_DIGITS = 5  # 1,048,576 buckets of a full shuffle

QuotaFn = Callable[[DataFrame], DataFrame]


# ---------------------------------------------------------------------------
# keys
# ---------------------------------------------------------------------------
def seed_key(seed: int | Column, id_col: str | Column) -> Column:
    """Hex order key ``md5('<seed>:<id>')``."""
    s = F.lit(seed) if isinstance(seed, int) else seed
    i = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat_ws(":", s.cast("string"), i.cast("string")))


def seed_key_sql(seed: int | str, id_sql: str) -> str:
    return f"md5(concat_ws(':', CAST({seed} AS VARCHAR), CAST({id_sql} AS VARCHAR)))"


def hex_bucket(key: Column) -> Column:
    return F.substring(key, 1, BUCKET_HEX_DIGITS)


# ---------------------------------------------------------------------------
# quota rules: (group counts with column _n) -> same frame plus _quota
# ---------------------------------------------------------------------------
def quota_fixed(n: int) -> QuotaFn:
    """min(n, group size)."""
    return lambda g: g.withColumn("_quota", F.least(F.lit(n).cast("long"), F.col("_n")))


def quota_fraction_half_even(frac: float) -> QuotaFn:
    """round(frac * group size), ties to even (pandas ``sample(frac=)``)."""
    return lambda g: g.withColumn("_quota", F.bround(F.col("_n") * F.lit(frac), 0).cast("long"))


def quota_fraction_floor(frac: float) -> QuotaFn:
    """int(group size * frac), truncation."""
    return lambda g: g.withColumn("_quota", F.floor(F.col("_n") * F.lit(frac)).cast("long"))


def quota_to_minority(n: int) -> QuotaFn:
    """Every group cut to min(smallest group size, n // 2)."""
    def fn(g: DataFrame) -> DataFrame:
        smallest = F.min("_n").over(Window.partitionBy(F.lit(0)))  # one row per group: tiny
        return g.withColumn("_quota", F.least(smallest, F.lit(n // 2).cast("long")))
    return fn


def quota_shared_total(total_of: Callable[[Column], Column], by: Sequence[str]) -> QuotaFn:
    """A global total shared over groups by largest remainder.

    Each group gets floor(size / N * total); the rows left over go one each to
    the groups with the largest remainders, ties by group value ascending.
    ``total_of(N)`` gives the total from the overall row count N.
    """
    def fn(g: DataFrame) -> DataFrame:
        everything = Window.partitionBy(F.lit(0))  # one row per group: tiny
        n_all = F.sum("_n").over(everything)
        g = g.withColumn("_total", total_of(n_all).cast("long"))
        g = g.withColumn("_cont", F.col("_n") / n_all * F.col("_total"))
        g = g.withColumn("_floor", F.floor("_cont").cast("long"))
        g = g.withColumn("_left", F.col("_total") - F.sum("_floor").over(everything))
        order = [F.col("_cont") - F.col("_floor")]
        rank = F.row_number().over(everything.orderBy(order[0].desc(), *[F.col(b).asc() for b in by]))
        g = g.withColumn("_quota", F.col("_floor") + F.when(rank <= F.col("_left"), 1).otherwise(0))
        return g.drop("_total", "_cont", "_floor", "_left")
    return fn


# ---------------------------------------------------------------------------
# core
# ---------------------------------------------------------------------------
def _cut(narrow: DataFrame, by: Sequence[str], groups: DataFrame) -> DataFrame:
    """(by, _cut, _need): the bucket ``_b`` in which each group's running count reaches ``_quota``, and
    how many of its rows are still needed."""
    hist = narrow.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    cum = null_safe_join(hist, groups, by).withColumn("_cum", F.sum("_c").over(w))
    cut = cum.where(F.col("_cum") >= F.col("_quota")).groupBy(*by).agg(
        F.min_by(F.struct(F.col("_b").alias("_cut"),
                          (F.col("_quota") - (F.col("_cum") - F.col("_c"))).alias("_need")), "_b").alias("s"))
    return cut.select(*by, "s._cut", "s._need")


def select_by_quota(df: DataFrame, by: Sequence[str], key: Column, tiebreak: str | Column,
                    quota: QuotaFn) -> DataFrame:
    """``df`` plus boolean ``_sel`` and the key ``_k``: the row is among the first ``quota`` rows
    of its group ordered by (key, tiebreak); ``key`` is a hex string."""
    tb = F.col(tiebreak) if isinstance(tiebreak, str) else tiebreak
    whole = not by
    if whole:  # one group: its key is 0 on every row, computed so that the join on it stays a keyed one
        df, by = df.withColumn("_g", F.pmod(F.xxhash64(tb), F.lit(1))), ["_g"]
    by = list(by)
    narrow = df.select(*by, key.alias("_k"), tb.alias("_t")).withColumn("_b", hex_bucket(F.col("_k")))
    sizes = narrow.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n")).groupBy(*by).agg(F.sum("_n").alias("_n"))
    groups = quota(sizes).select(*by, F.least(F.col("_quota"), F.col("_n")).alias("_quota")).where("_quota > 0")
    first = _cut(narrow, by, groups)
    inside = null_safe_join(narrow, first, by, hint=whole).where(F.col("_b") == F.col("_cut"))
    inside = inside.select(*by, "_k", "_t", "_need", F.substring("_k", 1 + BUCKET_HEX_DIGITS, BUCKET_HEX_DIGITS).alias("_b"))
    need = inside.groupBy(*by).agg(F.first("_need").alias("_quota"))
    last = null_safe_join(inside.drop("_need"), _cut(inside, by, need), by).where(F.col("_b") == F.col("_cut"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("_k", "_t"))
    last = last.withColumn("_i", rank).where(F.col("_i") == F.col("_need"))
    last = materialise(last.select(*by, F.struct("_k", "_t").alias("_last")))
    side = whole or is_small(last)
    out = null_safe_join(df.withColumn("_k", key), last, by, "left", hint=side)
    # a group whose quota is 0 has no last row: it takes nothing
    out = out.withColumn("_sel", F.coalesce(F.struct(F.col("_k"), tb.alias("_t")) <= F.col("_last"), F.lit(False))).drop("_last")
    return out.drop("_g") if whole else out


def global_position(df: DataFrame, by: Sequence[str], key: Column, tiebreak: str | Column,
                    bucket: Column | None = None) -> DataFrame:
    """``df`` plus ``_pos``: 1-based position of the row in (key, tiebreak)
    order within its group, computed without a single-partition window:
    bucket offsets from a tiny histogram plus a rank inside each bucket."""
    tb = F.col(tiebreak) if isinstance(tiebreak, str) else tiebreak
    keyed = df.withColumn("_k", key).withColumn("_b", bucket if bucket is not None else hex_bucket(F.col("_k")))
    hist = keyed.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_c"))
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("_b") \
        .rowsBetween(Window.unboundedPreceding, -1)
    offsets = hist.withColumn("_off", F.coalesce(F.sum("_c").over(w), F.lit(0))).drop("_c")
    joined = null_safe_join(keyed, offsets, [*by, "_b"])  # AQE broadcasts the histogram when small
    rank = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_k", tb))
    return joined.withColumn("_pos", F.col("_off") + rank).drop("_b", "_off")


def with_ranges(df: DataFrame, order: Sequence[str | Column], name: str = "_b") -> DataFrame:
    """``df`` plus a range number that is monotone in ``order``.

    Spark's range partitioning takes the edges from a sample of the data, so
    outliers, bunched values and common prefixes still give ranges of like size (equal
    rows share one).  Written once, because a second run could draw other edges."""
    return materialise(df.repartitionByRange(*order).withColumn(name, F.spark_partition_id()))


# ---------------------------------------------------------------------------
# operators
# ---------------------------------------------------------------------------
def _split_col(df: DataFrame, names: tuple[str, str] = ("train", "test")) -> DataFrame:
    return df.withColumn("split", F.when(F.col("_sel"), F.lit(names[0])).otherwise(F.lit(names[1]))) \
             .drop("_sel", "_k")


def split_per_class(df: DataFrame, label: str, id_col: str, seed: int = 42, frac: float = 0.8) -> DataFrame:
    """Inside each class, round(frac * class size) (half-even) rows to train."""
    sel = select_by_quota(df, [label], seed_key(seed, id_col), id_col, quota_fraction_half_even(frac))
    return _split_col(sel)


def split_stratified(df: DataFrame, label: str, id_col: str, seed: int = 42,
                     test_size: float | None = 0.2, train_size: float | None = None) -> DataFrame:
    """Stratified split with a global count shared over classes.

    With ``test_size``: n_test = ceil(test_size * N), n_train = N - n_test.
    With ``train_size``: n_train = floor(train_size * N).  The train count
    is spread over classes by largest remainder (ties by class value).
    """
    if train_size is not None:
        total_of = lambda n: F.floor(n * F.lit(float(train_size)))
    else:
        total_of = lambda n: n - F.ceil(n * F.lit(float(test_size)))
    sel = select_by_quota(df, [label], seed_key(seed, id_col), id_col, quota_shared_total(total_of, [label]))
    return _split_col(sel)


def split_random(df: DataFrame, id_col: str, seed: int = 42, frac: float = 0.8) -> DataFrame:
    sel = select_by_quota(df, [], seed_key(seed, id_col), id_col, quota_fraction_half_even(frac))
    return _split_col(sel)


def split_ordinal(df: DataFrame, order_col: str, ratio: float = 0.9) -> DataFrame:
    """First int(N * ratio) rows in ``order_col`` order to train, rest to validation.

    Positions come from ranges of ``order_col`` with edges drawn from the data
    (``with_ranges``), so an outlier does not put all rows in one range."""
    ranged = with_ranges(df, [order_col], "_range")
    pos = global_position(ranged, [], F.col(order_col), order_col, bucket=F.col("_range"))
    zero = F.pmod(F.xxhash64(order_col), F.lit(1)).alias("_g")  # 0 on every row; see select_by_quota
    total = ranged.groupBy(zero).agg(F.floor(F.count(F.lit(1)) * F.lit(ratio)).alias("_quota"))
    out = null_safe_join(pos.withColumn("_g", zero), total, ["_g"], hint=True)
    return _split_col(out.withColumn("_sel", F.col("_pos") <= F.col("_quota")).drop("_g", "_range", "_pos", "_quota"),
                      ("train", "validation"))


def sample_balanced(df: DataFrame, label: str, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """n // 2 rows of each class (all of a smaller class); rows without a class are left out."""
    sel = select_by_quota(df.where(F.col(label).isNotNull()), [label], seed_key(seed, id_col), id_col, quota_fixed(n // 2))
    return sel.where("_sel").drop("_sel", "_k")


def balance_to_minority(df: DataFrame, label: str, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """Every class cut to min(minority size, n // 2); rows without a class are left out."""
    sel = select_by_quota(df.where(F.col(label).isNotNull()), [label], seed_key(seed, id_col), id_col, quota_to_minority(n))
    return sel.where("_sel").drop("_sel", "_k")


def sample_random(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    if n <= SMALL_SAMPLE:
        small = _small_samples(df, id_col, n, [seed])
        if small is not None:
            return small.drop("_r")
    sel = select_by_quota(df, [], seed_key(seed, id_col), id_col, quota_fixed(n))
    return sel.where("_sel").drop("_sel", "_k")


def _small_samples(df: DataFrame, id_col: str, n: int, seeds: Sequence[int]) -> DataFrame | None:
    """The n rows first in each seed's order, with the seed's number ``_r``, from one scan of ``df``.

    A row takes part in a sample only if its key is under a bound that some more than n
    rows are expected to pass, so rows are not repeated per seed.  The (key, id) at which a sample
    ends is found on counts per (key, id), so many rows of one id are no hot group.  None
    where fewer rows than needed passed (rare: six standard deviations); the exact-n core
    then does the work.
    """
    total = df.count()
    share = min(1.0, (n + 6 * n ** 0.5 + 40) / max(total, 1))
    bound = F.lit("g") if share == 1.0 else F.lit(f"{int(share * 16 ** 12):012x}")
    keys = F.array(*[F.struct(F.lit(r).alias("_r"), seed_key(seed, id_col).alias("_k")) for r, seed in enumerate(seeds)])
    passed = F.filter(keys, lambda x: x["_k"] < bound)
    picked = materialise(df.select("*", F.inline(passed)))
    sums = picked.groupBy("_r", "_k", id_col).agg(F.count(F.lit(1)).alias("_c"))
    run = Window.partitionBy("_r").orderBy("_k", id_col).rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("_cum", F.sum("_c").over(run))
    need = min(n, total)
    ends = sums.where(F.col("_cum") >= need).groupBy("_r").agg(F.min(F.struct(F.col("_k").alias("_lk"), F.col(id_col).alias("_li"))).alias("_last"))
    ends = materialise(ends)
    if need and ends.count() < len(seeds):
        return None
    out = picked.join(F.broadcast(ends), "_r").where(F.struct(F.col("_k").alias("_lk"), F.col(id_col).alias("_li")) <= F.col("_last"))
    return (out if need else picked.limit(0)).select(*df.columns, "_r")


def sample_multi_seed(df: DataFrame, id_col: str, n: int, runs: int, seed_step: int = 100) -> DataFrame:
    """``runs`` samples of n rows, run r drawn with seed r * seed_step.

    Small samples come from one scan; for large ones rows are repeated per run with
    ``explode`` of the short run list (no join) and every run is one group of the exact-n core."""
    if n <= SMALL_SAMPLE:
        small = _small_samples(df, id_col, n, [r * seed_step for r in range(runs)])
        if small is not None:
            return small.withColumnRenamed("_r", "run").withColumn("seed", F.col("run") * seed_step)
    seeds = F.array(*[F.lit(r) for r in range(runs)])
    rep = df.withColumn("run", F.explode(seeds))
    key = seed_key(F.col("run") * seed_step, id_col)
    sel = select_by_quota(rep, ["run"], key, id_col, quota_fixed(n))
    return sel.where("_sel").drop("_sel", "_k").withColumn("seed", F.col("run") * seed_step)


def shuffle_seeded(df: DataFrame, id_col: str, seed: int = 42) -> DataFrame:
    """Full shuffle: rows with their 1-based position in md5(seed:id) order."""
    key = seed_key(seed, id_col)
    pos = global_position(df, [], key, id_col, bucket=F.substring(key, 1, SHUFFLE_HEX_DIGITS))
    return pos.withColumnRenamed("_pos", "position").drop("_k")


def head_n(df: DataFrame, order: Sequence[str | Column], n: int) -> DataFrame:
    """First n rows in ``order`` (TakeOrderedAndProject: a map-side top-n)."""
    return df.orderBy(*order).limit(n)


def tail_n(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """Last n rows in ``order`` (given as ascending columns)."""
    return df.orderBy(*[c.desc() for c in order]).limit(n)


def split_complement(df: DataFrame, part: DataFrame, id_col: str) -> DataFrame:
    """Rows of ``df`` whose id is not in ``part``."""
    return df.join(part.select(id_col), id_col, "left_anti")
