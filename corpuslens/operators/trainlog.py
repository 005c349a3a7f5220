"""Training-log analytics with window functions.

Log tables are per run: ``(run, step, ...)`` and ``(run, epoch, ...)``.
Per-step tables are first reduced with grouped aggregates (map-side
combine); windows then run inside ranges of (run, step), not over a whole run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuslens.session import null_safe_join

EPS = 1e-8


def reward_ratio(log: DataFrame, run: str = "run", step: str = "step") -> DataFrame:
    """Per step: mean chosen / (mean rejected + 1e-8)."""
    g = log.groupBy(run, step).agg(F.avg("chosen_reward").alias("chosen_mean"),
                                   F.avg("rejected_reward").alias("rejected_mean"))
    return g.withColumn("reward_ratio", F.col("chosen_mean") / (F.col("rejected_mean") + EPS))


def position_in_group(df: DataFrame, by: list[str], order: str, tiebreak: str | None = None) -> DataFrame:
    """``df`` plus ``_pos``: the exact 1-based position of each row in
    ``order`` within its group (a null group is a group), without ranking a group in one task: ranges
    of (group, order) with edges drawn from the data are the buckets of
    ``sampling.global_position`` (offsets from a small histogram plus a rank
    inside each bucket), so bunched values are spread too."""
    from corpuslens.operators.sampling import global_position, with_ranges

    tb = tiebreak or order
    withb = with_ranges(df, [*by, order, tb], "_bk")
    out = global_position(withb, by, F.col(order), tb, bucket=F.col("_bk"))
    return out.drop("_bk", "_k")


def rolling_drift(per_step: DataFrame, value: str = "chosen_mean", run: str = "run", step: str = "step",
                  window: int = 10) -> DataFrame:
    """Population std of the last ``window`` values (0 with only one).

    A bounded frame without a per-run window: every row gets its exact
    position in the run (``position_in_group``), its value is sent to the
    next ``window`` positions (``explode`` of a short sequence), and each
    position aggregates the at most ``window`` values it received.  No run is
    ever ranked or framed in one task."""
    pos = position_in_group(per_step, [run], step)
    sent = pos.select(run, F.explode(F.sequence(F.col("_pos"), F.col("_pos") + (window - 1))).alias("_pos"),
                      F.col(value).alias("_v"))
    frames = sent.groupBy(run, "_pos").agg(F.stddev_pop("_v").alias("drift"))
    out = null_safe_join(pos, frames, [run, "_pos"])
    return out.withColumn("drift", F.coalesce(F.col("drift"), F.lit(0.0))).drop("_pos")


def log_batch_table(log: DataFrame) -> DataFrame:
    return log.where(F.col("loss").isNotNull()).select("run", "step", "loss", "learning_rate", "epoch")


def epoch_metrics(epochs: DataFrame, log: DataFrame, run: str = "run") -> DataFrame:
    """Each epoch row with the loss of the latest log entry at or before its end step (0 when there is none).

    A segmented scan over log entries and epochs together: rows are cut into ranges of
    (run, step) with edges drawn from the data; the last loss of every range is carried over
    the ranges before an epoch's, and a window inside the range adds the entries before it.
    So neither a run's epochs nor its log pass one task or one value, and nothing is broadcast.

    Of entries with one step the largest loss counts.  Entries without step or loss are no
    entries; an epoch without end step has none before it.  A null run is a run.
    """
    from corpuslens.operators.sampling import with_ranges

    entry = log.where(F.col("loss").isNotNull() & F.col("step").isNotNull()).select(
        run, F.col("step").cast("double").alias("_s"), F.lit(0).alias("_kind"), F.col("loss").alias("_loss"))
    marks = epochs.withColumns({"_s": F.col("end_step").cast("double"), "_kind": F.lit(1)})
    rows = with_ranges(entry.unionByName(marks, allowMissingColumns=True), [run, "_s", "_kind", "_loss"], "_bk")
    at = F.struct("_s", "_loss")
    ranges = rows.groupBy(run, "_bk").agg(F.max(F.when(F.col("_kind") == 0, at)).alias("_end"))
    earlier = Window.partitionBy(run).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(run, "_bk", F.last("_end", ignorenulls=True).over(earlier).alias("_before"))
    inside = Window.partitionBy(run, "_bk").orderBy("_s", "_kind", "_loss").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_in", F.last("_loss", ignorenulls=True).over(inside)).where("_kind = 1")
    found = null_safe_join(rows, ranges, [run, "_bk"])
    loss = F.when(F.col("_s").isNotNull(), F.coalesce("_in", "_before._loss"))
    return found.withColumn("train_loss", F.coalesce(loss, F.lit(0.0))).select(*epochs.columns, "train_loss")


def running_best(df: DataFrame, value: str = "eval_f1", run: str = "run", order: str = "epoch") -> DataFrame:
    """Best value before this row (0 at the start) and a strict new-best flag; a null run is a run.

    A segmented scan rather than a whole-run window: rows are cut into ranges of
    (run, order) with edges drawn from the data; a running max runs over the
    per-(run, range) maxima and a window inside each range adds the rows before
    this one in the same range."""
    from corpuslens.operators.sampling import with_ranges

    b = with_ranges(df, [run, order], "_bk")
    per_bucket = b.groupBy(run, "_bk").agg(F.max(value).alias("_bmax"))
    earlier = Window.partitionBy(run).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = per_bucket.withColumn("_before_bucket", F.max("_bmax").over(earlier)).drop("_bmax")
    inside = Window.partitionBy(run, "_bk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    b = null_safe_join(b, per_bucket, [run, "_bk"]).withColumn("_in_bucket", F.max(value).over(inside))
    prev = F.coalesce(F.greatest("_before_bucket", "_in_bucket"), F.lit(0.0))
    return b.withColumn("best_before", prev).withColumn("is_new_best", F.col(value) > prev) \
            .withColumn("best_so_far", F.greatest(F.col(value), prev)) \
            .drop("_bk", "_before_bucket", "_in_bucket")


def final_epoch(df: DataFrame, run: str = "run", order: str = "epoch") -> DataFrame:
    """The last epoch's row per run."""
    others = [c for c in df.columns if c != run]
    return df.groupBy(run).agg(F.max_by(F.struct(*others), order).alias("_last")).select(run, "_last.*")
