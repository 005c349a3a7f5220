"""Classification metrics as grouped conditional aggregates.

All counts come from one ``groupBy(...).agg`` of ``count_if`` terms, so the
map side pre-aggregates and only one small row per group is shuffled; a hot
group (one model holding a third of all rows) costs nothing extra.
Ratios follow the "0 on a zero denominator" rule.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def safe_div(num: Column, den: Column) -> Column:
    """num / den, or 0.0 when den is 0."""
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def f1_from(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall > 0, 2 * (precision * recall) / (precision + recall)).otherwise(F.lit(0.0))


def confusion_counts(df: DataFrame, by: Sequence[str] = ("model",), pred: str = "pred",
                     label: str = "label") -> DataFrame:
    """TP, FP, TN, FN per group; rows with pred = -1 count in none of them."""
    p, y = F.col(pred), F.col(label)
    return df.groupBy(*by).agg(
        F.count_if((p == 1) & (y == 1)).alias("tp"),
        F.count_if((p == 1) & (y == 0)).alias("fp"),
        F.count_if((p == 0) & (y == 0)).alias("tn"),
        F.count_if((p == 0) & (y == 1)).alias("fn"))


def with_ratios(counts: DataFrame, correct: Column | None = None, valid: Column | None = None) -> DataFrame:
    """Add accuracy, precision, recall, f1 to a frame holding tp/fp/tn/fn."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    correct = correct if correct is not None else tp + tn
    valid = valid if valid is not None else tp + fp + tn + fn
    out = (counts
           .withColumn("accuracy", safe_div(correct, valid))
           .withColumn("precision", safe_div(tp, tp + fp))
           .withColumn("recall", safe_div(tp, tp + fn)))
    return out.withColumn("f1", f1_from(F.col("precision"), F.col("recall")))


def binary_metrics(df: DataFrame, by: Sequence[str] = ("model",), pred: str = "pred",
                   label: str = "label") -> DataFrame:
    """accuracy, precision, recall, F1 (0/1 predictions), with the counts."""
    return with_ratios(confusion_counts(df, by, pred, label))


def metrics_with_unclear(df: DataFrame, by: Sequence[str] = ("model",), pred: str = "pred",
                         label: str = "label") -> DataFrame:
    """The 14-field metric row: -1 predictions are unclear and left out of
    every count and of the accuracy denominator."""
    p, y = F.col(pred), F.col(label)
    counts = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_samples"),
        F.count_if(p != -1).alias("valid_predictions"),
        F.count_if(p == -1).alias("unclear_responses"),
        F.count_if((p != -1) & (p == y)).alias("correct_predictions"),
        F.count_if((p == 1) & (y == 1)).alias("tp"),
        F.count_if((p == 1) & (y == 0)).alias("fp"),
        F.count_if((p == 0) & (y == 0)).alias("tn"),
        F.count_if((p == 0) & (y == 1)).alias("fn"))
    return with_ratios(counts, F.col("correct_predictions"), F.col("valid_predictions"))


def per_class_metrics(df: DataFrame, classes: Sequence[int] = (0, 1), by: Sequence[str] = ("model",),
                      pred: str = "pred", label: str = "label") -> DataFrame:
    """One-vs-rest precision, recall, F1 and support for each class.

    Counts for all classes come out of one aggregate; the class rows are
    produced by ``explode`` of a literal array, not a join.
    """
    p, y = F.col(pred), F.col(label)
    aggs = []
    for k in classes:
        aggs += [F.count_if((p == k) & (y == k)).alias(f"tp_{k}"),
                 F.count_if(p == k).alias(f"pp_{k}"),
                 F.count_if(y == k).alias(f"sup_{k}")]
    wide = df.groupBy(*by).agg(*aggs)
    per = F.explode(F.array(*[F.struct(F.lit(k).alias("cls"), F.col(f"tp_{k}").alias("tp"),
                                       F.col(f"pp_{k}").alias("pp"), F.col(f"sup_{k}").alias("support"))
                              for k in classes]))
    long = wide.select(*by, per.alias("c")).select(*by, "c.*")
    long = long.withColumn("precision", safe_div(F.col("tp"), F.col("pp"))) \
               .withColumn("recall", safe_div(F.col("tp"), F.col("support")))
    return long.withColumn("f1", f1_from(F.col("precision"), F.col("recall"))) \
               .select(*by, F.col("cls").cast("int").alias("cls"), "precision", "recall", "f1", "support")


def classification_report(df: DataFrame, classes: Sequence[int] = (0, 1), names: Sequence[str] | None = None,
                          by: Sequence[str] = ("model",), pred: str = "pred", label: str = "label") -> DataFrame:
    """Per-class rows, plus accuracy, macro avg and weighted avg rows.

    Built from the per-class table (tiny) with window sums per group, so the
    large input is scanned once.
    """
    names = list(names or [str(k) for k in classes])
    pc = per_class_metrics(df, classes, by, pred, label)
    name_map = F.create_map(*[x for k, n in zip(classes, names) for x in (F.lit(k), F.lit(n))])
    pc = pc.withColumn("row_name", name_map[F.col("cls")])
    w = Window.partitionBy(*by)
    total = F.sum("support").over(w)
    pc = (pc.withColumn("n", total)
            .withColumn("acc", F.sum(F.col("recall") * F.col("support")).over(w) / F.col("n")))
    class_rows = pc.select(*by, "row_name", "precision", "recall", "f1", F.col("support").cast("long").alias("support"))
    g = pc.groupBy(*by).agg(
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
        (F.sum(F.col("precision") * F.col("support")) / F.first("n")).alias("wp"),
        (F.sum(F.col("recall") * F.col("support")) / F.first("n")).alias("wr"),
        (F.sum(F.col("f1") * F.col("support")) / F.first("n")).alias("wf"),
        F.first("acc").alias("acc"), F.first("n").alias("n"))
    summary = g.select(*by, F.explode(F.array(
        F.struct(F.lit("accuracy").alias("row_name"), F.lit(None).cast("double").alias("precision"),
                 F.lit(None).cast("double").alias("recall"), F.col("acc").alias("f1"),
                 F.col("n").cast("long").alias("support")),
        F.struct(F.lit("macro avg").alias("row_name"), F.col("mp").alias("precision"), F.col("mr").alias("recall"),
                 F.col("mf").alias("f1"), F.col("n").cast("long").alias("support")),
        F.struct(F.lit("weighted avg").alias("row_name"), F.col("wp").alias("precision"),
                 F.col("wr").alias("recall"), F.col("wf").alias("f1"), F.col("n").cast("long").alias("support")),
    )).alias("s")).select(*by, "s.*")
    return class_rows.unionByName(summary)


def confusion_normalized(df: DataFrame, by: Sequence[str] = ("model",), pred: str = "pred",
                         label: str = "label") -> DataFrame:
    """The four cells TN, FP, FN, TP in percent of their row (label): count / row
    total * 100, 0 for an empty row.  Unclear replies are in no cell."""
    c = confusion_counts(df, by, pred, label)
    cell = lambda y, p, n, other: F.struct(F.lit(y).alias(label), F.lit(p).alias(pred), F.col(n).alias("n"),
                                           (F.col(n) + F.col(other)).alias("row"))
    cells = c.select(*by, F.explode(F.array(cell(0, 0, "tn", "fp"), cell(0, 1, "fp", "tn"),
                                            cell(1, 0, "fn", "tp"), cell(1, 1, "tp", "fn"))).alias("c")).select(*by, "c.*")
    pct = F.when(F.col("row") > 0, F.col("n") / F.col("row") * 100.0).otherwise(F.lit(0.0))
    return cells.withColumn("pct", pct).drop("row")


def per_class_accuracy(df: DataFrame, by: Sequence[str] = ("model",), pred: str = "pred",
                       label: str = "label") -> DataFrame:
    return df.groupBy(*by, label).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col(pred) == F.col(label)).cast("double")).alias("accuracy"))


def error_rate(df: DataFrame, by: Sequence[str] = ("model",), pred: str = "pred",
               label: str = "label") -> DataFrame:
    wrong = F.count_if(F.col(pred) != F.col(label))
    return df.groupBy(*by).agg(wrong.alias("errors"), F.count(F.lit(1)).alias("total"),
                               (wrong / F.count(F.lit(1)) * 100.0).alias("error_pct"))
