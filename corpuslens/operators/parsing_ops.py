"""Row-group operators built on the reply parsers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.parsing import parse_strict, parse_strict_fallback
from corpuslens.functions.text import pystrip


def resolve_attempts(attempts: DataFrame, key: str = "doc_id") -> DataFrame:
    """Up to three tries per item: the first strict yes/no answer wins; if none,
    the last try decides with the contains fall-back, and an error on the last
    try gives -1 with the error text.

    One aggregate per item with ``min_by`` / ``max_by`` (partial aggregation
    map-side); no per-item window and no collected lists.
    """
    strict = parse_strict(F.col("raw_reply"))
    ok = F.col("error").isNull() & (strict != -1)
    g = attempts.groupBy(key).agg(
        F.any_value("label").alias("label"),
        F.min_by(F.when(ok, F.struct(strict.alias("pred"), pystrip("raw_reply").alias("response"),
                                     F.col("attempt").alias("attempt"))),
                 F.when(ok, F.col("attempt"))).alias("first_ok"),
        F.max_by(F.struct("raw_reply", "error", "attempt"), "attempt").alias("last_try"))
    first_ok, last = F.col("first_ok"), F.col("last_try")
    return g.select(
        key, "label",
        F.when(first_ok.isNotNull(), first_ok["pred"])
         .when(last["error"].isNotNull(), F.lit(-1))
         .otherwise(parse_strict_fallback(last["raw_reply"])).alias("pred"),
        F.when(first_ok.isNotNull(), first_ok["response"])
         .when(last["error"].isNotNull(), last["error"])
         .otherwise(pystrip(last["raw_reply"])).alias("response"),
        (F.when(first_ok.isNotNull(), first_ok["attempt"]).otherwise(last["attempt"]) + 1)
        .cast("int").alias("attempts_used"))
