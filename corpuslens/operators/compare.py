"""Ranking and comparison over model result rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_k_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First ``k`` rows of each group in ``order``.

    Written as ``row_number() <= k`` so Catalyst inserts a partial
    WindowGroupLimit before the shuffle: each map task forwards at most k rows
    per group, so a hot group never lands whole in one task.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def custom_order(name: Column | str, order: Sequence[str], unknown: int = 99) -> Column:
    """Position of ``name`` in ``order`` (0-based); unknown names get ``unknown``."""
    c = F.col(name) if isinstance(name, str) else name
    pos = F.array_position(F.array(*[F.lit(x) for x in order]), c)
    return F.when(pos > 0, pos - 1).otherwise(F.lit(unknown)).cast("int")


def custom_order_sql(e: str, order: Sequence[str], unknown: int = 99) -> str:
    lst = "[" + ", ".join(f"'{x}'" for x in order) + "]"
    return f"CAST(CASE WHEN list_position({lst}, {e}) > 0 THEN list_position({lst}, {e}) - 1 ELSE {unknown} END AS INTEGER)"


def rename_models(name: Column | str, mapping: dict[str, str]) -> Column:
    """Display name from a lookup, falling back to the raw name."""
    c = F.col(name) if isinstance(name, str) else name
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(m[c], c)


def rename_models_sql(e: str, mapping: dict[str, str]) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"coalesce(CASE {e} {whens} END, {e})"


def regression_flag(delta_points: Column) -> Column:
    """B - A in points: below -2 regression, above 0 improved, else none."""
    return (F.when(delta_points < -2, F.lit("regression"))
            .when(delta_points > 0, F.lit("improved")).otherwise(F.lit("none")))
