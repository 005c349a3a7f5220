"""Numeric helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslens.functions.text import col


def round_to(c: Column | str, digits: int) -> Column:
    """Round x * 10^digits half away from zero, on its binary value.

    Spark's ``round`` rounds the shortest decimal form of a double (1.0179375
    -> 1.017938) while SQL engines and C round the binary product
    (1.0179374999... -> 1.017937); this form gives the latter, so reports
    agree digit for digit with the SQL oracle.  NaN and infinities pass.
    """
    x = col(c)
    p = float(10 ** digits)
    y = F.abs(x) * p
    # at or above 2^52 a double is already whole (and adding 0.5 would round)
    whole = F.when(y >= float(2 ** 52), y).otherwise(F.floor(y + 0.5))
    # NaN, infinities and products that overflow come back unchanged
    return F.when(F.isnan(x) | (y == float("inf")), x).otherwise(F.signum(x) * whole / p)
