"""Schema normalisation, label coding and display projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.text import col

# Fixed label and answer words.
POSITIVE_CLASS = "sarc"
ANSWERS = ("Yes", "No", "Unclear")


def encode_label(c: Column | str) -> Column:
    """'sarc' -> 1, anything else (null too) -> 0."""
    return col(c).eqNullSafe(F.lit(POSITIVE_CLASS)).cast("int")


def map_label(c: Column | str, mapping: dict) -> Column:
    """Dictionary lookup; values missing from ``mapping`` become null."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return m[col(c)]


def decode_prediction(c: Column | str, words: tuple = ANSWERS) -> Column:
    """1 -> words[0], 0 -> words[1], anything else -> words[2]."""
    yes, no, other = words
    other_col = F.lit(other) if other is not None else F.lit(None).cast("string")
    return F.when(col(c) == 1, F.lit(yes)).when(col(c) == 0, F.lit(no)).otherwise(other_col)


def normalize_schema(df: DataFrame, id_col: str | None = None) -> DataFrame:
    """Bring a labelled corpus to ``(id, text, label)``.

    Corpus A has ``class``/``text``, corpus B ``comment``/``label``, corpus C
    ``tweet``/``sarcastic`` with a row index ``_c0``.  Any other layout is an
    error, raised on the driver before a job runs.
    """
    cols = set(df.columns)
    if {"class", "text"} <= cols:
        text, label = F.col("text"), encode_label("class")
    elif {"comment", "label"} <= cols:
        text, label = F.col("comment"), F.col("label").cast("int")
    elif {"tweet", "sarcastic"} <= cols:
        text, label = F.col("tweet"), F.col("sarcastic").cast("int")
    else:
        raise ValueError(f"unknown corpus layout: {sorted(cols)}")
    key = id_col or ("_c0" if "_c0" in cols else None)
    if key is None:
        raise ValueError("an id column is needed: Spark rows have no implicit index")
    return df.select(F.col(key).cast("long").alias("id"), text.alias("text"), label.alias("label"))


def percent_text(fraction: Column) -> Column:
    """x * 100 with one decimal and a percent sign (round half even)."""
    return F.concat(F.regexp_replace(F.format_number(fraction * 100, 1), ",", ""), F.lit("%"))


def signed_points(points: Column) -> Column:
    """Signed one-decimal text: ``+1.5`` / ``-0.3``."""
    body = F.regexp_replace(F.format_number(points, 1), ",", "")
    return F.when(points >= 0, F.concat(F.lit("+"), body)).otherwise(body)


def mean_std_text(mean: Column, std: Column) -> Column:
    """``mean±std`` with one decimal each."""
    return F.concat(F.regexp_replace(F.format_number(mean, 1), ",", ""), F.lit("±"),
                    F.regexp_replace(F.format_number(std, 1), ",", ""))
