"""Preference pairs and token encoding.

Pairs are column expressions over a predictions table; the summary is one
conditional aggregate.  The fixed-length encoder builds its vocabulary from
word counts over the whole corpus (a grouped aggregate, pre-aggregated
map-side) and numbers it without a single-partition window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions import prompts as PR
from corpuslens.functions.text import col, first_words, words
from corpuslens.operators.sampling import global_position, with_ranges
from corpuslens.session import materialise

FILTERS = ("all", "mistakes_only", "confident_mistakes")


def mined_pairs(preds: DataFrame, text: str = "text", label: str = "label", pred: str = "pred",
                response: str = "reply", short_form: bool = False) -> DataFrame:
    """prompt / chosen / rejected from the truth; is_correct from the model."""
    truth = col(label) == 1
    if short_form:
        chosen = F.when(truth, F.lit("Yes")).otherwise(F.lit("No"))
        rejected = F.when(truth, F.lit("No")).otherwise(F.lit("Yes"))
    else:
        chosen = F.when(truth, F.lit(PR.PAIR_YES)).otherwise(F.lit(PR.PAIR_NO))
        rejected = F.when(truth, F.lit(PR.PAIR_NO)).otherwise(F.lit(PR.PAIR_YES))
    if short_form:  # second family: zero-shot prompt, no response, sft_correct
        return preds.select(
            "*", PR.prompt_zero_shot(col(text)).alias("prompt"), chosen.alias("chosen"), rejected.alias("rejected"),
            col(label).alias("true_label"), col(pred).alias("sft_prediction"),
            (col(pred) == col(label)).alias("sft_correct"))
    return preds.select(
        "*", PR.prompt_quoted(col(text), 0).alias("prompt"), chosen.alias("chosen"), rejected.alias("rejected"),
        col(label).alias("true_label"), col(pred).alias("sft_prediction"), col(response).alias("sft_response"),
        (col(pred) == col(label)).alias("is_correct"))


def filter_pairs(pairs: DataFrame, strategy: str = "mistakes_only") -> DataFrame:
    """``all`` keeps every pair; ``mistakes_only`` and ``confident_mistakes``
    (which uses no confidence) keep the wrong ones."""
    if strategy not in FILTERS:
        raise ValueError(f"unknown filter strategy {strategy!r}")
    return pairs if strategy == "all" else pairs.where(~F.col("is_correct"))


def pairs_summary(pairs: DataFrame, strategy: str = "mistakes_only", by: list[str] | None = None) -> DataFrame:
    """Counts before and after the filter, accuracy, per-class accuracy and
    the reduction in percent, in one pass."""
    by = by or []
    ok = F.col("is_correct")
    y = F.col("true_label")
    kept = F.count_if(~ok) if strategy != "all" else F.count(F.lit(1))
    n = F.count(F.lit(1))
    pos, neg = F.count_if(y == 1), F.count_if(y == 0)
    return pairs.groupBy(*by).agg(
        F.lit(strategy).alias("filter_strategy"),
        n.alias("total_examples_processed"),
        kept.alias("total_examples_kept"),
        F.when(n > 0, F.count_if(ok) / n).otherwise(F.lit(0.0)).alias("sft_accuracy"),
        F.count_if(ok).alias("correct_predictions"),
        F.count_if(~ok).alias("incorrect_predictions"),
        F.when(pos > 0, F.count_if(ok & (y == 1)) / pos).otherwise(F.lit(0.0)).alias("sarcastic_accuracy"),
        F.when(neg > 0, F.count_if(ok & (y == 0)) / neg).otherwise(F.lit(0.0)).alias("non_sarcastic_accuracy"),
        F.when(n > 0, (1 - kept / n) * 100.0).otherwise(F.lit(0.0)).alias("reduction_pct"))


def synthetic_rich_pairs(df: DataFrame, text: str, label: str, pick: Column) -> DataFrame:
    """Chosen: one of seven reason texts of the true class (picked by ``pick``,
    0..6); rejected: the fixed short opposite answer."""
    positive = F.array(*[F.lit(x) for x in PR.POSITIVE_REASONS])
    lit_ = F.array(*[F.lit(x) for x in PR.NEGATIVE_REASONS])
    idx = (pick + 1).cast("int")
    truth = col(label) == 1
    return df.select("*", PR.prompt_definition(col(text)).alias("prompt"),
                     F.when(truth, F.element_at(positive, idx)).otherwise(F.element_at(lit_, idx)).alias("chosen"),
                     F.when(truth, F.lit(PR.SHORT_NEGATIVE)).otherwise(F.lit(PR.SHORT_POSITIVE))
                     .alias("rejected"))


def synthetic_short_pairs(df: DataFrame, text: str, label: str) -> DataFrame:
    truth = col(label) == 1
    return df.select("*", PR.prompt_quoted(col(text), 2).alias("prompt"),
                     F.when(truth, F.lit("Yes")).otherwise(F.lit("No")).alias("chosen"),
                     F.when(truth, F.lit("No")).otherwise(F.lit("Yes")).alias("rejected"))


# ---------------------------------------------------------------------------
# fixed-length encoding
# ---------------------------------------------------------------------------
PAD_ID, UNK_ID, FIRST_WORD_ID = 0, 1, 2


def build_vocabulary(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, id, n): lower-cased white-space words of the whole corpus, ids
    from 2 in (count desc, word asc) order."""
    tokens = docs.select(F.explode(words(F.lower(col(text)))).alias("word"))
    counts = tokens.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    ranged = with_ranges(counts, [F.desc("n"), F.asc("word")], "_range")
    pos = global_position(ranged, [], -F.col("n"), "word", bucket=F.col("_range"))
    return pos.select("word", (F.col("_pos") + FIRST_WORD_ID - 1).cast("long").alias("id"), "n")


FREQUENT_WORDS, FREQUENT_BYTES = 20_000, 64  # at most so many words of so many bytes are broadcast


def encode_fixed_length(docs: DataFrame, vocab: DataFrame, key: str = "doc_id", text: str = "text",
                        max_length: int = 128) -> DataFrame:
    """input_ids cut / padded to ``max_length`` and the attention mask, one row for every row of
    ``docs``: rows with equal or null keys stay apart.

    Only the first ``max_length`` words of a text can reach the output, so only they are cut
    off, numbered by row and stored.  The most frequent words meet a broadcast of bounded
    size; the others are looked up by a shuffle join (the vocabulary grows with the corpus).
    """
    row, words_ = "_row", "_words"
    heads = materialise(docs.select(F.monotonically_increasing_id().alias(row), col(key).alias("_key"),
                                    first_words(F.lower(col(text)), max_length).alias(words_)))
    vocab = materialise(vocab.select("word", "id"))  # read several times
    tokens = heads.select(row, F.posexplode(words_).alias("pos", "word"))
    often = (F.col("id") < FREQUENT_WORDS + FIRST_WORD_ID) & (F.octet_length("word") <= FREQUENT_BYTES)
    frequent = F.broadcast(vocab.where(often).select("word", "id"))
    known = tokens.join(frequent, "word")
    others = tokens.join(frequent, "word", "left_anti").join(vocab.where(~often).select("word", "id"), "word", "left")
    ided = known.union(others).select(row, F.struct("pos", F.coalesce("id", F.lit(UNK_ID).cast("long")).alias("id")).alias("t"))
    keys = heads.select(row, F.lit(None).cast("struct<pos: int, id: bigint>").alias("t"), F.struct("_key").alias("k"))
    rows = ided.withColumn("k", F.lit(None).cast(keys.schema["k"].dataType)).union(keys)
    per_row = rows.groupBy(row).agg(F.max("k").alias("k"), F.array_sort(F.collect_list("t")).alias("s"))
    ids = F.transform(F.col("s"), lambda x: x["id"])
    pad = F.array_repeat(F.lit(PAD_ID).cast("long"), F.lit(max_length) - F.size(ids))
    return per_row.select(F.col("k._key").alias(key), F.concat(ids, pad).alias("input_ids"),
                          F.concat(F.array_repeat(F.lit(1), F.size(ids)),
                                   F.array_repeat(F.lit(0), F.lit(max_length) - F.size(ids))).alias("attention_mask"))
