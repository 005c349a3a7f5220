"""Queries: projections and predicates (2.2), prompts, chats and preference
pairs (2.4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.functions.numeric import round_to
from corpuslens.functions import parsing as P
from corpuslens.functions import prompts as PR
from corpuslens.functions.text import head_chars, stringify, stringify_sql, words_sql
from corpuslens.operators import pairs as PA
from corpuslens.operators import subwords as SW
from corpuslens.operators.compare import custom_order, custom_order_sql, rename_models, rename_models_sql
from corpuslens.operators.normalize import (
    decode_prediction, encode_label, map_label, normalize_schema, percent_text, signed_points,
)
from corpuslens.plans import fixtures as fx
from corpuslens.plans.evaluation import PARSED_CTE, _parsed, metrics_sql
from corpuslens.plans.fixtures import with_ctes
from corpuslens.plans.registry import query
from corpuslens.operators import metrics as M

# Fixed display names and orders of the comparison charts.
DISPLAY_NAMES = {"base": "Base (zero-shot)", "sft": "SFT", "dpo": "SFT + DPO", "gpt4": "GPT-4 (zero-shot)"}
MODEL_ORDER = ["gpt4", "base", "sft", "dpo"]

# ---------------------------------------------------------------------------
# 2.2 projections and predicates
# ---------------------------------------------------------------------------


@query("normalize_schema", with_ctes(["corpus_a", "corpus_b", "corpus_c"], """
SELECT 'A' AS source, CAST(doc_id AS BIGINT) AS id, md5(text) AS text_md5, CAST(class = 'sarc' AS INTEGER) AS label FROM corpus_a
UNION ALL SELECT 'B', doc_id, md5(comment), label FROM corpus_b
UNION ALL SELECT 'C', _c0, md5(tweet), sarcastic FROM corpus_c"""))
def normalize_schema_q(spark, sf_dir):
    parts = [normalize_schema(fx.corpus_a(spark, sf_dir), id_col="doc_id").withColumn("source", F.lit("A")),
             normalize_schema(fx.corpus_b(spark, sf_dir), id_col="doc_id").withColumn("source", F.lit("B")),
             normalize_schema(fx.corpus_c(spark, sf_dir)).withColumn("source", F.lit("C"))]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select("source", "id", F.md5("text").alias("text_md5"), "label")


@query("encode_label", with_ctes(["corpus_a"], """
SELECT doc_id, class, CASE WHEN class = 'sarc' THEN 1 ELSE 0 END AS label FROM corpus_a"""))
def encode_label_q(spark, sf_dir):
    return fx.corpus_a(spark, sf_dir).select("doc_id", "class", encode_label("class").alias("label"))


LANG_CODES = {"en": 0, "de": 1, "fr": 2}


@query("map_label", """
SELECT doc_id, lang, CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 WHEN 'fr' THEN 2 END AS lang_code FROM documents""")
def map_label_q(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents")
    return docs.select("doc_id", "lang", map_label("lang", LANG_CODES).alias("lang_code"))


@query("decode_prediction", with_ctes(["predictions"], """
SELECT model, doc_id, pred,
       CASE pred WHEN 1 THEN 'Yes' WHEN 0 THEN 'No' ELSE 'Unclear' END AS answer,
       CASE pred WHEN 1 THEN 'sarc' WHEN 0 THEN 'notsarc' END AS class_name
FROM parsed""", [PARSED_CTE]))
def decode_prediction_q(spark, sf_dir):
    df = _parsed(spark, sf_dir)
    return df.select("model", "doc_id", "pred", decode_prediction("pred").alias("answer"),
                     decode_prediction("pred", ("sarc", "notsarc", None)).alias("class_name"))


@query("filter_class", with_ctes(["corpus_a"], "SELECT doc_id, class FROM corpus_a WHERE class = 'sarc'"))
def filter_class_q(spark, sf_dir):
    return fx.corpus_a(spark, sf_dir).where(F.col("class") == "sarc").select("doc_id", "class")


@query("filter_in_list", with_ctes(["predictions"], """
SELECT model, accuracy, f1 FROM (""" + metrics_sql("parsed") + """) WHERE model IN ('base', 'sft', 'dpo')""",
    [PARSED_CTE]))
def filter_in_list_q(spark, sf_dir):
    m = M.metrics_with_unclear(_parsed(spark, sf_dir))
    return m.where(F.col("model").isin("base", "sft", "dpo")).select("model", "accuracy", "f1")


@query("filter_name_contains", with_ctes(["predictions"], """
SELECT model, accuracy, (SELECT max(accuracy) FROM m WHERE contains(lower(model), 'gpt')) AS reference_accuracy
FROM m WHERE NOT contains(lower(model), 'gpt')""", [PARSED_CTE, "m AS (" + metrics_sql("parsed") + ")"]))
def filter_name_contains_q(spark, sf_dir):
    """The local models (name without 'gpt', case-blind), with the reference
    model's accuracy beside them."""
    from pyspark.sql.window import Window
    m = M.metrics_with_unclear(_parsed(spark, sf_dir))
    ref = F.lower("model").contains("gpt")
    best = F.max(F.when(ref, F.col("accuracy"))).over(Window.partitionBy())  # one row per model
    return m.withColumn("reference_accuracy", best).where(~ref).select("model", "accuracy", "reference_accuracy")


PAIRED_CTE = """paired AS (
  SELECT a.doc_id, a.label, a.pred AS sft_pred, b.pred AS dpo_pred
  FROM parsed a JOIN parsed b ON a.doc_id = b.doc_id AND a.model = 'sft' AND b.model = 'dpo')"""


@query("filter_outcome_pattern", with_ctes(["predictions"], """
SELECT doc_id, label, sft_pred, dpo_pred FROM paired WHERE label = 1 AND sft_pred = 0 AND dpo_pred = 1""",
    [PARSED_CTE, PAIRED_CTE]))
def filter_outcome_pattern_q(spark, sf_dir):
    from corpuslens.operators.pairing import pair_models
    p = pair_models(_parsed(spark, sf_dir), "sft", "dpo", key="doc_id", value="pred")
    return p.where((F.col("label") == 1) & (F.col("sft_pred") == 0) & (F.col("dpo_pred") == 1)) \
            .select("doc_id", "label", "sft_pred", "dpo_pred")


@query("project_pairs", with_ctes(["corpus_a"], """
SELECT text AS tweet, CAST(class = 'sarc' AS INTEGER) AS sarcastic FROM corpus_a"""))
def project_pairs_q(spark, sf_dir):
    df = fx.corpus_a(spark, sf_dir)
    return df.select(F.col("text").alias("tweet"), encode_label("class").alias("sarcastic"))


@query("text_preview", """
SELECT doc_id, substring(text, 1, 80) AS preview_80, substring(text, 1, 100) AS preview_100,
       substring(text, 1, 150) AS preview_150 FROM documents""")
def text_preview_q(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents")
    return d.select("doc_id", *[head_chars("text", n).alias(f"preview_{n}") for n in (80, 100, 150)])


@query("rename_models", with_ctes(["predictions"], f"""
SELECT model, {rename_models_sql('model', {k: v for k, v in DISPLAY_NAMES.items() if k != 'gpt4'})} AS display_name,
       count(reply) AS replies, count(DISTINCT reply) AS distinct_replies
FROM predictions GROUP BY model"""))
def rename_models_q(spark, sf_dir):
    names = {k: v for k, v in DISPLAY_NAMES.items() if k != "gpt4"}  # gpt4 falls back to its raw name
    counts = fx.predictions(spark, sf_dir).groupBy("model", "reply").agg(F.count("reply").alias("n"))
    return counts.groupBy("model").agg(F.sum("n").alias("replies"), F.count("reply").alias("distinct_replies")) \
                 .select("model", rename_models("model", names).alias("display_name"), "replies", "distinct_replies")


@query("custom_order", with_ctes(["predictions"], f"""
SELECT model, accuracy, {custom_order_sql('model', ['gpt4', 'base', 'sft'])} AS order_pos
FROM ({metrics_sql('parsed')})""", [PARSED_CTE]))
def custom_order_q(spark, sf_dir):
    m = M.metrics_with_unclear(_parsed(spark, sf_dir))
    pos = custom_order("model", ["gpt4", "base", "sft"])  # dpo is unknown -> 99
    return m.select("model", "accuracy", pos.alias("order_pos")).orderBy("order_pos", "model")


@query("percent_format", with_ctes(["predictions"], """
SELECT model, round(accuracy * 100, 1) AS accuracy_pct,
       printf('%.1f%%', accuracy * 100) AS accuracy_text,
       printf('%+.1f', (accuracy - first_value(accuracy) OVER (ORDER BY model ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) * 100) AS delta_text
FROM (""" + metrics_sql("parsed") + ")", [PARSED_CTE]))
def percent_format_q(spark, sf_dir):
    from pyspark.sql.window import Window
    m = M.metrics_with_unclear(_parsed(spark, sf_dir))
    first = F.first("accuracy").over(Window.orderBy("model").rowsBetween(Window.unboundedPreceding, 0))
    return m.select("model", round_to(F.col("accuracy") * 100, 1).alias("accuracy_pct"),
                    percent_text(F.col("accuracy")).alias("accuracy_text"),
                    signed_points((F.col("accuracy") - first) * 100).alias("delta_text"))


@query("stringify_text", f"""
SELECT d.doc_id, {stringify_sql('l.quality')} AS quality_str
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def stringify_text_q(spark, sf_dir):
    """Values printed as text; a missing one (unlabelled doc) prints as 'nan'."""
    docs = fx.table(spark, sf_dir, "documents").select("doc_id")
    labels = fx.table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").select("doc_id", stringify("quality").alias("quality_str"))


# ---------------------------------------------------------------------------
# 2.4 prompts, chats, preference pairs
# ---------------------------------------------------------------------------


@query("prompt_zero_shot", with_ctes(["corpus_a"], f"""
SELECT doc_id, {PR.prompt_zero_shot_sql('text')} AS prompt FROM corpus_a"""))
def prompt_zero_shot_q(spark, sf_dir):
    return fx.corpus_a(spark, sf_dir).select("doc_id", PR.prompt_zero_shot("text").alias("prompt"))


@query("prompt_sft", with_ctes(["corpus_a"], f"""
SELECT doc_id, {PR.prompt_sft_sql('text', "CAST(class = 'sarc' AS INTEGER)")} AS prompt FROM corpus_a"""))
def prompt_sft_q(spark, sf_dir):
    df = fx.corpus_a(spark, sf_dir)
    return df.select("doc_id", PR.prompt_sft("text", encode_label("class")).alias("prompt"))


@query("prompt_quoted", with_ctes(["corpus_a"], f"""
SELECT doc_id, CAST(doc_id % 3 AS INTEGER) AS wording, {PR.prompt_quoted_by_sql('text', 'doc_id % 3')} AS prompt
FROM corpus_a"""))
def prompt_quoted_q(spark, sf_dir):
    df = fx.corpus_a(spark, sf_dir)
    w = (F.col("doc_id") % 3).cast("int")
    return df.select("doc_id", w.alias("wording"), PR.prompt_quoted_by("text", w).alias("prompt"))


@query("prompt_definition", with_ctes(["corpus_a"], f"""
SELECT doc_id, {PR.prompt_definition_sql('text')} AS prompt FROM corpus_a"""))
def prompt_definition_q(spark, sf_dir):
    return fx.corpus_a(spark, sf_dir).select("doc_id", PR.prompt_definition("text").alias("prompt"))


@query("chat_messages", with_ctes(["corpus_a"], f"""
SELECT doc_id, {PR.chat_messages_sql('text', True)} AS messages, {PR.chat_messages_sql('text', False)} AS user_only
FROM corpus_a"""))
def chat_messages_q(spark, sf_dir):
    df = fx.corpus_a(spark, sf_dir)
    return df.select("doc_id", PR.chat_messages("text", True).alias("messages"),
                     PR.chat_messages("text", False).alias("user_only"))


@query("chat_render", f"""
SELECT conv_id, {PR.render_chat_sql('msgs', True)} AS prompt, {PR.render_chat_sql('msgs', False)} AS transcript
FROM (SELECT conv_id, list({{'role': role, 'content': text}} ORDER BY turn) AS msgs
      FROM conversations GROUP BY conv_id)""")
def chat_render_q(spark, sf_dir):
    conv = fx.table(spark, sf_dir, "conversations")
    # one conversation's turns are gathered (bounded by its length), in turn order
    msgs = conv.groupBy("conv_id").agg(F.array_sort(F.collect_list(
        F.struct("turn", F.col("role"), F.col("text").alias("content")))).alias("t"))
    msgs = msgs.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"),
                                                                     x["content"].alias("content"))).alias("msgs"))
    return msgs.select("conv_id", PR.render_chat("msgs", True).alias("prompt"),
                       PR.render_chat("msgs", False).alias("transcript"))


_VOCAB_SQL = f"""
vocab AS (SELECT word, CAST(row_number() OVER (ORDER BY n DESC, word) + 1 AS BIGINT) AS id
          FROM (SELECT word, count(*) AS n
                FROM (SELECT unnest({words_sql('lower(text)')}) AS word
                      FROM documents) GROUP BY word)),
toks AS (SELECT doc_id, w.word, w.pos
         FROM (SELECT doc_id, unnest({words_sql('lower(text)')}[1:128]) AS word,
                      unnest(range(0, len({words_sql('lower(text)')}[1:128]))) AS pos
               FROM documents) w),
ids AS (SELECT t.doc_id, list(coalesce(v.id, 1) ORDER BY t.pos) AS ids
        FROM toks t LEFT JOIN vocab v ON t.word = v.word GROUP BY t.doc_id)"""


@query("encode_fixed_length", f"""
WITH {_VOCAB_SQL}
SELECT d.doc_id,
       list_concat(coalesce(i.ids, []::BIGINT[]), list_transform(range(128 - len(coalesce(i.ids, []::BIGINT[]))), lambda x: 0)) AS input_ids,
       list_concat(list_transform(range(len(coalesce(i.ids, []::BIGINT[]))), lambda x: 1),
                   list_transform(range(128 - len(coalesce(i.ids, []::BIGINT[]))), lambda x: 0)) AS attention_mask
FROM documents d LEFT JOIN ids i ON d.doc_id = i.doc_id""")
def encode_fixed_length_q(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", "text")
    vocab = PA.build_vocabulary(docs)
    return PA.encode_fixed_length(docs, vocab, max_length=128)


@query("encode_subwords")
def encode_subwords_q(spark, sf_dir):
    """Sub-word ids of a public byte-level vocabulary, 128 per text (no oracle: SQL has no tokenizer)."""
    import public_tokenizers

    return SW.encode_subwords(fx.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


MINED_CTE = f"""mined AS (
  SELECT p.doc_id, {PR.prompt_quoted_sql('p.text', 0)} AS prompt,
         CASE WHEN p.label = 1 THEN '{PR.PAIR_YES}' ELSE '{PR.PAIR_NO}' END AS chosen,
         CASE WHEN p.label = 1 THEN '{PR.PAIR_NO}' ELSE '{PR.PAIR_YES}' END AS rejected,
         p.label AS true_label, {P.parse_prefix_keywords_sql('p.reply')} AS sft_prediction, p.reply AS sft_response,
         {P.parse_prefix_keywords_sql('p.reply')} = p.label AS is_correct
  FROM predictions_text p WHERE p.model = 'sft')"""


def _mined(spark, sf_dir):
    preds = fx.predictions_text(spark, sf_dir).where(F.col("model") == "sft")
    preds = preds.withColumn("pred", P.parse_prefix_keywords("reply"))
    return PA.mined_pairs(preds).select("doc_id", "prompt", "chosen", "rejected", "true_label",
                                        "sft_prediction", "sft_response", "is_correct")


@query("pairs_mined", with_ctes(["predictions_text"], """
SELECT doc_id, prompt, chosen, rejected, true_label, sft_prediction, sft_response, is_correct
FROM mined WHERE NOT is_correct""", [MINED_CTE]))
def pairs_mined_q(spark, sf_dir):
    return PA.filter_pairs(_mined(spark, sf_dir), "mistakes_only")


@query("pairs_mined_short", with_ctes(["predictions_text"], f"""
SELECT p.doc_id, {PR.prompt_zero_shot_sql('p.text')} AS prompt,
       CASE WHEN p.label = 1 THEN 'Yes' ELSE 'No' END AS chosen,
       CASE WHEN p.label = 1 THEN 'No' ELSE 'Yes' END AS rejected,
       p.label AS true_label, {P.parse_after_answer_sql('p.reply')} AS sft_prediction,
       {P.parse_after_answer_sql('p.reply')} = p.label AS sft_correct
FROM predictions_text p
WHERE p.model = 'sft' AND {P.parse_after_answer_sql('p.reply')} <> p.label"""))
def pairs_mined_short_q(spark, sf_dir):
    """Second pair family: short Yes / No answers, the after-"Answer:" parser,
    mistakes only."""
    preds = fx.predictions_text(spark, sf_dir).where(F.col("model") == "sft")
    preds = preds.withColumn("pred", P.parse_after_answer("reply"))
    pairs = PA.mined_pairs(preds, short_form=True)
    return pairs.where(~F.col("sft_correct")).select("doc_id", "prompt", "chosen", "rejected", "true_label",
                                                     "sft_prediction", "sft_correct")


SUMMARY_SQL = """
SELECT 'mistakes_only' AS filter_strategy, count(*) AS total_examples_processed,
       count_if(NOT is_correct) AS total_examples_kept,
       CASE WHEN count(*) > 0 THEN count_if(is_correct) / count(*) ELSE 0.0 END AS sft_accuracy,
       count_if(is_correct) AS correct_predictions, count_if(NOT is_correct) AS incorrect_predictions,
       CASE WHEN count_if(true_label = 1) > 0 THEN count_if(is_correct AND true_label = 1) / count_if(true_label = 1) ELSE 0.0 END AS sarcastic_accuracy,
       CASE WHEN count_if(true_label = 0) > 0 THEN count_if(is_correct AND true_label = 0) / count_if(true_label = 0) ELSE 0.0 END AS non_sarcastic_accuracy,
       CASE WHEN count(*) > 0 THEN (1 - count_if(NOT is_correct) / count(*)) * 100.0 ELSE 0.0 END AS reduction_pct
FROM mined"""


@query("pairs_mined_summary", with_ctes(["predictions_text"], SUMMARY_SQL, [MINED_CTE]))
def pairs_mined_summary_q(spark, sf_dir):
    return PA.pairs_summary(_mined(spark, sf_dir), "mistakes_only")


def _reasons_sql(xs):
    return "[" + ", ".join(PR.sql_str(x) for x in xs) + "]"


@query("pairs_synthetic_rich", with_ctes(["corpus_a"], f"""
SELECT doc_id, {PR.prompt_definition_sql('text')} AS prompt,
       CASE WHEN class = 'sarc' THEN {_reasons_sql(PR.POSITIVE_REASONS)}[(doc_id * 31 + 42) % 7 + 1]
            ELSE {_reasons_sql(PR.NEGATIVE_REASONS)}[(doc_id * 31 + 42) % 7 + 1] END AS chosen,
       CASE WHEN class = 'sarc' THEN '{PR.SHORT_NEGATIVE}' ELSE '{PR.SHORT_POSITIVE}' END AS rejected
FROM corpus_a"""))
def pairs_synthetic_rich_q(spark, sf_dir):
    df = fx.corpus_a(spark, sf_dir).withColumn("label", encode_label("class"))
    pick = (F.col("doc_id") * 31 + 42) % 7  # seeded, repeatable pick of a reason
    return PA.synthetic_rich_pairs(df, "text", "label", pick).select("doc_id", "prompt", "chosen", "rejected")


@query("pairs_synthetic_short", with_ctes(["corpus_a"], f"""
SELECT doc_id, {PR.prompt_quoted_sql('text', 2)} AS prompt,
       CASE WHEN class = 'sarc' THEN 'Yes' ELSE 'No' END AS chosen,
       CASE WHEN class = 'sarc' THEN 'No' ELSE 'Yes' END AS rejected
FROM corpus_a"""))
def pairs_synthetic_short_q(spark, sf_dir):
    df = fx.corpus_a(spark, sf_dir).withColumn("label", encode_label("class"))
    return PA.synthetic_short_pairs(df, "text", "label").select("doc_id", "prompt", "chosen", "rejected")


@query("hard_negative_counts", with_ctes(["predictions_text"], """
SELECT count(*) AS hard_negatives, count_if(sft_prediction = 1) AS false_positives,
       count_if(sft_prediction = 0) AS false_negatives
FROM mined WHERE NOT is_correct""", [MINED_CTE]))
def hard_negative_counts_q(spark, sf_dir):
    wrong = PA.filter_pairs(_mined(spark, sf_dir), "mistakes_only")
    return wrong.agg(F.count(F.lit(1)).alias("hard_negatives"),
                     F.count_if(F.col("sft_prediction") == 1).alias("false_positives"),
                     F.count_if(F.col("sft_prediction") == 0).alias("false_negatives"))


@query("hard_easy_ratio", with_ctes(["predictions_text"], """
SELECT count_if(NOT is_correct) AS sft_mistakes, count_if(is_correct) AS sft_correct,
       avg(CAST(NOT is_correct AS DOUBLE)) AS ratio_mistakes, avg(CAST(is_correct AS DOUBLE)) AS ratio_correct
FROM mined""", [MINED_CTE]))
def hard_easy_ratio_q(spark, sf_dir):
    m = _mined(spark, sf_dir)
    ok = F.col("is_correct")
    return m.agg(F.count_if(~ok).alias("sft_mistakes"), F.count_if(ok).alias("sft_correct"),
                 F.avg((~ok).cast("double")).alias("ratio_mistakes"), F.avg(ok.cast("double")).alias("ratio_correct"))
