"""Prompt and chat builders as ``concat`` expressions (with DuckDB twins).

The prompt wordings are fixed values: they must equal the texts the
experiments were run with, so they are written out plainly here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslens.functions.text import col

# ---------------------------------------------------------------------------
# Prompt wordings, chat system text, preference-pair answers.
# ---------------------------------------------------------------------------
ZERO_SHOT_HEAD = "Is the following text sarcastic? Answer with only 'Yes' or 'No'.\n\nText: "
ZERO_SHOT_TAIL = "\n\nAnswer:"
# Quoted-text prompts, three wordings (index 0, 1, 2).
QUOTED_HEADS = [
    "Is the following text sarcastic? Answer 'Yes' or 'No'.\n\nText: \"",
    "Is the following text sarcastic? Answer with 'Yes' or 'No'.\n\nText: \"",
    "Is the following text sarcastic? Answer with only 'Yes' or 'No'.\n\nText: \"",
]
QUOTED_TAIL = "\"\n\nAnswer:"
DEFINITION_HEAD = ("Is the following text sarcastic? Sarcasm involves saying the opposite of what is meant, "
                   "often using irony, exaggeration, or mockery.\n\nText: \"")
CHAT_SYSTEM = "You are a helpful assistant that detects sarcasm in text."
CHAT_USER_HEAD = "Is the following text sarcastic? Answer with only 'Yes' or 'No'.\n\nText: "
# Mined pairs, long form and short form.
PAIR_YES = "Yes, this is sarcastic."
PAIR_NO = "No, this is not sarcastic."
# Synthetic rich pairs: seven reasons per class, and the fixed short rejection.
POSITIVE_REASONS = [
    "This text is sarcastic. It uses irony to convey meaning opposite to the literal words.",
    "This is sarcastic. The statement employs exaggeration for humorous or critical effect.",
    "Sarcastic. The text implies the opposite of what's literally stated through tone.",
    "Yes, sarcastic. It contains verbal irony where the intended meaning differs from the literal.",
    "This is sarcastic, using mockery or ridicule disguised as a straightforward statement.",
    "Sarcastic. The exaggerated praise or criticism signals an ironic intent.",
    "Yes. This shows sarcasm through incongruity between literal words and implied meaning.",
]
NEGATIVE_REASONS = [
    "Not sarcastic. This is a straightforward, literal statement with no irony.",
    "No sarcasm. The text conveys its intended meaning directly without hidden implications.",
    "This is not sarcastic. It's a sincere statement meant to be taken at face value.",
    "Not sarcastic. The message is direct and lacks the markers of irony or mockery.",
    "No. This text is literal and doesn't employ irony or exaggeration for effect.",
    "Not sarcastic. The statement is genuine and means exactly what it says.",
    "No sarcasm detected. This is a factual or sincere expression without ironic intent.",
]
SHORT_NEGATIVE = "Not sarcastic."
SHORT_POSITIVE = "This is sarcastic."


def sql_str(s: str) -> str:
    """A DuckDB string literal (newlines spelled with chr(10))."""
    parts = s.replace("'", "''").split("\n")
    return " || chr(10) || ".join(f"'{p}'" for p in parts) if len(parts) > 1 else f"'{parts[0]}'"


def prompt_zero_shot(text: Column | str) -> Column:
    return F.concat(F.lit(ZERO_SHOT_HEAD), col(text), F.lit(ZERO_SHOT_TAIL))


def prompt_zero_shot_sql(e: str) -> str:
    return f"({sql_str(ZERO_SHOT_HEAD)} || {e} || {sql_str(ZERO_SHOT_TAIL)})"


def prompt_sft(text: Column | str, label: Column | str) -> Column:
    answer = F.when(col(label) == 1, F.lit("Yes")).otherwise(F.lit("No"))
    return F.concat(prompt_zero_shot(text), F.lit(" "), answer)


def prompt_sft_sql(text: str, label: str) -> str:
    return f"({prompt_zero_shot_sql(text)} || ' ' || CASE WHEN {label} = 1 THEN 'Yes' ELSE 'No' END)"


def prompt_quoted(text: Column | str, wording: int = 0) -> Column:
    return F.concat(F.lit(QUOTED_HEADS[wording]), col(text), F.lit(QUOTED_TAIL))


def prompt_quoted_sql(e: str, wording: int = 0) -> str:
    return f"({sql_str(QUOTED_HEADS[wording])} || {e} || {sql_str(QUOTED_TAIL)})"


def prompt_quoted_by(text: Column | str, wording: Column) -> Column:
    """Wording picked per row from a column holding 0, 1 or 2."""
    heads = F.array(*[F.lit(h) for h in QUOTED_HEADS])
    return F.concat(F.element_at(heads, (wording + 1).cast("int")), col(text), F.lit(QUOTED_TAIL))


def prompt_quoted_by_sql(text: str, wording: str) -> str:
    heads = "[" + ", ".join(sql_str(h) for h in QUOTED_HEADS) + "]"
    return f"({heads}[{wording} + 1] || {text} || {sql_str(QUOTED_TAIL)})"


def prompt_definition(text: Column | str) -> Column:
    return F.concat(F.lit(DEFINITION_HEAD), col(text), F.lit(QUOTED_TAIL))


def prompt_definition_sql(e: str) -> str:
    return f"({sql_str(DEFINITION_HEAD)} || {e} || {sql_str(QUOTED_TAIL)})"


def chat_messages(text: Column | str, with_system: bool = True) -> Column:
    """array<struct<role, content>>: optional system turn, then the user turn."""
    user = F.struct(F.lit("user").alias("role"), F.concat(F.lit(CHAT_USER_HEAD), col(text)).alias("content"))
    if not with_system:
        return F.array(user)
    system = F.struct(F.lit("system").alias("role"), F.lit(CHAT_SYSTEM).alias("content"))
    return F.array(system, user)


def chat_messages_sql(e: str, with_system: bool = True) -> str:
    user = f"{{'role': 'user', 'content': {sql_str(CHAT_USER_HEAD)} || {e}}}"
    if not with_system:
        return f"[{user}]"
    return f"[{{'role': 'system', 'content': {sql_str(CHAT_SYSTEM)}}}, {user}]"


def render_chat(messages: Column | str, generation_cue: bool = True) -> Column:
    """Plain role-tag template: ``<|role|>\\ncontent\\n`` per message, then the
    assistant cue when asked."""
    body = F.array_join(F.transform(col(messages), lambda m: F.concat(
        F.lit("<|"), m["role"], F.lit("|>\n"), m["content"], F.lit("\n"))), "")
    return F.concat(body, F.lit("<|assistant|>\n")) if generation_cue else body


def render_chat_sql(e: str, generation_cue: bool = True) -> str:
    body = f"array_to_string(list_transform({e}, lambda m: '<|' || m.role || '|>' || chr(10) || m.content || chr(10)), '')"
    return f"({body} || '<|assistant|>' || chr(10))" if generation_cue else body
