"""Reply parsers: raw model text -> class (1 sarcastic, 0 not, -1 unclear).

Each rule is one native Column expression built from ``lower``, ``contains``,
``startswith``, ``split`` and ``slice``; there is no Python UDF.  The
substring tests are deliberately crude ("no" is found inside "not" and
"know") because that is the behaviour being reproduced.  Every rule has a
``*_sql`` twin for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslens.functions.text import (
    after_last, after_last_sql, col, first_words, first_words_sql, head_chars, head_chars_sql,
    pystrip, pystrip_sql, strip_dots, strip_dots_sql, words, words_sql,
)


def _has(c: Column, s: str) -> Column:
    return c.contains(s)


def _has_sql(e: str, s: str) -> str:
    return f"contains({e}, '{s}')"


# -- contains yes / no, default 0 -------------------------------------------
def parse_contains(reply: Column | str) -> Column:
    r = F.lower(col(reply))
    return F.when(_has(r, "yes"), 1).when(_has(r, "no"), 0).otherwise(0)


def parse_contains_sql(e: str) -> str:
    r = f"lower({e})"
    return f"CASE WHEN {_has_sql(r, 'yes')} THEN 1 WHEN {_has_sql(r, 'no')} THEN 0 ELSE 0 END"


# -- contains yes / no after the last </think>, else unclear -----------------
def _after_think(reply: Column | str) -> Column:
    r = F.lower(pystrip(reply))
    return F.when(r.contains("</think>"), pystrip(after_last(r, "</think>"))).otherwise(r)


def _after_think_sql(e: str) -> str:
    r = f"lower({pystrip_sql(e)})"
    return f"CASE WHEN contains({r}, '</think>') THEN {pystrip_sql(after_last_sql(r, '</think>'))} ELSE {r} END"


def parse_contains_unclear(reply: Column | str) -> Column:
    r = _after_think(reply)
    return F.when(_has(r, "yes"), 1).when(_has(r, "no"), 0).otherwise(-1)


def parse_contains_unclear_sql(e: str) -> str:
    r = _after_think_sql(e)
    return f"CASE WHEN {_has_sql(r, 'yes')} THEN 1 WHEN {_has_sql(r, 'no')} THEN 0 ELSE -1 END"


# -- strict: the whole cleaned reply must be yes / no ------------------------
def strict_clean(reply: Column | str) -> Column:
    return strip_dots(F.lower(pystrip(reply)))


def strict_clean_sql(e: str) -> str:
    return strip_dots_sql(f"lower({pystrip_sql(e)})")


def parse_strict(reply: Column | str) -> Column:
    r = strict_clean(reply)
    return F.when(r == "yes", 1).when(r == "no", 0).otherwise(-1)


def parse_strict_sql(e: str) -> str:
    r = strict_clean_sql(e)
    return f"CASE WHEN {r} = 'yes' THEN 1 WHEN {r} = 'no' THEN 0 ELSE -1 END"


def parse_strict_fallback(reply: Column | str) -> Column:
    """Last-attempt fall-back: contains yes / no in the cleaned reply, else -1."""
    r = strict_clean(reply)
    return F.when(_has(r, "yes"), 1).when(_has(r, "no"), 0).otherwise(-1)


def parse_strict_fallback_sql(e: str) -> str:
    r = strict_clean_sql(e)
    return f"CASE WHEN {_has_sql(r, 'yes')} THEN 1 WHEN {_has_sql(r, 'no')} THEN 0 ELSE -1 END"


# -- starts with yes / no, then key phrases ----------------------------------
def parse_prefix_keywords(reply: Column | str) -> Column:
    r = F.lower(pystrip(reply))
    return (F.when(r.startswith("yes"), 1)
            .when(r.startswith("no"), 0)
            .when(_has(r, "not sarcastic") | _has(r, "not being sarcastic"), 0)
            .when(_has(r, "sarcastic") | F.array_contains(first_words(r, 5), "yes"), 1)
            .otherwise(0))


def parse_prefix_keywords_sql(e: str) -> str:
    r = f"lower({pystrip_sql(e)})"
    return (f"CASE WHEN starts_with({r}, 'yes') THEN 1 WHEN starts_with({r}, 'no') THEN 0 "
            f"WHEN {_has_sql(r, 'not sarcastic')} OR {_has_sql(r, 'not being sarcastic')} THEN 0 "
            f"WHEN {_has_sql(r, 'sarcastic')} OR list_contains({first_words_sql(r, 5)}, 'yes') THEN 1 "
            f"ELSE 0 END")


def parse_prefix_or_phrase(reply: Column | str) -> Column:
    r = F.lower(pystrip(reply))
    positive = r.startswith("yes") | (_has(r, "sarcastic") & ~_has(r, "not sarcastic"))
    negative = r.startswith("no") | _has(r, "not sarcastic")
    return (F.when(positive, 1).when(negative, 0)
            .when(F.array_contains(first_words(r, 5), "yes"), 1).otherwise(0))


def parse_prefix_or_phrase_sql(e: str) -> str:
    r = f"lower({pystrip_sql(e)})"
    return (f"CASE WHEN starts_with({r}, 'yes') OR ({_has_sql(r, 'sarcastic')} AND NOT {_has_sql(r, 'not sarcastic')}) THEN 1 "
            f"WHEN starts_with({r}, 'no') OR {_has_sql(r, 'not sarcastic')} THEN 0 "
            f"WHEN list_contains({first_words_sql(r, 5)}, 'yes') THEN 1 ELSE 0 END")


def parse_phrase(reply: Column | str) -> Column:
    r = F.lower(col(reply))
    return (F.when(_has(r, "sarcastic") & ~_has(r, "not sarcastic"), 1)
            .when(_has(r, "not sarcastic") | F.array_contains(first_words(r, 5), "no"), 0)
            .otherwise(0))


def parse_phrase_sql(e: str) -> str:
    r = f"lower({e})"
    return (f"CASE WHEN {_has_sql(r, 'sarcastic')} AND NOT {_has_sql(r, 'not sarcastic')} THEN 1 "
            f"WHEN {_has_sql(r, 'not sarcastic')} OR list_contains({first_words_sql(r, 5)}, 'no') THEN 0 ELSE 0 END")


# -- the answer after the last "Answer:" --------------------------------------
def answer_text(reply: Column | str) -> Column:
    c = col(reply)
    return F.lower(pystrip(F.when(c.contains("Answer:"), after_last(c, "Answer:")).otherwise(c)))


def answer_text_sql(e: str) -> str:
    return f"lower({pystrip_sql(f'CASE WHEN contains({e}, {chr(39)}Answer:{chr(39)}) THEN {after_last_sql(e, "Answer:")} ELSE {e} END')})"


def parse_after_answer(reply: Column | str) -> Column:
    a = answer_text(reply)
    return F.when(a.startswith("yes"), 1).when(a.startswith("no"), 0).otherwise(0)


def parse_after_answer_sql(e: str) -> str:
    a = answer_text_sql(e)
    return f"CASE WHEN starts_with({a}, 'yes') THEN 1 WHEN starts_with({a}, 'no') THEN 0 ELSE 0 END"


def _first_word(text: Column) -> Column:
    return F.coalesce(F.try_element_at(words(text), F.lit(1)), F.lit(""))


def _first_word_sql(e: str) -> str:
    return f"coalesce({words_sql(e)}[1], '')"


def parse_first_word(reply: Column | str) -> Column:
    a = answer_text(reply)
    w = _first_word(a)
    return (F.when(w.startswith("yes"), 1).when(w.startswith("no"), 0)
            .when(_has(head_chars(a, 20), "yes"), 1).otherwise(0))


def parse_first_word_sql(e: str) -> str:
    a = answer_text_sql(e)
    w = _first_word_sql(a)
    return (f"CASE WHEN starts_with({w}, 'yes') THEN 1 WHEN starts_with({w}, 'no') THEN 0 "
            f"WHEN {_has_sql(head_chars_sql(a, 20), 'yes')} THEN 1 ELSE 0 END")


# -- generated part = response minus the prompt's length ----------------------
def generated_part(response: Column | str, prompt: Column | str) -> Column:
    r, p = col(response), col(prompt)
    return F.lower(pystrip(F.substring(r, F.length(p) + 1, F.greatest(F.length(r), F.lit(1)))))


def generated_part_sql(resp: str, prompt: str) -> str:
    return f"lower({pystrip_sql(f'substring({resp}, length({prompt}) + 1, greatest(length({resp}), 1))')})"


def parse_cut_prompt(response: Column | str, prompt: Column | str) -> Column:
    g = generated_part(response, prompt)
    w = _first_word(g)
    head = head_chars(g, 10)
    return (F.when(w.startswith("yes") | (w == "y"), 1)
            .when(w.startswith("no") | (w == "n"), 0)
            .when(_has(head, "yes"), 1).when(_has(head, "no"), 0).otherwise(0))


def parse_cut_prompt_sql(resp: str, prompt: str) -> str:
    g = generated_part_sql(resp, prompt)
    w = _first_word_sql(g)
    head = head_chars_sql(g, 10)
    return (f"CASE WHEN starts_with({w}, 'yes') OR {w} = 'y' THEN 1 "
            f"WHEN starts_with({w}, 'no') OR {w} = 'n' THEN 0 "
            f"WHEN {_has_sql(head, 'yes')} THEN 1 WHEN {_has_sql(head, 'no')} THEN 0 ELSE 0 END")


# -- bag of the first 15 words, with the input text removed -------------------
# Fixed word lists of the rule.
POSITIVE_WORDS = ["sarcastic", "yes", "ironic", "irony"]
NEGATION_WORDS = ["not", "no"]
LITERAL_WORDS = ["literal", "sincere"]


def parse_word_bag(response: Column | str, text: Column | str) -> Column:
    r0 = F.lower(col(response))
    t = F.lower(col(text))
    r = F.when(r0.contains(t), F.replace(r0, t, F.lit(""))).otherwise(r0)
    w = first_words(r, 15)
    has_pos = F.arrays_overlap(w, F.array(*[F.lit(x) for x in POSITIVE_WORDS]))
    has_not = F.arrays_overlap(w, F.array(*[F.lit(x) for x in NEGATION_WORDS]))
    has_lit = F.arrays_overlap(w, F.array(*[F.lit(x) for x in LITERAL_WORDS]))
    return (F.when(has_pos & ~has_not, 1)
            .when(has_not | has_lit, 0)
            .when(r.contains("this is sarcastic") | head_chars(r, 50).contains("yes"), 1)
            .otherwise(0))


def parse_word_bag_sql(resp: str, text: str) -> str:
    r0, t = f"lower({resp})", f"lower({text})"
    r = f"(CASE WHEN contains({r0}, {t}) THEN replace({r0}, {t}, '') ELSE {r0} END)"
    w = first_words_sql(r, 15)

    def anyof(ws: list[str]) -> str:
        return "(" + " OR ".join(f"list_contains({w}, '{x}')" for x in ws) + ")"

    return (f"CASE WHEN {anyof(POSITIVE_WORDS)} AND NOT {anyof(NEGATION_WORDS)} THEN 1 "
            f"WHEN {anyof(NEGATION_WORDS)} OR {anyof(LITERAL_WORDS)} THEN 0 "
            f"WHEN contains({r}, 'this is sarcastic') OR contains({head_chars_sql(r, 50)}, 'yes') THEN 1 ELSE 0 END")


RULES = {
    "parse_contains": (parse_contains, parse_contains_sql),
    "parse_contains_unclear": (parse_contains_unclear, parse_contains_unclear_sql),
    "parse_strict": (parse_strict, parse_strict_sql),
    "parse_prefix_keywords": (parse_prefix_keywords, parse_prefix_keywords_sql),
    "parse_prefix_or_phrase": (parse_prefix_or_phrase, parse_prefix_or_phrase_sql),
    "parse_phrase": (parse_phrase, parse_phrase_sql),
    "parse_after_answer": (parse_after_answer, parse_after_answer_sql),
    "parse_first_word": (parse_first_word, parse_first_word_sql),
}
