"""Small string helpers shared by parsers, prompts and profiles.

Each helper returns a native Column expression (no Python UDF); the ``*_sql``
twins give the same expression in DuckDB SQL for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# White space as Python's ``str.split`` and ``str.strip`` know it (fixed values), for Java and for RE2.
# (?U): \s is Unicode white space, which the separators 1c-1f are not.
SPACE = r"(?U)[\s\x1c-\x1f]"
WORD = r"(?U)[^\s\x1c-\x1f]+"
SPACE_SQL = (r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pystrip(c: Column | str) -> Column:
    """Python ``str.strip()``: remove leading and trailing white space."""
    return F.regexp_replace(col(c), f"^{SPACE}+|{SPACE}+$", "")


def pystrip_sql(e: str) -> str:
    return f"regexp_replace({e}, '^{SPACE_SQL}+|{SPACE_SQL}+$', '', 'g')"


def strip_dots(c: Column | str) -> Column:
    """Python ``str.strip('.')``."""
    return F.regexp_replace(col(c), r"^\.+|\.+$", "")


def strip_dots_sql(e: str) -> str:
    return f"regexp_replace({e}, '^\\.+|\\.+$', '', 'g')"


def words(c: Column | str) -> Column:
    """Python ``str.split()``: white-space tokens, no empty ones."""
    return F.filter(F.split(col(c), f"{SPACE}+"), lambda x: x != "")


def words_sql(e: str) -> str:
    return f"list_filter(string_split_regex({e}, '{SPACE_SQL}+'), lambda x: x <> '')"


def first_words(c: Column | str, n: int) -> Column:
    """``str.split()[:n]``; the text behind them is not cut up."""
    return F.slice(F.filter(F.split(col(c), f"{SPACE}+", n + 2), lambda x: x != ""), 1, n)


def first_words_sql(e: str, n: int) -> str:
    return f"{words_sql(e)}[1:{n}]"


def word_count(c: Column | str) -> Column:
    """``len(str.split())``, counted without building the words."""
    return F.regexp_count(col(c), F.lit(WORD))


def word_count_sql(e: str) -> str:
    return f"len({words_sql(e)})"


def after_last(c: Column | str, sep: str) -> Column:
    """``s.split(sep)[-1]``: the text after the last ``sep`` (all of it if absent)."""
    return F.substring_index(col(c), sep, -1)


def after_last_sql(e: str, sep: str) -> str:
    return f"string_split({e}, '{sep}')[-1]"


def head_chars(c: Column | str, n: int) -> Column:
    """``s[:n]``."""
    return F.substring(col(c), 1, n)


def head_chars_sql(e: str, n: int) -> str:
    return f"substring({e}, 1, {n})"


def stringify(c: Column | str) -> Column:
    """``str(x)`` where a missing value prints as ``nan``."""
    return F.coalesce(col(c).cast("string"), F.lit("nan"))


def stringify_sql(e: str) -> str:
    return f"coalesce(CAST({e} AS VARCHAR), 'nan')"
