"""Small column helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, SparkSession, functions as F

BLANKS = " \t\r\n\x0b\x0c"


def c(value: Column | str) -> Column:
    """A column given as name or expression."""
    return value if isinstance(value, Column) else F.col(value)


def strip(col: Column | str) -> Column:
    return F.btrim(c(col), F.lit(BLANKS))


def present(col: Column | str) -> Column:
    """NULL for an empty string."""
    col = c(col)
    return F.when(col != "", col)


def first_present(*cols: Column | str) -> Column:
    """First value that is neither NULL nor empty text (prj_first_present)."""
    return F.coalesce(*[present(c(x).cast("string")) for x in cols])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once and use it many times in ``body``.

    Without it every use repeats the whole expression, in the plan and at run time.
    """
    return F.get(F.transform(F.array(value), body), 0)


_BUILT: dict = {}


def built(key: tuple, build: Callable[[], object]):
    """Columns over named columns do not depend on a DataFrame, so the large ones are built once
    per application and used again."""
    session = SparkSession.getActiveSession()
    key = (session.sparkContext.applicationId if session else None, *key)
    if key not in _BUILT:
        _BUILT[key] = build()
    return _BUILT[key]


def sql_text(value) -> str:
    """A constant as SQL text."""
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return str(value)


def lit_map(table: dict) -> Column:
    """A literal map; folded to a constant by the optimizer. One parsed expression is much faster
    to build than a call per entry."""
    return F.expr("map(" + ", ".join(sql_text(x) for pair in table.items() for x in pair) + ")")


def let_sql(value: Column, body: str) -> Column:
    """``let`` with the body as SQL text, ``"x -> ..."``; for large bodies that are used often."""
    return F.get(F.call_function("transform", F.array(value), F.expr(body)), 0)


def lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(lit_map(table), key)


def any_of(flags: Iterable[Column]) -> Column:
    out = F.lit(False)
    for flag in flags:
        out = out | flag
    return out


def contains_any(text: Column, words: Iterable[str]) -> Column:
    return any_of(text.contains(w) for w in words)


def says_any(text: Column, low: Column, words: Iterable[str]) -> Column:
    """Whether a text has one of the words, whole and in any case; ``low`` is the text in lower case.

    A pattern that begins with plain text is searched by leaps, which one of many words is not, so each word has a pattern of
    its own. Other alphabets' letters matter only where there are any.
    """
    words = list(words)
    own = any_of(low.rlike(rf"{w}(?<=\b{w})\b") for w in words)
    return F.when(F.octet_length(text) == F.char_length(text), own).otherwise(
        text.rlike(rf"(?iU)\b({'|'.join(words)})\b"))


def group(col: Column, pattern: str, n: int = 1) -> Column:
    """Capture group, NULL when it is empty or nothing matched."""
    return present(F.regexp_extract(col, pattern, n))
