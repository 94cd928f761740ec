"""A small table with every awkward case."""

from __future__ import annotations

LONG = "lorem ipsum " * 15_000
UNBROKEN = "x" * 60_000
TEXTS = [
    None, "", " \t\n", "one", "a b c d", "The quick brown fox jumps over the lazy dog and runs far away today",
    "The quick brown fox jumps over the lazy dog and runs far away tomorrow", "line one\nline two here\nline one\n\nline two here",
    "a b c d e a b c d e a b c d e f g h", "é ü ß 中文 \U0001f600 <|endoftext|> it's ²½ #$%", LONG, UNBROKEN, "tab\tand\x0bvertical\x0cfeed\r\n",
]


def rows() -> list[tuple]:
    out = [(i, t, "en", "s", 1, "x", "x", "x", "x") for i, t in enumerate(TEXTS)]
    out += [(5, TEXTS[5], "en", "s", 1, "x", "x", "x", "x")]  # a repeated row
    out += [(None, "no number here at all", None, None, None, None, None, None, None), (100, TEXTS[6], None, "s", 1, "y", "y", "y", "y")]
    return out


SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, n_tokens string, score string, shard string, hits string")


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
