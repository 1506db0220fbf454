"""Column expressions shared by the operators that use no user functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = "[^\\x20\\x09-\\x0D]+"
#: The whitespace characters that end a word, besides the space.
OTHER_SPACES = ("\t", "\n", "\x0b", "\x0c", "\r")


def spaced(text: Column) -> Column:
    """The text with every whitespace character turned into a space; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    for c in OTHER_SPACES:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def words(spaced_text: Column) -> Column:
    """The words of ``spaced`` text, in order."""
    return F.array_remove(F.split(spaced_text, " "), "")


def at(array: Column, i: Column) -> Column:
    return F.get(array, i)


def row_key(key: str = "doc_id", text: str = "text") -> Column:
    """Names a row by its id and text: rows that share an id stay apart, rows equal in both are one."""
    return F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`"))
