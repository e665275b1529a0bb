"""Whitespace tokens, lengths and truncation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def whitespace_tokens(text: Column) -> Column:
    """The non-empty runs between ASCII whitespace.

    The characters are listed because Java matches that faster than ``\\s``.
    """
    return F.array_remove(F.split(text, r"[ \t\n\x0B\f\r]+"), "")


def truncate(tokens: Column, max_length: int) -> Column:
    """The first ``max_length`` tokens."""
    return F.slice(tokens, 1, max_length)
