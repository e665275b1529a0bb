"""Separate reasoning from answer in generated output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnloom.functions.strings import strip_newlines

# The end-of-reasoning marker as a token id and as text.
END_OF_REASONING_ID = 151668
END_OF_REASONING_TEXT = "</think>"


def strip_prompt_ids(ids: Column, prompt_len: Column) -> Column:
    """Drop the first ``prompt_len`` token ids."""
    return F.slice(ids, prompt_len + F.lit(1), F.greatest(F.size(ids), F.lit(1)))


def split_ids(ids: Column, marker: int = END_OF_REASONING_ID) -> tuple[Column, Column]:
    """``(thinking, output)`` ids, cut behind the last marker.

    The marker stays with the reasoning; without a marker everything is output.
    """
    from_end = F.array_position(F.reverse(ids), F.lit(marker).cast("int"))
    cut = F.when(from_end > 0, F.size(ids) - from_end + F.lit(1)).otherwise(F.lit(0)).cast("int")
    rest = F.greatest(F.size(ids) - cut, F.lit(0))
    return F.slice(ids, F.lit(1), cut), F.slice(ids, cut + F.lit(1), rest)


def split_text(
    text: Column, marker: str = END_OF_REASONING_TEXT, keep_marker: bool = True
) -> tuple[Column, Column]:
    """The text form of :func:`split_ids`; both parts lose outer line feeds."""
    output = F.substring_index(text, marker, -1)
    kept = F.char_length(text) - F.char_length(output)
    if not keep_marker:
        kept = F.greatest(kept - F.lit(len(marker)), F.lit(0))
    thinking = F.substring(text, F.lit(1), kept)
    return strip_newlines(thinking), strip_newlines(output)
