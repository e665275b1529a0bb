"""Source layouts to one ``content`` column."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnloom.functions import chat
from turnloom.functions.model_template import ModelTemplate
from turnloom.functions.templates import Template, get_template

# The recognised layouts, highest priority first.
LAYOUTS = (("messages",), ("dialogue", "soap"), ("question", "answer"))
DEFAULT_TEXT_FIELD = "text"


@dataclass(frozen=True)
class Layout:
    columns: tuple[str, ...]
    templated: bool


def choose_layout(
    columns: Sequence[str], templating: bool, text_field: str | None = None
) -> Layout:
    """Pick the layout from the column names alone; rows never change it."""
    field = text_field or DEFAULT_TEXT_FIELD
    if templating:
        for wanted in LAYOUTS:
            if set(wanted) <= set(columns):
                return Layout(wanted, True)
    if field in columns:
        return Layout((field,), False)
    tried = ([" + ".join(layout) for layout in LAYOUTS] if templating else []) + [field]
    raise KeyError(f"no usable columns: available are {list(columns)}, tried {tried}")


def to_content(
    df: DataFrame,
    template: str | Template = "none",
    text_field: str | None = None,
    key: Sequence[str] = (),
    generation_prompt: bool | str = False,
    on_error: str = "raise",
) -> DataFrame:
    """``key..., content`` from whichever layout ``df`` has.

    ``generation_prompt`` asks for an answer at the end of every conversation, or of
    those where the boolean column of that name is true. Of conversations in parts, which
    have ``part`` and ``is_last``, only the last part is asked.

    Messages that cannot be rendered fail the job. With ``on_error="quarantine"``
    every row stays, and an ``error`` column says why its content is NULL.
    """
    if on_error not in ("raise", "quarantine"):
        raise ValueError(f"on_error must be 'raise' or 'quarantine', not {on_error!r}")
    chat_template = get_template(template)
    layout = choose_layout(df.columns, chat_template is not None, text_field)
    keys = [F.col(k) for k in key]
    if generation_prompt is True and {"part", "is_last"} <= set(df.columns):
        generation_prompt = "is_last"
    asks = F.col(generation_prompt) if isinstance(generation_prompt, str) else F.lit(generation_prompt)

    if not layout.templated:
        content = F.col(layout.columns[0]).alias("content")
        no_error = [F.lit(None).cast("string").alias("error")]
        return df.select(*keys, content, *(no_error if on_error == "quarantine" else []))

    source, messages, reason = _messages(df, layout)
    # Each step is a column of its own, so nothing is parsed or rendered twice.
    read = df.select(*keys, asks.alias("__asks"), source.alias("__source"))
    if isinstance(chat_template, ModelTemplate):
        turns = read.select(*keys, "__asks", messages(F.col("__source")).alias("__messages"))
        wish = generation_prompt if isinstance(generation_prompt, bool) else F.col("__asks")
        failure = chat.refuse if on_error == "raise" else None
        text = chat_template.render(F.col("__messages"), turns.schema["__messages"].dataType, wish, failure)
        whole = F.when(chat.is_conversation(F.col("__messages")), text)
        rendered = turns.select(*keys, whole.alias("content"))
        good = F.col("content").isNotNull()
        if on_error == "raise":
            return rendered.select(*keys, F.when(good, F.col("content")).otherwise(chat.refuse(reason)).alias("content"))
        return rendered.select(*keys, "content", F.when(~good, F.lit(reason)).alias("error"))
    pieces = chat.render_pieces(messages(F.col("__source")), chat_template)
    rendered = read.select(*keys, "__asks", pieces.alias("__pieces"))
    good = chat.is_renderable(F.col("__pieces"))
    text = chat.join_pieces(F.col("__pieces"), chat_template, F.col("__asks"))
    if on_error == "raise":
        failure = F.raise_error(F.lit(reason)).cast("string")
        return rendered.select(*keys, F.when(good, text).otherwise(failure).alias("content"))
    return rendered.select(
        *keys,
        F.when(good, text).alias("content"),
        F.when(~good, F.lit(reason)).alias("error"),
    )


def _messages(
    df: DataFrame, layout: Layout
) -> tuple[Column, Callable[[Column], Column], str]:
    """What to read, how to get messages from it, and what to say if that fails."""
    if layout.columns != ("messages",):
        for name in layout.columns:
            if not isinstance(df.schema[name].dataType, T.StringType):
                raise TypeError(f"column {name} must be a string, not {df.schema[name].dataType}")
        pair = chat.pair_messages(*[F.col(c) for c in layout.columns])
        return pair, _unchanged, "pair cannot be rendered"

    kind = df.schema["messages"].dataType
    if isinstance(kind, T.StringType):
        reason = "messages is not a non-empty JSON array of {role, content} strings"
        return chat.parse_messages(F.col("messages")), chat.parsed_messages, reason
    if isinstance(kind, T.ArrayType) and _has_turns(kind.elementType):
        reason = "messages is null, empty, or has a null role or content"
        return F.col("messages"), _unchanged, reason
    raise TypeError(f"messages must be JSON text or an array of {{role, content}} strings, not {kind}")


def _unchanged(messages: Column) -> Column:
    return messages


def _has_turns(element: T.DataType) -> bool:
    if isinstance(element, T.MapType):
        return isinstance(element.valueType, T.StringType)
    if not isinstance(element, T.StructType) or not {"role", "content"} <= set(element.names):
        return False
    return all(isinstance(element[name].dataType, T.StringType) for name in ("role", "content"))
