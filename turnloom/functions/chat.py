"""Conversations to text, as native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnloom.functions.model_template import ModelTemplate
from turnloom.functions.strings import strip
from turnloom.functions.templates import ChatTemplate, Template

_WRAPPED = "values array<array<struct<role:variant,content:variant>>>, complete boolean"


def parse_messages(text: Column) -> Column:
    """Step one of reading JSON messages; keep the result in a column of its own.

    Spark's JSON reader stops at the end of the first value and would accept
    anything behind it. As the one item of an array in a larger object, such a
    rest is a syntax error or a second item.
    """
    wrapped = F.concat(F.lit('{"values":['), text, F.lit('],"complete":true}'))
    return F.from_json(wrapped, _WRAPPED, {"allowSingleQuotes": "false"})


def parsed_messages(parsed: Column) -> Column:
    """Step two: an array of ``{role, content}``.

    NULL when the text was not exactly one JSON array of objects. A role or content
    that is missing, null or not a JSON string becomes NULL, so rendering rejects it.
    """

    def as_string(value: Column) -> Column:
        return F.when(F.schema_of_variant(value) == "STRING", value.cast("string"))

    def message(m: Column) -> Column:
        return F.struct(
            as_string(m["role"]).alias("role"), as_string(m["content"]).alias("content")
        )

    one_value = parsed["complete"] & (F.size(parsed["values"]) == 1)
    return F.when(one_value, F.transform(F.get(parsed["values"], F.lit(0)), message))


def pair_messages(question: Column, answer: Column) -> Column:
    """A two-turn conversation: NULL counts as empty, both sides are stripped."""

    def side(role: str, text: Column) -> Column:
        content = strip(F.coalesce(text, F.lit("")))
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return F.array(side("user", question), side("assistant", answer))


def prompt_messages(text: Column) -> Column:
    """A one-turn conversation; the text is kept as it is."""
    return F.array(F.struct(F.lit("user").alias("role"), text.alias("content")))


def render_pieces(messages: Column, template: ChatTemplate) -> Column:
    """One rendered string per message, NULL where a message cannot be rendered."""
    return F.transform(messages, lambda m: template.piece(m["role"], m["content"]))


def is_renderable(pieces: Column) -> Column:
    """True when there is at least one message and every message rendered."""
    bad = F.exists(pieces, lambda p: p.isNull())
    return F.coalesce((F.size(pieces) > 0) & ~bad, F.lit(False))


def join_pieces(pieces: Column, template: ChatTemplate, asks: Column) -> Column:
    """The whole text, with the generation prompt at its end where ``asks`` is true."""
    text = F.array_join(pieces, "")
    return F.when(asks, F.concat(text, F.lit(template.generation_prompt))).otherwise(text)


def is_conversation(messages: Column) -> Column:
    """True when there is at least one message and none is missing."""
    return F.coalesce((F.size(messages) > 0) & ~F.exists(messages, lambda m: m.isNull()), F.lit(False))


_TURNS = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))


def refuse(message: str) -> Column:
    return F.raise_error(F.lit(message)).cast("string")


def render_prompt(text: Column, template: Template) -> Column:
    """The inference prompt for one text. NULL text cannot be rendered and raises."""
    if isinstance(template, ModelTemplate):
        prompt = template.render(prompt_messages(text), _TURNS, True, refuse)
    else:
        body = template.piece(F.lit("user"), text)
        prompt = F.concat(body, F.lit(template.generation_prompt))
    return F.when(text.isNotNull(), prompt).otherwise(
        F.raise_error(F.lit("cannot build a prompt from a NULL text")).cast("string")
    )
