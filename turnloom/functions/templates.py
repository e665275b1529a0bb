"""Chat templates as Column builders.

A template turns one ``(role, content)`` pair into a piece of text; a
conversation is its pieces in order. A piece is NULL when the message cannot be
rendered, so one NULL test on the pieces finds every bad message.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnloom.functions.model_template import ModelTemplate

# The special tokens of the two formats.
CHATML_TOKENS = {
    "user": "user",
    "assistant": "assistant",
    "system": "system",
    "eos": "",
    "bos": "<s>",
    "pad": "<pad>",
}
ZEPHYR_TOKENS = {
    "user": "",
    "assistant": "",
    "system": "",
    "eos": "</s>",
    "bos": "<s>",
    "pad": "<pad>",
}


@dataclass(frozen=True)
class ChatTemplate:
    name: str
    piece: Callable[[Column, Column], Column]
    generation_prompt: str
    tokens: Mapping[str, str]

    @property
    def special_tokens(self) -> list[str]:
        """The distinct marker strings, first occurrence first."""
        return list(dict.fromkeys(self.tokens.values()))


def chatml(start: str = "", end: str = "") -> ChatTemplate:
    """``start role \\n content end \\n`` for every role.

    The markers are empty by default. Pass, for example, ``"<|im_start|>"`` and
    ``"<|im_end|>"`` for a model that was trained with them.
    """

    def piece(role: Column, content: Column) -> Column:
        return F.concat(F.lit(start), role, F.lit("\n"), content, F.lit(end + "\n"))

    return ChatTemplate("chatml", piece, start + "assistant\n", CHATML_TOKENS)


def zephyr(
    user: str = "", assistant: str = "", system: str = "", eos: str = ZEPHYR_TOKENS["eos"]
) -> ChatTemplate:
    """``marker \\n content eos \\n`` for the three known roles, nothing for others."""
    markers = {"user": user, "assistant": assistant, "system": system}

    def piece(role: Column, content: Column) -> Column:
        marker = F.lit(None).cast("string")
        for name, text in markers.items():
            marker = F.when(role == name, F.lit(text)).otherwise(marker)
        known = role.isin(*markers)
        return F.when(known, F.concat(marker, F.lit("\n"), content, F.lit(eos + "\n"))).otherwise("")

    tokens = dict(ZEPHYR_TOKENS, eos=eos, **markers)
    return ChatTemplate("zephyr", piece, assistant + "\n", tokens)


TEMPLATES = {"chatml": chatml(), "zephyr": zephyr()}


Template = ChatTemplate | ModelTemplate


def get_template(template: str | Template) -> Template | None:
    """Look a template up; ``"none"`` gives None, an unknown name raises."""
    if isinstance(template, Template):
        return template
    if template == "none":
        return None
    if template not in TEMPLATES:
        raise ValueError(
            f"unknown chat template {template!r}: use one of {sorted(TEMPLATES)}, 'none', "
            "or pass a ChatTemplate or a model_template"
        )
    return TEMPLATES[template]
