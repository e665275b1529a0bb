"""The chat template that comes with a model, from the settings file of its tokenizer."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import SparkSession

from turnloom.functions.model_template import ModelTemplate, model_template


def load_model_template(spark: SparkSession, path: str, name: str = "default", **variables: Any) -> ModelTemplate:
    """The template and the special tokens in a ``tokenizer_config.json``.

    A file may hold one template or several with names. ``variables`` are options of the template.
    """
    found = spark.read.text(path, wholetext=True).head()
    if found is None:
        raise ValueError(f"{path} is empty")
    settings = json.loads(found[0])
    source = settings.get("chat_template")
    if isinstance(source, list):
        named = {t["name"]: t["template"] for t in source}
        if name not in named:
            raise KeyError(f"no template {name!r} in {path}: there are {sorted(named)}")
        source = named[name]
    if not isinstance(source, str):
        raise KeyError(f"no chat_template in {path}")
    tokens = {}
    for key, value in settings.items():
        text = value.get("content") if isinstance(value, dict) else value
        if key.endswith("_token") and isinstance(text, str):
            tokens[key.removesuffix("_token")] = text
    return model_template(source, tokens, name, **variables)
