"""The same jobs over files that keep arriving.

Each run handles the files that came since the last one and stops. The stream's
checkpoint records what is done, so a run that was cut off goes on where it
stopped: rendered files are not rendered twice, and a batch of generations that
was committed is never generated again.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from turnloom.functions.templates import ChatTemplate
from turnloom.operators.inference import BATCH_SIZE, GeneratorFactory, build_prompts, generate
from turnloom.operators.layout import to_content


def new_files(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    fmt: str = "parquet",
    files_per_batch: int | None = None,
    **options: str,
) -> DataFrame:
    """A stream over the files of ``path``."""
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def render_new(
    stream: DataFrame,
    out: str,
    checkpoint: str,
    template: str | ChatTemplate = "none",
    text_field: str | None = None,
    key: Sequence[str] = (),
) -> None:
    """Append ``key..., content`` of all new rows to the parquet folder ``out``."""
    _run(to_content(stream, template, text_field, key), out, checkpoint)


def generate_new(
    stream: DataFrame,
    out: str,
    checkpoint: str,
    generator: GeneratorFactory,
    key: Sequence[str],
    text: str = "text",
    template: str | ChatTemplate = "chatml",
    returns: str = "text",
    batch_size: int = BATCH_SIZE,
    options: dict[str, Any] | None = None,
) -> None:
    """Append the raw generations of all new rows to ``out``, to be parsed later."""
    prompts = build_prompts(stream, key, text, template)
    _run(generate(prompts, generator, returns, batch_size, options), out, checkpoint)


def _run(stream: DataFrame, out: str, checkpoint: str) -> None:
    query = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(out)
    )
    query.awaitTermination()
