"""Fine-tuning data: load, unify the layouts, and split."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.functions.templates import Template
from turnloom.operators.holdout import holdout as hold_out
from turnloom.operators.layout import to_content
from turnloom.sources.splits import DEFAULT_SPLITS, load_splits


def prepare_sft(
    spark: SparkSession,
    source: str | Mapping[str, DataFrame],
    splits: str = DEFAULT_SPLITS,
    template: str | Template = "none",
    text_field: str | None = None,
    key: str | Sequence[str] = (),
    seed: int = 42,
    holdout: float = 0.1,
    fmt: str = "parquet",
    together: str | Sequence[str] = (),
    rejects_path: str | None = None,
    **options: str,
) -> tuple[DataFrame, DataFrame]:
    """``(train, validation)`` with the key columns and one ``content`` column.

    ``test`` is the validation side if it is loaded, else an exact share of
    ``train`` is held out, of which rows that agree in the key columns ``together`` (the parts of a
    conversation) are on one side. Every loaded split must have a usable layout. Messages
    that cannot be rendered fail the job, or with ``rejects_path`` are written
    there with their split and error and left out of both sides.
    """
    keys = [key] if isinstance(key, str) else list(key)
    loaded = load_splits(spark, source, splits, fmt, **options)
    if "train" not in loaded:
        raise KeyError(f"a train split is required, loaded are {list(loaded)}")
    on_error = "raise" if rejects_path is None else "quarantine"
    content = {
        name: to_content(df, template, text_field, keys, on_error=on_error)
        for name, df in loaded.items()
    }
    if rejects_path is not None:
        for name, df in content.items():
            rejected = df.filter(F.col("error").isNotNull()).drop("content")
            rejected.write.parquet(f"{rejects_path}/split={name}")
        content = {n: df.filter(F.col("error").isNull()).drop("error") for n, df in content.items()}

    if "test" in content:
        return content["train"], content["test"]
    return hold_out(content["train"], keys, seed, holdout, together)
