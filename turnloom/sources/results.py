"""The result sink."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_results(df: DataFrame, path: str) -> None:
    """Overwrite ``path`` with JSON Lines: UTF-8 unescaped, null fields kept.

    One directory of part files, written by all tasks, instead of one JSON array.
    """
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
