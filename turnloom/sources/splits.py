"""Dataset splits as DataFrames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from turnloom.sources.saved import SPLIT_BYTES, find_sections, register_saved_split

DEFAULT_SPLITS = "train,test"  # fixed value

FORMATS = ("parquet", "json", "csv", "text", "orc")

# A quoted CSV field may hold doubled quotes. Pass multiLine="true" if it may also hold line
# breaks: Spark then cannot cut files, and each is one task.
_READ_OPTIONS = {"csv": {"header": "true", "escape": '"'}}


def parse_splits(splits: str = DEFAULT_SPLITS) -> list[str]:
    """``"train, test"`` to ``["train", "test"]``."""
    return [name.strip() for name in splits.split(",")]


def load_split(
    spark: SparkSession,
    base: str,
    split: str,
    fmt: str = "parquet",
    schema: T.StructType | str | None = None,
    **options: str,
) -> DataFrame:
    """Read ``base/split``. A missing path raises; nothing else is tried.

    Give a ``schema`` for large JSON data, which is otherwise read once more to
    find it. Lines of text become the ``text`` column.
    """
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}: use one of {FORMATS}")
    reader = spark.read.format(fmt).options(**{**_READ_OPTIONS.get(fmt, {}), **options})
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.load(f"{base.rstrip('/')}/{split}")
    return df.withColumnRenamed("value", "text") if fmt == "text" else df


def load_saved_split(
    spark: SparkSession,
    base: str,
    split: str,
    schema: T.StructType | str | None = None,
    columns: Sequence[str] | None = None,
    split_bytes: int = SPLIT_BYTES,
) -> DataFrame:
    """Read a split that was saved as a folder of Arrow files, ``base/split``.

    The ``schema`` is that of the first file if none is given; all files are read by it. Only
    ``columns``, if given, are decoded. Files larger than ``split_bytes`` are read by several tasks.
    """
    register_saved_split(spark)
    path = f"{base.rstrip('/')}/{split}"
    if schema is None:
        schema = spark.read.format("saved_split").load(path).schema
    reader = spark.read.format("saved_split").schema(schema).option("sections", find_sections(spark, path, split_bytes))
    if columns is None:
        return reader.load(path)
    found = reader.load(path).schema
    return reader.schema(T.StructType([found[c] for c in columns])).load(path)


def load_splits(
    spark: SparkSession,
    source: str | Mapping[str, DataFrame],
    splits: str = DEFAULT_SPLITS,
    fmt: str = "parquet",
    schema: T.StructType | str | None = None,
    **options: str,
) -> dict[str, DataFrame]:
    """One DataFrame per named split, never unioned, as layouts may differ.

    ``source`` is a folder, or a mapping that already holds the splits.
    ``fmt="saved"`` reads folders of Arrow files.
    """
    names = parse_splits(splits)
    if not isinstance(source, str):
        missing = [name for name in names if name not in source]
        if missing:
            raise KeyError(f"splits {missing} are not among {sorted(source)}")
        return {name: source[name] for name in names}
    if fmt == "saved":
        if options:
            raise ValueError(f"saved splits know no options, but got {sorted(options)}")
        return {name: load_saved_split(spark, source, name, schema) for name in names}
    return {name: load_split(spark, source, name, fmt, schema, **options) for name in names}


def load_eval(
    spark: SparkSession,
    base: str,
    config: str,
    split: str = "validation",
    fmt: str = "parquet",
    text: str = "text",
    **options: str,
) -> DataFrame:
    """Read ``base/config/split``, which must have a text column."""
    df = load_split(spark, f"{base.rstrip('/')}/{config}", split, fmt, **options)
    if text not in df.columns:
        raise KeyError(f"no column {text!r} in the evaluation set: available are {df.columns}")
    return df
