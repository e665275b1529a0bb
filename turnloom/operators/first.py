"""The first N rows in key order."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnloom.operators.holdout import row_hashes, take_by_hash
from turnloom.operators.position import first_in_files
from turnloom.plans.ordered import bucket_bounds, bucket_of
from turnloom.plans.scratch import scratch_table

_SMALL = 1000


def first_n(df: DataFrame, n: int, key: str | Sequence[str] | None = None) -> DataFrame:
    """The ``n`` rows with the smallest keys, or without a key in file order; all rows if there are fewer.

    Rows with one key are ordered by the md5 of the whole row, for every ``n`` and any
    partitioning. The key of the n-th row is found from the keys alone: for a small ``n`` by a top-k, for a large
    one from the counts of key ranges and the keys of one of them. The rows up to it are a plain
    filter, so they never pass through a single task, and only rows with that very key are hashed.
    """
    if key is None:
        return first_in_files(df, n, first_n)
    if n <= 0:
        return df.limit(0)
    keys = [key] if isinstance(key, str) else list(key)
    only = df.select(*keys)
    if n <= _SMALL:
        first = only.orderBy(*keys).limit(n)
        if _is_plain(df, keys):
            found = first.collect()
            if len(found) < n:
                return df
            below, at = _compare(df, keys, first, found[-1][0])
        else:
            greatest = F.max(F.struct(*keys)).alias("key")
            border = scratch_table(first.agg(greatest, F.count("*").alias("n")).select("key.*", "n"), "nth-key")
            if border.head()["n"] < n:
                return df
            below, at = _compare(df, keys, border, None)
        return df.filter(below | at).orderBy(*keys, *row_hashes(df, df.columns, 0)).limit(n)

    border = scratch_table(_nth_key(only, n, keys), "nth-key")
    found = border.head()
    if found is None:
        return df
    below, at = _compare(df, keys, border, found[0])
    if found["taken"] == found["of"]:
        return df.filter(below | at)
    tied, _ = take_by_hash(df.filter(at), df.columns, 0, lambda _: found["taken"])
    return df.filter(below).unionByName(tied)


def _nth_key(only: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """``keys..., taken, of``: the key of the n-th row, how many of its rows are among the first, of how many.

    No row if there are fewer than ``n``. Ranges of the keys come from a sample and their counts, at
    most 16,385, to the driver; the n-th row is then looked for in one of them.
    """
    bucket = bucket_of(F.struct(*keys), bucket_bounds(only, keys)).alias("bucket")
    passed, number = 0, -1
    for number, rows in sorted(only.select(bucket).groupBy("bucket").count().collect()):
        if passed + rows >= n:
            break
        passed += rows
    else:
        number = -1
    inside = only.select(*keys, bucket).filter(F.col("bucket") == number)
    upto = F.sum("of").over(Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0))
    counts = inside.groupBy(*keys).agg(F.count("*").alias("of")).withColumn("upto", upto)  # the keys of one range
    here = (F.col("upto") >= n - passed) & (F.col("upto") - F.col("of") < n - passed)
    return counts.filter(here).select(*keys, (n - passed - F.col("upto") + F.col("of")).alias("taken"), "of")


def _is_plain(df: DataFrame, keys: Sequence[str]) -> bool:
    """Whether a key is one whole number or date, which can be a literal."""
    return len(keys) == 1 and isinstance(df.schema[keys[0]].dataType, (T.IntegralType, T.DateType))


def _compare(df: DataFrame, keys: Sequence[str], border: DataFrame, value: Any) -> tuple[Column, Column]:
    """Whether a row's key is below the border, and whether it is the border. NULLs are smallest.

    Whole numbers and dates become literals, which reach the scan. All other keys stay in the engine,
    with their own types; they are compared as structs.
    """
    if _is_plain(df, keys):
        key, kind = F.col(keys[0]), df.schema[keys[0]].dataType
        if value is None:
            return F.lit(False), key.isNull()
        return key.isNull() | (key < F.lit(value).cast(kind)), key == F.lit(value).cast(kind)
    own, last = F.struct(*keys), border.select(F.struct(*keys)).scalar()
    return own < last, own == last
