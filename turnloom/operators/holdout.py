"""An exact, reproducible train/validation split.

Rows are ranked by a seeded hash and the lowest ``ceil(fraction * n)`` form the
test side. The rank is never computed: a few histograms over hash prefixes find
the one hash value at the border, and each side is then a plain filter.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions.exact import exact_text
from turnloom.plans.scratch import scratch_table

_DIGITS = 4  # hex digits per histogram: at most 65536 rows reach the driver
_SMALL = 100_000  # hash values that are listed one by one


@dataclass(frozen=True)
class _Border:
    value: str  # the hash at the border
    taken: int  # how many rows with that hash belong to the test side
    ties: int  # how many rows have that hash


def holdout(
    df: DataFrame,
    key: Sequence[str] | str = (),
    seed: int = 42,
    fraction: float = 0.1,
    together: Sequence[str] | str = (),
) -> tuple[DataFrame, DataFrame]:
    """``(train, test)``. Without a key the whole row is hashed.

    Rows that share a hash are told apart by their other columns; rows equal in
    all columns are interchangeable, so the right number of copies goes to each
    side. Both sides together are always exactly the input.

    With ``together`` rows that agree in those columns, the parts of one conversation, say, are on
    one side, and the size counts such groups instead of rows.
    """

    def size(total: int) -> int:
        wanted = math.ceil(fraction * total)
        if not 0 < wanted < total:
            raise ValueError(f"holding out {fraction} of {total} rows leaves a side empty")
        return wanted

    if together:
        test, train = _take_groups(df, _names(together), seed, size)
    else:
        test, train = take_by_hash(df, _names(key), seed, size)
    return train, test


def _names(columns: Sequence[str] | str) -> list[str]:
    return [columns] if isinstance(columns, str) else list(columns)


def take_by_hash(
    df: DataFrame, key: Sequence[str], seed: int, wanted: Callable[[int], int]
) -> tuple[DataFrame, DataFrame]:
    """``(taken, rest)``: exactly ``wanted(number of rows)`` rows are taken.

    The number wanted must be between 1 and the number of rows. Rows are taken in the order of
    :func:`row_hashes`.
    """
    first, second = row_hashes(df, key or df.columns, seed)
    hashes = scratch_table(df.select(first.alias("h")), "row-hashes")  # one pass over the source
    border = _find_border(hashes, wanted)
    if border.taken == border.ties:
        return df.filter(first <= border.value), df.filter(first > border.value)

    # Another pass over the source, for the rows that share the hash at the border.
    tied = scratch_table(df.filter(first == border.value).select(second.alias("h")), "tied-hashes")
    inner = _find_border(tied, lambda _: border.taken)
    at = (first == border.value) & (second == inner.value)
    below = (first < border.value) | ((first == border.value) & (second < inner.value))
    if inner.taken == inner.ties:
        return df.filter(below | at), df.filter(~(below | at))

    # The second hash covers every column, exactly: these rows are copies of one.
    one = df.filter(at).limit(1)
    taken = df.filter(below).unionByName(_copies(one, inner.taken))
    rest = df.filter(~(below | at)).unionByName(_copies(one, inner.ties - inner.taken))
    return taken, rest


def _take_groups(
    df: DataFrame, columns: Sequence[str], seed: int, wanted: Callable[[int], int]
) -> tuple[DataFrame, DataFrame]:
    first, second = row_hashes(df.select(*columns), columns, seed)
    groups = scratch_table(df.select(first.alias("h"), second.alias("second")).distinct(), "group-hashes")
    border = _find_border(groups.select("h"), wanted)
    low, at = first < border.value, first == border.value
    if border.taken < border.ties:
        tied = groups.filter(F.col("h") == border.value).select(F.col("second").alias("h"))
        at = at & (second <= _find_border(tied, lambda _: border.taken).value)
    return df.filter(low | at), df.filter(~(low | at))


def row_hashes(df: DataFrame, key: Sequence[str], seed: int) -> tuple[Column, Column]:
    """The md5 of ``seed:key``, and that of all columns as a text that no other row has.

    A key of several columns is taken as such a text, too.
    """
    one = len(key) == 1
    text = F.coalesce(F.col(key[0]).cast("string"), F.lit("")) if one else exact_text(df.select(*key).schema)
    return F.md5(F.concat(F.lit(f"{seed}:"), text)), F.md5(exact_text(df.schema))


def _find_border(hashes: DataFrame, wanted: Callable[[int], int]) -> _Border:
    """Walk down the hash prefixes to the value that holds the last wanted row."""
    prefix, need = "", None
    while need is None or (row["n"] > _SMALL and len(prefix) < 2 * _DIGITS):
        left = hashes.filter(F.col("h").startswith(prefix)) if prefix else hashes
        bucket = F.substring("h", 1, len(prefix) + _DIGITS).alias("bucket")
        rows = left.groupBy(bucket).agg(F.count("*").alias("n")).orderBy("bucket").collect()
        if need is None:
            need = wanted(sum(row["n"] for row in rows))
        row, need = _locate(rows, need)
        prefix = row["bucket"]
    # Few different values are left: a small bucket, or one in 2^32 of all values.
    listed = hashes.filter(F.col("h").startswith(prefix)).groupBy("h")
    row, need = _locate(listed.agg(F.count("*").alias("n")).orderBy("h").collect(), need)
    return _Border(row["h"], need, row["n"])


def _locate(rows, need: int):
    """The row in which the running count reaches ``need``, and the rest needed in it."""
    for row in rows:
        if need <= row["n"]:
            return row, need
        need -= row["n"]
    raise AssertionError("the input changed between two passes")


def _copies(one: DataFrame, n: int, chunk: int = 1_000_000) -> DataFrame:
    """``n`` copies of a single row, made in parallel."""
    full, rest = divmod(n, chunk)
    sizes = F.when(F.col("__chunk") < full, F.lit(chunk)).otherwise(F.lit(rest))
    return (
        one.select("*", F.explode(F.sequence(F.lit(0), F.lit(full))).alias("__chunk"))
        .repartition(max(1, min(full + 1, 10_000)))
        .select("*", sizes.alias("__size"))
        .filter("__size > 0")
        .select(*one.columns, F.explode(F.sequence(F.lit(1), F.col("__size"))).alias("__copy"))
        .drop("__copy")
    )
