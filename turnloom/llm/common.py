"""Column expressions and settings that several of the corpus operators share."""

from __future__ import annotations

import string
import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"  # [\x20\x09-\x0D], the white space of all contracts
WORD = r"[^\x20\x09-\x0D]+"


def by_value(module: str) -> None:
    """Tasks get the module's functions and classes with their code: executors need not have it."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; ``lower`` does it for texts of ASCII only."""
    mapped = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(mapped)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    The optimizer copies a column into each place that mentions it, also into lambdas that
    run once per array element. A lambda's own variable is computed once.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def buckets_for(rows: int, per_bucket: int) -> int:
    """Order-preserving buckets of about ``per_bucket`` rows, 16,384 at most."""
    return min(max(rows // per_bucket, 1), 1 << 14)


def bounded_sample(df: DataFrame, key: str, most: int, seed: int = 42) -> DataFrame:
    """The distinct values of ``key`` that are not NULL, or at most ``most`` of them.

    Taken are those whose hash is smallest, so the same ones in any order and however often they
    repeat. The number of distinct values is estimated first; of many a part of about ``4 * most`` is made
    distinct, and 256 counts come to the driver.
    """
    keys = df.select(F.col(key).alias(key)).filter(F.col(key).isNotNull())
    distinct = keys.agg(F.approx_count_distinct(key, 0.02)).head()[0]
    place = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(max(256, 64 * distinct // most)))
    near = keys.filter(place < 256).distinct().select(key, place.alias("_place"))
    counts = dict(near.groupBy("_place").count().collect())
    limit, taken = 0, 0
    while limit < 256 and taken + counts.get(limit, 0) <= most:
        taken += counts.get(limit, 0)
        limit += 1
    return near.filter(F.col("_place") < limit).select(key)
