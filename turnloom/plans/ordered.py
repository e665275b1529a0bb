"""Running sums over a total order, without a one-task window.

The rows are cut into order-preserving buckets of about equal size. A bucket is a
plain function of the row, so the few bucket totals can be summed up first and
the payload is then shuffled once, by bucket.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SAMPLED_PER_BUCKET = 1000
_ROWS_PER_BUCKET = 200_000
_MAX_BUCKETS = 16_384
_MAX_BOUND_BYTES = 16 << 20  # of all bounds, which are part of the plan


@dataclass(frozen=True)
class Bounds:
    """The lowest ordering value of each bucket as one sorted constant array, and how many."""

    lows: Column
    count: int


def default_buckets(df: DataFrame, rows: int) -> int:
    """Several per task, and more for more rows."""
    wanted = max(4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // _ROWS_PER_BUCKET)
    return min(wanted, _MAX_BUCKETS)


def key_ranges(df: DataFrame, order: Sequence[str], buckets: int) -> DataFrame:
    """``low, high, n`` of at most ``buckets`` consecutive ranges of the ordering.

    Spark's range partitioner picks the cuts; only the ordering columns move.
    """

    if len(order) == 1:  # plain values can be hash-aggregated, structs cannot
        value = F.col(order[0])
        low = F.when(F.count(value) == F.count("*"), F.min(value))  # NULL comes first
        low, high = (F.struct(v.alias(order[0])) for v in (low, F.max(value)))
    else:
        low, high = F.min(F.struct(*order)), F.max(F.struct(*order))
    ranged = df.select(*order).repartitionByRange(buckets, *order)
    return ranged.groupBy(F.spark_partition_id().alias("range")).agg(
        low.alias("low"), high.alias("high"), F.count("*").alias("n")
    )


def bucket_bounds(df: DataFrame, order: Sequence[str], buckets: int | None = None) -> Bounds:
    """Bounds of about ``buckets`` even buckets, fewer if the values are so long that all
    bounds would take more than 16 MB.

    Any values are right, a sample finds even ones. They come to the driver once,
    so that every later plan sees the same.
    """
    rows = df.count()
    buckets = buckets or default_buckets(df, rows)
    share = _SAMPLED_PER_BUCKET * buckets / max(rows, 1)
    sample = df.select(*order).sample(share, seed=0) if share < 1 else df
    if any(not isinstance(df.schema[c].dataType, (T.NumericType, T.DatetimeType)) for c in order):
        longest = sample.agg(F.max(F.octet_length(F.to_json(F.struct(*order))))).head()[0] or 1
        buckets = max(1, min(buckets, _MAX_BOUND_BYTES // longest))
    array = key_ranges(sample, order, buckets).agg(F.sort_array(F.collect_list("low")).alias("lows"))
    text, count = array.select(F.to_json("lows"), F.size("lows")).head()
    lows = F.sort_array(F.from_json(F.lit(text), array.schema["lows"].dataType))
    return Bounds(lows, count)


def bucket_of(value: Column, bounds: Bounds) -> Column:
    """How many bounds are at or below ``value``: a binary search in the JVM.

    Exploded from a one-item array, so that the optimizer sees a plain column and
    does not carry the whole search into the filters it derives for joins.
    """
    steps = [1 << i for i in reversed(range(max(bounds.count, 1).bit_length()))]

    def advance(pos: Column, step: Column) -> Column:
        ahead = F.get(bounds.lows, pos + step - F.lit(1)) <= value
        return F.when(ahead, pos + step).otherwise(pos)

    position = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), advance)
    return F.explode(F.array(position))


def with_running_start(
    df: DataFrame,
    order: Sequence[str],
    weight: str,
    group: Sequence[str] = (),
    ties: Sequence[str] = (),
    sizes: DataFrame | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Add ``start``: the sum of ``weight`` over all earlier rows of the group.

    Rows are ordered by ``order`` and then by ``ties``. The values of ``group`` and
    ``order`` should be small, as some of them become bounds. ``sizes`` holds the
    group, order and weight columns of the same rows when those are costly to
    compute from ``df``. Also adds ``bucket`` and the bucket's own range, ``bucket_start``
    and ``bucket_end``. The result stays partitioned by bucket and group.
    """
    sizes = df if sizes is None else sizes
    ordering = [*group, *order]
    bounds = bucket_bounds(sizes, ordering, buckets)
    bucket = bucket_of(F.struct(*ordering), bounds).alias("bucket")

    totals = (
        sizes.select(*group, weight, bucket)
        .groupBy("bucket", *group)
        .agg(F.sum(weight).alias("total"))
    )
    # At most one row per bucket, plus one per group: nothing here grows with the rows.
    earlier = Window.partitionBy(*(group or [F.lit(0)])).orderBy("bucket")
    end = F.sum("total").over(earlier.rowsBetween(Window.unboundedPreceding, 0))
    bases = totals.select(
        F.col("bucket").alias("base_bucket"),
        *[F.col(g).alias(f"base_{g}") for g in group],
        (end - F.col("total")).alias("bucket_start"),
        end.alias("bucket_end"),
    )
    if not group:
        bases = F.broadcast(bases)  # one row per bound and one, 16,385 at most

    within = Window.partitionBy("bucket", *group).orderBy(*order, *ties)
    before = F.sum(weight).over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col(weight)
    same = F.col("bucket") == F.col("base_bucket")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"base_{g}"))
    return (
        df.select("*", bucket)
        .withColumn("before", before)
        .join(bases, same)
        .withColumn("start", F.col("bucket_start") + F.col("before"))
        .drop("before", "base_bucket", *[f"base_{g}" for g in group])
    )
