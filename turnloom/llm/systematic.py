"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import WORD, buckets_for, text_or_empty
from turnloom.plans.ordered import with_running_start
from turnloom.plans.scratch import scratch_table

_ROWS_PER_BUCKET = 5_000


def _hash_bits(text: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def source_targets(
    sizes: DataFrame, source: str, weights: Sequence[float], cap: float
) -> DataFrame:
    """``source, index, source_size, target`` of a table of ``source`` and ``size`` rows.

    Sources in code point order, NULL last, have the weights in turn and share the total of all
    sizes. A target stops at ``cap`` times its source's size; the excess is shared
    again by weight until none is above. Only three sums per round come to the driver.
    """
    totals = sizes.groupBy(source).agg(F.sum("size").alias("source_size"))
    totals = totals.select(
        source, "source_size", F.col(source).isNull().alias("unnamed"), F.lit(1).alias("one")
    )
    totals = scratch_table(totals, "sources")
    ranked = with_running_start(
        totals, ["unnamed", source], "one", buckets=buckets_for(totals.count(), 100_000)
    )
    turn = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("start") % len(weights)).cast("int"))
    ranked = scratch_table(
        ranked.select(source, "source_size", F.col("start").cast("long").alias("index"), turn.alias("weight")),
        "source-weights",
    )
    limit = F.lit(float(cap)) * F.col("source_size")

    def sums(level: float | None) -> tuple[int, float, float, float]:
        over = F.lit(False) if level is None else F.col("weight") * F.lit(level) > limit
        row = ranked.agg(
            F.sum("source_size"), F.sum(F.when(over, limit)), F.sum(F.when(~over, F.col("weight"))),
            F.count(F.when(over, 1)),
        ).head()
        return tuple(x or 0 for x in row)

    total, _, free, capped = sums(None)
    level = total / free if free else 0.0
    while True:
        _, taken, free, above = sums(level)
        if above == capped or not free:
            break
        capped, level = above, (total - taken) / free
    target = F.least(F.col("weight") * F.lit(float(level)), limit)
    return ranked.select(source, "index", "source_size", target.alias("target"))


def mix(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = (1, 2, 3),
    cap: float = 3,
    seed: int = 42,
    keep: Sequence[str] = (),
) -> DataFrame:
    """``key, size, source_size, target, copies`` and the columns ``keep`` of every row.

    A row's size is its number of words (NULL and empty texts: 0). Each source has a target, see
    :func:`source_targets`, and each of its rows is expected ``target / source_size`` times.
    The expected copies are summed up along the source's rows, ordered by size and then at
    random by key, one random offset per source is added, and a row is emitted once for each
    integer that its step crosses. Because rows lie in order of size, each part of the
    size range is taken in proportion, and the words taken differ from the target by about
    the longest text at most. A row has at most ``ceil(target / source_size)`` copies.

    Deterministic by seed. Rows that agree in key and text are interchangeable. A source without
    words has target 0. An empty table gives an empty one; further columns do no harm.
    """
    shown = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    measured = df.select(
        *[F.col(f"`{c}`") for c in dict.fromkeys([key, *keep])],
        F.col(source).alias("_source"),
        F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long").alias("size"),
        _hash_bits(F.concat(F.lit(f"{seed}:"), shown), 15).alias("_draw"),
        F.xxhash64(text_or_empty(text)).alias("_text"),
    )
    # Without further columns the narrow rows are all there is, and a salt spreads equal ones.
    salt = F.lit(0).cast("long") if keep else F.xxhash64(F.monotonically_increasing_id())
    measured = measured.withColumn("_salt", salt)
    narrow = scratch_table(measured.select(key, "_source", "size", "_draw", "_text", "_salt"), "sizes")
    targets = source_targets(narrow.select("_source", "size"), "_source", weights, cap)
    offset = _hash_bits(
        F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("_source"), F.lit("null|"))), 5
    ) * F.lit(2.0**-20)
    targets = scratch_table(
        targets.select(
            F.col("_source").alias("_named"), F.col("index").alias("_index"), "source_size", "target",
            offset.alias("_offset"),
        ),
        "targets",
    )

    def of_source(rows: DataFrame) -> DataFrame:
        joined = rows.join(targets, F.col("_source").eqNullSafe(F.col("_named")))
        return joined.drop("_named", "_source").withColumn("_one", F.lit(1))

    sizes = of_source(narrow)
    walked = with_running_start(
        of_source(measured) if keep else sizes, ["size", "_draw", key, "_text", "_salt"], "_one", group=["_index"],
        sizes=sizes, buckets=buckets_for(narrow.count(), _ROWS_PER_BUCKET),
    )
    step = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    before = F.floor(F.col("_offset") + step * F.col("start"))
    after = F.floor(F.col("_offset") + step * (F.col("start") + 1))
    return walked.select(
        *[F.col(f"`{c}`") for c in dict.fromkeys([key, *keep])],
        "size", "source_size", "target", (after - before).cast("long").alias("copies"),
    )
