"""Packing token sequences into blocks of one fixed length."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnloom.functions.tokens import whitespace_tokens
from turnloom.plans.ordered import with_running_start
from turnloom.plans.scratch import scratch_table

MAX_COPIES = 4096
_BLOCKS_PER_CHUNK = 1024


def pack_wrapped(
    df: DataFrame,
    key: str | Sequence[str],
    value: str,
    block_len: int = 2048,
    buckets: int | None = None,
    max_copies: int = MAX_COPIES,
) -> DataFrame:
    """Concatenate all sequences in key order and cut blocks of ``block_len``.

    ``value`` is a text column, cut at whitespace, or an array of tokens. Returns
    ``block, n_tokens`` and ``content`` (the tokens joined by single spaces) or, for
    arrays, ``tokens``. Several key columns are taken in turn. Only the last block may be shorter. Rows with the same key
    are ordered by the md5 of their text, or of their tokens joined by commas.

    More than ``max_copies`` rows equal in key and value are collapsed before they
    are shuffled, and their blocks are made by many tasks.
    """
    keys = [key] if isinstance(key, str) else list(key)
    key = F.col(keys[0]) if len(keys) == 1 else F.struct(*keys)
    if _runs_python(df):  # sizes and texts are read one after the other, Python has to run once
        df = scratch_table(df.select(*dict.fromkeys([*keys, value])), "pack-input")
    is_text = isinstance(df.schema[value].dataType, T.StringType)

    def tokens_of(col: str) -> Column:
        return whitespace_tokens(F.col(col)) if is_text else F.col(col)

    text = F.col(value) if is_text else F.array_join(F.col(value).cast("array<string>"), ",")
    rows = df.select(
        key.alias("key"),
        F.md5(text).alias("mark"),
        F.size(tokens_of(value)).cast("long").alias("n"),
        F.lit(1).cast("long").alias("copies"),
        F.col(value).alias("value"),
    )
    sizes = scratch_table(rows.select("key", "mark", "n", "copies"), "pack-sizes")
    repeated = _many_copies(rows, sizes, max_copies)
    if repeated is not None:
        known = repeated.select(F.col("key").alias("hot_key"), F.col("mark").alias("hot_mark"))
        is_hot = F.col("key").eqNullSafe(F.col("hot_key")) & (F.col("mark") == F.col("hot_mark"))
        rows, sizes = (
            part.join(known, is_hot, "left_anti").unionByName(repeated.select(*part.columns))
            for part in (rows, sizes)
        )
    total = (F.col("n") * F.col("copies")).alias("total")
    # The text itself is shuffled; it is cut into tokens again behind the shuffle.
    placed = with_running_start(
        rows.select("*", total), ["key", "mark"], "total",
        sizes=sizes.select("*", total), buckets=buckets,
    ).filter(F.col("total") > 0)

    block, start, n = F.col("block"), F.col("start"), F.col("n")
    stop = start + F.col("total")
    first, last = F.expr(f"start div {block_len}"), F.expr(f"(start + total - 1) div {block_len}")
    low, high = F.greatest(start, block * block_len), F.least(stop, (block + 1) * block_len)

    def pieces(in_blocks: DataFrame, tokens: Column, skipped: Column) -> DataFrame:
        length = (high - low).cast("int")
        piece = F.slice(tokens, skipped.cast("int") + 1, length)
        return in_blocks.select(
            "bucket",
            "block",
            low.alias("pos"),
            length.alias("length"),
            (F.array_join(piece, " ") if is_text else piece).alias("piece"),
        )

    def pieces_of(rows: DataFrame, which: Column = F.lit(True)) -> DataFrame:
        cut = rows.withColumn("tokens", tokens_of("value"))
        in_blocks = cut.select("*", F.explode(F.sequence(first, last)).alias("block"))
        return pieces(in_blocks.filter(which), F.col("tokens"), low - start)

    def pieces_of_copies(rows: DataFrame) -> DataFrame:
        """The blocks of each row are spread over tasks before its text is repeated."""
        chunk = F.col("chunk") * _BLOCKS_PER_CHUNK
        chunks = F.sequence(F.floor(first / _BLOCKS_PER_CHUNK), F.floor(last / _BLOCKS_PER_CHUNK))
        spread = rows.select("*", F.explode(chunks).alias("chunk")).repartition("key", "chunk")
        in_chunk = F.sequence(
            F.greatest(first, chunk), F.least(last, chunk + (_BLOCKS_PER_CHUNK - 1))
        )
        cut = spread.withColumn("tokens", tokens_of("value"))
        in_blocks = cut.select("*", F.explode(in_chunk).alias("block"))
        skipped = (low - start) % n
        times = F.ceil((skipped + high - low) / n).cast("int")
        return pieces(in_blocks, F.flatten(F.array_repeat("tokens", times)), skipped)

    def whole(parts: Column) -> Column:
        in_order = F.transform(F.sort_array(parts), lambda p: p["piece"])
        joined = F.array_join(in_order, " ") if is_text else F.flatten(in_order)
        return joined.alias("content" if is_text else "tokens")

    def blocks(rows: DataFrame, *by: str) -> DataFrame:
        parts = F.collect_list(F.struct("pos", "piece"))
        return rows.groupBy(*by).agg(F.sum("length").cast("long").alias("n_tokens"), whole(parts)).drop("bucket")

    # A block that lies inside one bucket is complete there and needs no further
    # shuffle; only the at most two blocks at the ends of a bucket do.
    inside = (block * block_len >= F.col("bucket_start")) & (
        (block + 1) * block_len <= F.col("bucket_end")
    )
    at_the_ends = (first * block_len < F.col("bucket_start")) | (
        (last + 1) * block_len > F.col("bucket_end")
    )
    if repeated is None:
        within = blocks(pieces_of(placed, inside), "bucket", "block")
        across = blocks(pieces_of(placed.filter(at_the_ends), ~inside), "block")
        return within.unionByName(across)

    # Repeated values leave a mark in their first and last block: these are put together later,
    # from the pieces of single rows there and those that the copies give.
    single = F.col("copies") == 1
    touched = F.when(single, F.sequence(first, last)).otherwise(F.array(first, last))
    marked = placed.withColumn("tokens", F.when(single, tokens_of("value"))).select(
        "*", F.explode(touched).alias("block")
    )
    mine = pieces(marked.filter(inside), F.col("tokens"), low - start)
    by_block = mine.groupBy("bucket", "block").agg(
        F.sum("length").cast("long").alias("n_tokens"),
        F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("pos", "length", "piece"))).alias("parts"),
        F.max(F.col("piece").isNull()).alias("shared"),
    )
    within = by_block.filter(~F.col("shared")).select("block", "n_tokens", whole(F.col("parts")))
    beside = by_block.filter("shared").select("bucket", "block", F.inline("parts"))
    ends = pieces_of(placed.filter(at_the_ends & single), ~inside)
    copied = pieces_of_copies(placed.filter(~single))
    return within.unionByName(blocks(beside.unionByName(ends).unionByName(copied), "block"))


def _runs_python(df: DataFrame) -> bool:
    plan = df._jdf.queryExecution().analyzed().toString()
    return any(word in plan for word in ("PythonUDF", "MapInArrow", "MapInPandas", "FlatMapGroups", "FlatMapCoGroups"))


def _many_copies(rows: DataFrame, sizes: DataFrame, max_copies: int) -> DataFrame | None:
    """One row for each value with more than ``max_copies`` copies, if there are any."""
    counts = sizes.filter(F.col("n") > 0).groupBy("key", "mark").count()
    hot = counts.filter(F.col("count") > max_copies).select(
        F.col("key").alias("hot_key"), F.col("mark").alias("hot_mark")
    )
    if hot.isEmpty():
        return None
    known = scratch_table(hot, "pack-hot")
    is_hot = F.col("key").eqNullSafe(F.col("hot_key")) & (F.col("mark") == F.col("hot_mark"))
    copies = (
        rows.join(known, is_hot)
        .groupBy("key", "mark", "n", "value")
        .agg(F.sum("copies").alias("copies"))
    )
    return scratch_table(copies, "pack-copies")
