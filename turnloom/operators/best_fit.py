"""Packing whole sequences into blocks: best fit, longest first.

Which block a sequence goes to depends on its length and on how many of that length come before it,
and on nothing else. So the fitting is done for the histogram of lengths, a run of equal
sequences and a run of equal blocks at a time, and the table only looks its places up.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Mapping, Sequence
from heapq import heappop, heappush
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnloom.functions.tokens import whitespace_tokens
from turnloom.plans.ordered import with_running_start
from turnloom.plans.scratch import scratch_table

_MAX_BROADCAST = 1_000_000  # runs whose 32 bytes go to every task


class Run(NamedTuple):
    """Sequences of one length, from the ``first`` of that length on, in ``blocks`` blocks from ``block`` on."""

    length: int
    first: int
    per_block: int
    block: int
    blocks: int
    offset: int  # of the first one in each block


class Room:
    """The blocks by their free room: for each size the runs of blocks that have it, lowest first."""

    def __init__(self) -> None:
        self.sizes: list[int] = []  # in order, a search tree of at most one entry per size
        self.runs: dict[int, list[tuple[int, int]]] = {}

    def add(self, size: int, block: int, blocks: int) -> None:
        if size and blocks:
            if size not in self.runs:
                insort(self.sizes, size)
                self.runs[size] = []
            heappush(self.runs[size], (block, blocks))

    def take(self, least: int) -> tuple[int, int, int] | None:
        """The run of blocks with the smallest room of at least ``least``."""
        at = bisect_left(self.sizes, least)
        if at == len(self.sizes):
            return None
        size = self.sizes[at]
        block, blocks = heappop(self.runs[size])
        if not self.runs[size]:
            del self.runs[size], self.sizes[at]
        return size, block, blocks


def best_fit_runs(histogram: Mapping[int, int], block_len: int) -> tuple[list[Run], int]:
    """Where the sequences of each length go, and how many blocks there are.

    The same as taking the sequences one by one, longest first, each into the block with the smallest
    room that is enough, the lowest of equal ones, or into a new one. A block that takes a
    sequence and still has room for its like is then the best one, so it is filled up at once.
    """
    room, runs, n_blocks = Room(), [], 0
    for length in sorted(histogram, reverse=True):
        first, left = 0, histogram[length]
        while left:
            free, block, blocks = room.take(length) or (block_len, n_blocks, -(-left // (block_len // length)))
            n_blocks = max(n_blocks, block + blocks)
            per_block, offset = free // length, block_len - free
            full = min(blocks, left // per_block)
            some = left - full * per_block if full < blocks else 0  # what one more block takes
            for taken, at, count in ((per_block, block, full), (some, block + full, 1 if some else 0)):
                if count:
                    runs.append(Run(length, first, taken, at, count, offset))
                    room.add(free - taken * length, at, count)
                    first, left = first + taken * count, left - taken * count
            used = full + (1 if some else 0)
            room.add(free, block + used, blocks - used)
    return runs, n_blocks


def pack_best_fit(
    df: DataFrame, key: str | Sequence[str], value: str, block_len: int = 2048, overlong: str = "split", buckets: int | None = None
) -> DataFrame:
    """Whole sequences in blocks of at most ``block_len`` tokens, by best fit, longest first.

    ``value`` is a text column, cut at whitespace, or an array of tokens. Returns ``block, n_tokens, lengths``
    and ``content`` (the tokens joined by single spaces) or, for arrays, ``tokens``; ``lengths`` are
    those of the block's sequences in order. A longer sequence than a block is cut into parts of its
    length and a rest (``overlong="split"``), or to one part (``"truncate"``). Sequences without
    tokens take no place. Of one length those with the smallest keys come first; rows with the same key
    are ordered by part and the md5 of their text, or of their tokens joined by commas.

    The parts are written once, with a salt that spreads equal rows. One row per length goes to the
    driver. The parts are then shuffled to find their ranks, and once more by block.
    """
    if overlong not in ("split", "truncate"):
        raise ValueError(f"overlong must be 'split' or 'truncate', not {overlong!r}")
    if block_len < 1:
        raise ValueError(f"a block needs at least one token, not {block_len}")
    keys = [key] if isinstance(key, str) else list(key)
    own = F.col(keys[0]) if len(keys) == 1 else F.struct(*keys)
    is_text = isinstance(df.schema[value].dataType, T.StringType)
    cut = df.select(own.alias("key"), (whitespace_tokens(F.col(value)) if is_text else F.col(value)).alias("tokens"))
    last = F.ceil(F.size("tokens") / block_len).cast("int") - 1 if overlong == "split" else F.lit(0)
    parts = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("tokens", i * block_len + 1, F.lit(block_len)))
    pieces = cut.filter(F.size("tokens") > 0).select("key", F.posexplode(parts).alias("part", "tokens"))
    text = F.array_join(F.col("tokens").cast("array<string>"), " " if is_text else ",")
    rows = scratch_table(
        pieces.select(
            F.size("tokens").alias("n"), "key", "part", F.md5(text).alias("mark"),
            F.xxhash64(F.monotonically_increasing_id()).alias("salt"), (text if is_text else F.col("tokens")).alias("piece"),
        ),
        "pack-parts",
    )
    histogram = {r["n"]: r["count"] for r in rows.groupBy("n").count().collect()}  # block_len rows at most
    order = ["n", "key", "part", "mark", "salt"]
    numbered = rows.withColumn("one", F.lit(1).cast("long"))
    placed = with_running_start(numbered, order, "one", buckets=buckets).select("n", "start", "piece")
    blocks = _looked_up(placed, *best_fit_runs(histogram, block_len), histogram)
    parts_of = blocks.groupBy("block").agg(
        F.sum("n").cast("long").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("offset", "n", "piece"))).alias("parts")
    )
    in_order = F.transform("parts", lambda p: p["piece"])
    whole = F.array_join(in_order, " ").alias("content") if is_text else F.flatten(in_order).alias("tokens")
    return parts_of.select("block", "n_tokens", F.transform("parts", lambda p: p["n"]).alias("lengths"), whole)


def _looked_up(placed: DataFrame, runs: list[Run], n_blocks: int, histogram: Mapping[int, int]) -> DataFrame:
    """``block, offset, n, piece`` from each part's rank among all, by a binary search in the runs of its length."""
    by_length: dict[int, list[Run]] = {}
    for run in runs:
        by_length.setdefault(run.length, []).append(run)
    shorter, plan = 0, []
    for length in sorted(histogram):
        own = by_length[length]
        plan.append((length, shorter, [r.first for r in own], [r.per_block for r in own], [r.block for r in own], [r.offset for r in own]))
        shorter += histogram[length]
    schema = "length int, shorter long, firsts array<long>, per_block array<int>, blocks array<long>, offsets array<int>"
    table = scratch_table(placed.sparkSession.createDataFrame(plan, schema), "pack-plan")
    if len(runs) <= _MAX_BROADCAST:
        table = F.broadcast(table)
    ranked = placed.join(table, F.col("n") == F.col("length")).withColumn("rank", F.col("start") - F.col("shorter"))
    longest = max((len(own) for own in by_length.values()), default=1)
    steps = [F.lit(1 << i) for i in reversed(range(longest.bit_length()))]

    def advance(at: Column, step: Column) -> Column:
        return F.when(F.get("firsts", at + step - 1) <= F.col("rank"), at + step).otherwise(at)

    run = F.aggregate(F.array(*steps), F.lit(0), advance) - 1
    found = ranked.select("n", "piece", "rank", F.inline(F.array(F.struct(*[
        F.get(c, run).alias(c) for c in ("firsts", "per_block", "blocks", "offsets")
    ]))))
    inside = F.col("rank") - F.col("firsts")
    block = F.col("blocks") + F.floor(inside / F.col("per_block")).cast("long")
    offset = F.col("offsets") + (F.pmod(inside, F.col("per_block").cast("long")) * F.col("n")).cast("int")
    return found.select(block.alias("block"), offset.alias("offset"), "n", "piece")


def fill_rate(blocks: DataFrame, block_len: int = 2048) -> DataFrame:
    """One row on packed blocks: how many, their sequences and tokens, and the share of their room that is filled."""
    total = F.coalesce(F.sum("n_tokens"), F.lit(0).cast("long"))
    return blocks.agg(
        F.count("*").alias("n_blocks"),
        F.coalesce(F.sum(F.size("lengths")), F.lit(0)).cast("long").alias("n_sequences"),
        total.alias("n_tokens"),
        F.count_if(F.col("n_tokens") == block_len).alias("n_full"),
        F.try_divide(total, F.count("*") * block_len).alias("fill"),
    )
